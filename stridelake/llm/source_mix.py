"""Mixing sources to target weights with a low-discrepancy schedule.

A schedule of equal slots runs along golden-ratio points: slot i has the point frac(i * phi), kept
as a 32-bit integer, and belongs to the source in whose part of the cumulative targets the point
lies, so every stretch of the schedule is close to the weights. Slots are ranked per source. Each
source's documents lie end to end in a shuffled order (by a hash of the id); that stream is cut into
blocks of as many words as a slot has, and the slot of rank r takes block r. A stream goes round
once more where a source's target is above its size, so no document is taken more than twice.
The schedule's shares are right to a few slots; behind it each source gets slots for the blocks it
still lacks, and its last block ends at the target, so every source takes its target to the word.

Everything is DataFrame operations. Positions in a stream and ranks of slots are sums over parts of
bounded size plus the totals of the parts before, so no source is gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridelake.llm.common import WORD, small, written

#: 2**32 divided by the golden ratio, made odd.
_GOLDEN = 2654435769
_UNIT = 1 << 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) of (source, source_size).

    Weights go to the sources in order of their code points, nulls last, repeating. ``share`` times
    all words are shared out by weight; no target exceeds ``most`` times its source's size, and the
    excess goes to the others by weight until none is above. That is the level at which the sum of
    least(most * size, level * weight) is the whole: sources below their bound come in order of
    bound per weight, and the level follows from running sums. One row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place + 1).cast("int"))
    known = sizes.withColumn("w", w).withColumn("bound", F.lit(float(most)) * F.col("source_size"))
    by_bound = Window.orderBy(F.col("bound") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.least(F.lit(float(share)) * F.sum("source_size").over(everything), F.sum("bound").over(everything))
    before = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    spent, gone = F.coalesce(F.sum("bound").over(before), F.lit(0.0)), F.coalesce(F.sum("w").over(before), F.lit(0.0))
    stepped = known.withColumn("level", (budget - spent) / (F.sum("w").over(everything) - gone))
    level = F.max(F.when(F.col("level") <= F.col("bound") / F.col("w"), F.col("level"))).over(everything)
    target = F.least(F.col("bound"), F.coalesce(level, F.lit(float("inf"))) * F.col("w"))
    return stepped.select("source", "source_size", target.alias("target"))


def schedule(spark: SparkSession, shares: DataFrame, slots: int = 1 << 18, cells: int = 1024, part: int = 1 << 12) -> DataFrame:
    """(slot, source, rank) of (source, target): which source each slot is for, and its rank there, from 0."""
    whole = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = shares.withColumn("to", F.sum("target").over(whole)).withColumn("from", F.col("to") - F.col("target")).withColumn("all", F.sum("target").over(total)).where("all > 0 and target > 0")
    # points are compared as integers, so that neighbours meet without gaps
    scale = lambda c: F.round(F.col(c) / F.col("all") * _UNIT).cast("long")
    parts = parts.select("source", scale("from").alias("lo"), scale("to").alias("hi"))
    width = _UNIT // cells
    parts = parts.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    slot = spark.range(slots).withColumnRenamed("id", "slot").withColumn("point", F.pmod(F.col("slot") * _GOLDEN, F.lit(_UNIT))).withColumn("cell", F.floor(F.col("point") / width))
    dealt = slot.join(parts, "cell").where("point >= lo and point < hi").select("slot", "source", F.floor(F.col("slot") / part).alias("part"))
    within = Window.partitionBy("source", "part").orderBy("slot")
    counts = dealt.groupBy("source", "part").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("source").alias("s"), F.col("part").alias("p"), ahead.alias("ahead"))
    ranked = dealt.withColumn("i", F.row_number().over(within) - 1)
    return ranked.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).select("slot", "source", (F.col("i") + F.col("ahead")).alias("rank"))


def streams(docs: DataFrame, sizes: DataFrame, part_words: int = 1 << 20) -> DataFrame:
    """``docs`` (row, doc_id, source, size) with ``start``: words before it in its source's shuffled stream.

    The order is by xxhash64 of the id, then id, then row. It is cut by hash into parts of about
    ``part_words`` words, each summed on its own, behind the totals of the parts before it. Parts of a
    source beyond ``part_words`` squared / 1024 words grow with its root, and so does their number.
    """
    h = F.xxhash64("doc_id")
    n = F.greatest(F.ceil(F.col("source_size") / F.greatest(F.lit(float(part_words)), 32 * F.sqrt("source_size"))), F.lit(1))
    # the upper 32 bits of the hash, shifted to be positive, scaled to 0 .. n - 1
    upper = F.shiftright(h, 32) + F.lit(1 << 31)
    placed = docs.join(sizes.select(F.col("source").alias("s"), "source_size"), F.col("source").eqNullSafe(F.col("s"))).withColumn("part", F.floor(upper / float(_UNIT) * n).cast("long")).withColumn("h", h)
    totals = placed.groupBy("s", "part").agg(F.sum("size").alias("words"))
    ahead = F.coalesce(F.sum("words").over(Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select(F.col("s").alias("s2"), F.col("part").alias("p2"), ahead.alias("ahead"))
    own = Window.partitionBy("s", "part").orderBy("h", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("inside", F.coalesce(F.sum("size").over(own), F.lit(0)))
    return summed.join(starts, F.col("s").eqNullSafe(F.col("s2")) & (F.col("part") == F.col("p2"))).select("row", "doc_id", "source", "size", "source_size", (F.col("inside") + F.col("ahead")).alias("start"))


def filled_up(plan: DataFrame, shares: DataFrame, block: int) -> DataFrame:
    """(slot, source, rank, words): ``plan`` without the ranks that lie behind a source's target, and with slots
    behind its last for the ranks that a source lacks. ``words`` is the target as whole words, one at least."""
    ends = shares.where("target > 0").select(F.col("source").alias("s"), F.greatest(F.round("target"), F.lit(1)).cast("long").alias("words"))
    ends = ends.withColumn("ranks", F.ceil(F.col("words") / F.lit(block)))
    have = plan.groupBy("source").agg(F.count("*").alias("have"))
    last = plan.agg(F.coalesce(F.max("slot") + 1, F.lit(0)).alias("last"))
    lacking = ends.join(have, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < ranks")
    lacking = lacking.select(F.col("s").alias("source"), F.explode(F.sequence("have", F.col("ranks") - 1)).alias("rank"), "words").crossJoin(last)
    behind = F.row_number().over(Window.orderBy("rank", F.col("source").asc_nulls_last())) - 1
    dealt = plan.join(ends, F.col("source").eqNullSafe(F.col("s"))).where("rank < ranks").select("slot", "source", "rank", "words")
    return dealt.unionByName(lacking.select((F.col("last") + behind).alias("slot"), "source", "rank", "words"))


def taken_pieces(placed: DataFrame, plan: DataFrame, block: Column) -> DataFrame:
    """(row, doc_id, source, round, slot, from_word, to_word): what each slot takes, as words of documents.

    ``placed`` has the column that ``block`` names or computes: words in a block. ``plan`` is as
    from ``filled_up``; nothing behind a source's ``words`` is taken. Round 0 is the first pass over
    a stream, round 1 the second.
    """
    twice = placed.where("size > 0").withColumn("round", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("a", F.col("start") + F.col("round") * F.col("source_size"))
    cut = twice.withColumn("b", block).withColumn("rank", F.explode(F.sequence(F.floor(F.col("a") / F.col("b")), F.floor((F.col("a") + F.col("size") - 1) / F.col("b")))))
    met = cut.join(plan.select(F.col("source").alias("s"), "slot", F.col("rank").alias("r"), "words"), F.col("source").eqNullSafe(F.col("s")) & (F.col("rank") == F.col("r")))
    lo = F.greatest(F.col("rank") * F.col("b"), F.col("a")) - F.col("a")
    hi = F.least((F.col("rank") + 1) * F.col("b"), F.col("a") + F.col("size"), F.col("words")) - F.col("a")
    return met.where("a < words and rank * b < words").select("row", "doc_id", "source", "round", "slot", lo.cast("long").alias("from_word"), hi.cast("long").alias("to_word"))


def _planned(docs: DataFrame, weights, share, most, slots, doc_id, text, source) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows in their streams, sources with their targets, and the pieces that slots take."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    rows = written(written(rows).withColumn("row", F.monotonically_increasing_id()))
    shares = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    whole = shares.agg(F.sum("target")).first()[0] or 0.0
    # whole words in a block; rounding up makes slots a little long, so the schedule ends when the targets are filled
    block = max(1, -(-int(whole) // slots))
    plan = schedule(spark, shares, slots).where(F.col("slot") < -(-int(whole) // block))
    plan = written(filled_up(written(plan), shares, block))
    placed = written(streams(rows, shares.select("source", "source_size")))
    return placed, shares, taken_pieces(placed, plan, F.lit(block).cast("long"))


def _mixed(docs: DataFrame, weights, share, most, slots, doc_id, text, source) -> DataFrame:
    placed, shares, pieces = _planned(docs, weights, share, most, slots, doc_id, text, source)
    sums = pieces.groupBy("row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.countDistinct("round").alias("rounds"))
    out = placed.join(sums, "row", "left").join(shares.select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("rounds", F.lit(0)).cast("int").alias("rounds"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, slots: int = 1 << 18, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, rounds), a row for each input row.

    taken counts words, repeats included; rounds says in how many passes words are taken (0, 1, 2).
    Null texts have no words and are not taken; null sources are a source of their own, ordered
    last; a source without words has target 0. Repeated rows are mixed each. An empty table gives an
    empty result. Extra columns are ignored. Reruns agree whatever the partitions, as rows are
    ordered by hash and id; only rows that agree in both may swap their shares.
    """
    return _mixed(docs, weights, share, most, slots, doc_id, text, source)


def apply(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, slots: int = 1 << 18, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed corpus in the order of the schedule: each row of ``docs`` as often as a pass takes words of it, whole, all columns kept.

    A row comes at the first slot that takes words of its id in a pass; partitions hold ranges of
    slots, sorted, so the files that are written from them follow the schedule. The document in which
    a pass ends is taken whole. Edge cases as in ``mix``; rows of one id go together, as rows of one
    slot and of no fixed order among themselves. Texts move once, to the place of their slot, while
    the slots of the ids fit a broadcast, else twice.
    """
    pieces = _planned(docs, weights, share, most, slots, doc_id, text, source)[2]
    first = pieces.groupBy(F.col("source").alias("__s"), F.col("doc_id").alias("__id"), "round").agg(F.min("slot").alias("slot"))
    # one slot for each pass, two at most
    takes = written(first.groupBy("__s", "__id").agg(F.collect_list("slot").alias("__slots")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(doc_id).alias("__i"), F.col(source).alias("__o")).where(word_count(F.col(f"__row.`{text}`")) > 0)
    met = rows.join(small(takes, 500_000), F.col("__i").eqNullSafe(F.col("__id")) & F.col("__o").eqNullSafe(F.col("__s")))
    return met.select("__row", F.explode("__slots").alias("__slot")).repartitionByRange("__slot").sortWithinPartitions("__slot").select("__row.*")
