"""Near-duplicate documents by bottom-k sketches from one hash function.

1. Each text becomes the set of its distinct word shingles, as 64-bit hashes. The k smallest are
   its sketch; texts with equal sets form a class whose smallest id stands for all.
2. The retained values of all classes form inverted lists. A class enters the lists of its rarest
   values only: two sketches that share at least c values must share one of the |sketch| - c + 1
   rarest of either, so a passage that many documents share costs nothing unless it makes up most
   of a document. c is exact while the sketches are the whole sets; above that, two sets with the
   wanted similarity retain fewer than half of k common values less than once in ten million pairs.
3. The classes of a list meet at its most typical member (the hub). Members of a hub are compared
   in blocks of bounded size: counts of shared retained values, then the union-sketch estimate,
   then the Jaccard similarity of the full sets. A block returns a spanning forest of its links.
4. Hubs with more than one block compare, in a second pass, only members that the first pass left
   outside the hub's component with members of the other blocks.
5. Components of all links give each class, and so each document, its smallest reachable id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import as_bytes, small, written
from stridelake.llm.graph import components

_U = np.uint64
#: Odd, so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_POWERS: list = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        m = 1 << int(n).bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(m, base, _U)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(text: bytes) -> np.ndarray:
    """A hash for each word of the text, A-Z in lower case, from one running polynomial sum."""
    raw = np.frombuffer(text.lower(), np.uint8)
    inside = ~_SPACE[raw]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, _U)
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum((raw.astype(_U) + _U(1)) * up[: len(raw)], out=total[1:])
    return _mix((total[end] - total[start]) * down[start] + (end - start).astype(_U))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes (int64); fewer words than ``width`` make one shingle, none an empty set."""
    w = word_hashes(text)
    if not len(w):
        return np.empty(0, np.int64)
    if len(w) < width:
        h = w[:1] + _U(len(w))
        for x in w[1:]:
            h = _mix(h) + x
    else:
        n = len(w) - width + 1
        h = w[:n] + _U(width)
        for i in range(1, width):
            h = _mix(h) + w[i : i + n]
    return np.unique(_mix(h).view(np.int64))


def least_shared(n, k: int, percent: int):
    """How many retained values a set of n must share with any set that is similar enough."""
    n = np.asarray(n)
    exact = -(-n * percent // 100)
    return np.where(n * 100 <= k * percent, exact, k * percent // 160)


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, k: int = 64) -> DataFrame:
    """(doc_id, th, n_shingles, sig, sketch): one pass over the texts, no shuffle. th is a hash of the text, sig of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sig, sk = [], [], []
            for x in b.column(2):
                s = shingle_set(x.as_buffer().to_pybytes(), width)
                n.append(len(s))
                sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sk.append(s[:k])
            flat = np.concatenate(sk) if sk else np.empty(0, np.int64)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in sk]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), lists], ["doc_id", "th", "n_shingles", "sig", "sketch"])

    return _keyed(docs, doc_id, text).mapInArrow(run, "doc_id long, th long, n_shingles long, sig binary, sketch array<long>")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return as_bytes(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text")))


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(x, full): whole shingle sets as packed int64, of (x, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                full = [shingle_set(x.as_buffer().to_pybytes(), width).tobytes() for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(full, pa.binary())], ["x", "full"])

    return texts.select("x", "text").mapInArrow(run, "x long, full binary")


class _Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def _counts(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of sets[rows] with sets[cols], through products of 0/1 matrices."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, code, often = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(often > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    code = place[code]
    owner, code = owner[code >= 0], code[code >= 0]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out = np.zeros((len(rows), len(cols)), np.float32)
    for lo in range(0, len(shared), width):
        a, b = np.searchsorted(code, [lo, lo + width])
        m = np.zeros((len(sets), min(width, len(shared) - lo)), np.float32)
        m[owner[a:b], code[a:b] - lo] = 1
        out += m[rows] @ m[cols].T
    return out


def link_block(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, labels: np.ndarray, k: int, percent: int) -> list[tuple[int, int]]:
    """Links between sets[rows] and sets[cols] that join different labels: a spanning forest of them.

    ``rows`` and ``cols`` are positions; labels say what is already known to be connected. No link
    between different labels is lost: a pair is skipped only when its ends are already connected,
    when their sketches share too few values, when the union-sketch estimate is far below the
    threshold, or when the full sets say no.
    """
    size = np.array([len(s) for s in sets])
    forest, first = _Forest(len(sets)), {}
    for i, x in enumerate(labels.tolist()):
        forest.join(i, first.setdefault(x, i))
    out = []
    overlap = _counts([s[:k] for s in sets], rows, cols)
    need = np.maximum.outer(least_shared(size[rows], k, percent), least_shared(size[cols], k, percent))
    small, large = np.minimum.outer(size[rows], size[cols]), np.maximum.outer(size[rows], size[cols])
    maybe = (overlap >= need) & (small * 100 >= large * percent) & (small > 0)
    del need, small, large
    pi, pj = np.nonzero(maybe)
    a, b = rows[pi], cols[pj]
    ahead = a != b
    pi, pj, a, b = pi[ahead], pj[ahead], a[ahead], b[ahead]
    order = np.argsort(-overlap[pi, pj], kind="stable")  # likely links first: they make later pairs needless
    dense = len(order) > 8 * len(sets)
    full = _counts(sets, rows, cols) if dense else None
    if dense:
        inter = full[pi, pj].astype(np.int64)
        linked = inter * 100 >= percent * (size[a] + size[b] - inter)
        order = order[linked[order]]
    for t in order.tolist():
        i, j = int(a[t]), int(b[t])
        if forest.find(i) == forest.find(j):
            continue
        if not dense:
            x, y = sets[i], sets[j]
            both = np.intersect1d(x[:k], y[:k], assume_unique=True)
            union = np.union1d(x[:k], y[:k])[:k]
            if np.isin(union, both, assume_unique=True).sum() * 160 < percent * len(union):
                continue
            inter = len(np.intersect1d(x, y, assume_unique=True))
            if inter * 100 < percent * (len(x) + len(y) - inter):
                continue
        forest.join(i, j)
        out.append((i, j))
    return out


def _blocks(members: DataFrame, sets: DataFrame, k: int, percent: int, two_sided: bool) -> DataFrame:
    """Links (a, b) of each (hub, block); members: hub, block, x, side, label. side 1 rows are compared with all rows of side 0."""

    def run(batch: pa.Table) -> pa.Table:
        batch = batch.combine_chunks()
        # the same text under the same id may have come more than once: one row for each side is enough
        _, order = np.unique(np.stack([batch.column("x").to_numpy(), batch.column("side").to_numpy()]), axis=1, return_index=True)
        xs = batch.column("x").to_numpy()[order]
        side = batch.column("side").to_numpy()[order]
        label = batch.column("label").to_numpy()[order]
        full = batch.column("full")
        sets = [np.frombuffer(full[int(i)].as_buffer(), np.int64) for i in order]
        at = np.arange(len(xs))
        rows, cols = (at[side == 1], at[side == 0]) if two_sided else (at, at)
        links = link_block(sets, rows, cols, label, k, percent) if len(rows) and len(cols) else []
        return pa.table({"a": pa.array([int(xs[i]) for i, _ in links], pa.int64()), "b": pa.array([int(xs[j]) for _, j in links], pa.int64())})

    return members.join(sets, "x").groupBy("hub", "block").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, k: int = 64, block_rows: int = 512, block_shingles: int = 400_000, broadcast_rows: int = 500_000) -> DataFrame:
    """(doc_id, th, n_shingles, component_id, kept): kept where the document is its component's smallest id.

    A null, empty or blank text has no shingles and links with nothing; so does a row without an
    id, and it is kept. Repeated rows come back as often as they came; different texts under one id
    are documents of their own. th is xxhash64 of the text. An empty table gives an empty result.
    Extra columns are ignored. Links are exact on the full sets: 100 * shared >= percent * united.
    """
    if k * percent < 1600:
        raise ValueError("k * percent must be 1600 at least")
    sk = written(written(sketches(docs, doc_id, text, width, k)).withColumn("x", F.monotonically_increasing_id()))
    some = sk.where("n_shingles > 0 and doc_id is not null")
    classes = written(some.groupBy("sig").agg(F.min(F.struct("doc_id", "x", "th")).alias("r")).select("sig", "r.doc_id", "r.x", "r.th"))
    held = some.join(small(classes.select("x"), broadcast_rows), "x", "left_semi").select("x", F.col("n_shingles").alias("n"), F.explode("sketch").alias("v"))
    often = held.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    mine = F.least(F.col("n"), F.lit(k))
    need = F.when(F.col("n") * 100 <= k * percent, F.ceil(F.col("n") * percent / 100)).otherwise(F.lit(k * percent // 160))
    prefix = (
        held.join(often, "v")
        .groupBy("x", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("shared"), F.sum("df").alias("typical"))
        # values of one document alone are the rarest: they take their places in the prefix first
        .withColumn("room", (F.size("shared") - need + 1).cast("int"))
        .where("room > 0")
        .select("x", "n", "typical", F.explode(F.slice("shared", F.lit(1), F.col("room"))).alias("p"))
        .select("x", "n", "typical", F.col("p.v").alias("v"))
    )
    prefix = written(prefix)
    hubs = prefix.groupBy("v").agg(F.max(F.struct("typical", (-F.col("x")).alias("y"))).alias("h"), F.count("*").alias("c")).where("c > 1")
    members = written(prefix.join(hubs.select("v", (-F.col("h.y")).alias("hub")), "v").select("hub", "x", "n").distinct())
    sums = members.groupBy("hub").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    sums = written(sums.select("hub", F.greatest(F.ceil(F.col("rows") / block_rows), F.ceil(F.col("shingles") / block_shingles)).cast("int").alias("blocks")))
    # a row for each hub: broadcast where they are few, so that a large hub's members are not dealt by hub
    dealt = members.join(small(sums, broadcast_rows), "hub").withColumn("block", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
    dealt = written(dealt)
    asked = written(members.select("x").distinct().join(classes.select("x", "doc_id", "th"), "x"))
    asked = small(asked, broadcast_rows)  # 24 bytes a row; beyond that the texts are shuffled
    sets = written(_sets(_keyed(docs, doc_id, text).join(asked, ["doc_id", "th"]), width))
    # first pass: each block with its hub
    alone = dealt.where("x <> hub").select("hub", "block", "x").unionByName(sums.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("hub").alias("x")))
    alone = small(written(alone.withColumn("side", F.lit(0)).withColumn("label", F.col("x"))), broadcast_rows)
    found = written(_blocks(alone, sets, k, percent, False))
    if sums.where("blocks > 1").limit(1).count():
        near = components(found, "a", "b").withColumnRenamed("node", "x")
        known = written(dealt.where("blocks > 1").join(near, "x", "left").withColumn("label", F.coalesce("component", "x")))
        middle = small(written(known.where("x = hub").select("hub", F.col("label").alias("main"))), broadcast_rows)
        known = written(known.join(middle, "hub").select("hub", "x", "block", "blocks", "label", (F.col("label") != F.col("main")).alias("outside")))
        others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        # members outside the hub's component meet all members of every other block; blocks without such members ask for none
        rows = known.where("outside").select("hub", F.col("block").alias("i"), others.alias("j"), "x", F.lit(1).alias("side"), "label")
        asking = small(written(known.where("outside").select("hub", F.col("block").alias("i")).distinct()), broadcast_rows)
        cols = known.join(asking, "hub").select("hub", "i", F.col("block").alias("j"), "x", F.lit(0).alias("side"), "label")
        both = rows.unionByName(cols).where("i <> j").withColumn("block", F.struct("i", "j"))
        found = found.unionByName(_blocks(both.select("hub", "block", "x", "side", "label"), sets, k, percent, True))
    near = components(found, "a", "b").withColumnRenamed("node", "x")
    # classes without a link are their own components
    linked = written(classes.select("x", "doc_id").join(near, "x"))
    least = small(written(linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))), broadcast_rows)
    where = classes.join(linked.join(least, "component").select("x", "component_id"), "x", "left").select("sig", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = sk.select("doc_id", "th", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("sig")).alias("sig")).join(where, "sig", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "th", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without the documents that have a smaller near-duplicate; all columns stay.

    Rows that repeat both id and text are one document and stay or go together; texts that repeat
    under different ids are not. Rows without an id stay.
    """
    name, text = options.get("doc_id", "doc_id"), options.get("text", "text")
    gone = written(near_duplicates(docs, **options).where("not kept").select(F.col("doc_id").alias("__gone"), F.col("th").alias("__th")).distinct())
    return docs.join(small(gone, 500_000), (F.col(name).cast("long") == F.col("__gone")) & (F.xxhash64(text) == F.col("__th")), "left_anti")
