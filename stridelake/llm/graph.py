"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import cut


def _mark(edges: DataFrame) -> tuple:
    """Row count and an order-free checksum: equal marks mean that a step changed nothing."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return joined.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node long, component long): the smallest node reachable, for every node of an edge.

    Self loops, repeated and reversed edges and nulls are allowed; rows with a null end are
    ignored, an empty table gives an empty result. No step gathers a node's neighbours: each is a
    minimum (pre-aggregated before its shuffle) and an equi-join that adaptive execution can split.
    The number of rounds grows with the logarithm of the longest path.
    """
    pair = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x is not null and y is not null and x <> y")
    now = cut(pair.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    before = _mark(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        now = cut(_small_star(_large_star(now)))
        after = _mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
