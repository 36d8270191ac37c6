"""The supplied tables as motion data: SQL text for either engine, and tables as views of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stridelake.plans.session import settle

#: Names of the tables that the roles read.
TABLES = ("events", "embeddings", "orders", "lineitem", "nation", "part", "supplier")


def load(spark: SparkSession, sf_dir: str, names: set[str]) -> dict[str, DataFrame]:
    settle(spark)
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in sorted(names)}


def _table(name: str, duck: bool) -> str:
    return name if duck else "{" + name + "}"


def numbered(src: str, order: str, columns: str) -> str:
    """Frames numbered by an order within clips. The clip is named before the window, so that its exchange serves
    the windows of the operators above too."""
    return f"SELECT clip, CAST(row_number() OVER (PARTITION BY clip ORDER BY {order}) - 1 AS BIGINT) AS frame, {columns} FROM ({src})"


def trajectory(duck: bool) -> str:
    """events as clips: (clip, frame, v, x, y, z); x is the value, y the number in props, z the minute of the hour."""
    k = "json_extract_string(props, '$.k')" if duck else "get_json_object(props, '$.k')"
    src = f"SELECT user_id AS clip, ts, event_id, value AS v, value AS x, CAST({k} AS DOUBLE) AS y, CAST(minute(ts) * 60 + second(ts) AS DOUBLE) / 60.0 AS z FROM {_table('events', duck)}"
    return numbered(src, "ts, event_id", "v, x, y, z")


def signal(duck: bool) -> str:
    """events as one column: (clip, frame, v); y and z are not read from the scan."""
    return numbered(f"SELECT user_id AS clip, ts, event_id, value AS v FROM {_table('events', duck)}", "ts, event_id", "v")


def wave(duck: bool) -> str:
    """embeddings as signals of 64 samples: (clip, frame, v)."""
    if duck:
        return "SELECT vec_id AS clip, CAST(i AS BIGINT) AS frame, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(64)) AS i)"
    return "SELECT vec_id AS clip, CAST(i AS BIGINT) AS frame, CAST(e AS DOUBLE) AS v FROM (SELECT vec_id, posexplode(embedding) AS (i, e) FROM {embeddings})"


def pose(duck: bool, nodes: int = 21) -> str:
    """embeddings as poses: clip is the label, frames in order of id, a node is three values, in tenths."""
    at = lambda c: f"CAST(embedding[3 * n + {c + (1 if duck else 0)}] AS DOUBLE) * 10.0"
    frames = numbered(f"SELECT label AS clip, vec_id, embedding FROM {_table('embeddings', duck)}", "vec_id", "embedding")
    each = f"SELECT clip, frame, embedding, {f'unnest(range({nodes}))' if duck else f'explode(sequence(0, {nodes - 1}))'} AS n FROM ({frames})"
    return f"SELECT clip, frame, CAST(n AS INT) AS node, {at(0)} AS x, {at(1)} AS y, {at(2)} AS z FROM ({each})"


def rows(duck: bool, n: int = 32) -> str:
    """embeddings as rows of n numbers: (clip, e0, e1, ...) scaled so that angles have a size."""
    cols = ", ".join(f"CAST(embedding[{i + (1 if duck else 0)}] AS DOUBLE) * 5.0 AS e{i}" for i in range(n))
    return f"SELECT vec_id AS clip, {cols} FROM {_table('embeddings', duck)}"


def turning(duck: bool) -> str:
    """embeddings as sequences of quaternions: (clip, frame, e0 .. e3), clip is the label."""
    cols = ", ".join(f"CAST(embedding[{i + (1 if duck else 0)}] AS DOUBLE) * 5.0 AS e{i}" for i in range(4))
    return numbered(f"SELECT label AS clip, vec_id, {cols} FROM {_table('embeddings', duck)}", "vec_id", ", ".join(f"e{i}" for i in range(4)))
