"""Each query of the catalogue against DuckDB on the smallest tables: columns, types and values."""

import glob
import os

import duckdb
import pytest

from stridelake import catalog

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(rows):
    return sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_oracle(name, spark, duck, small):
    df = catalog.queries()[name](spark, small)
    cols = sorted(df.columns)
    sql = catalog.oracle_sql()[name]
    rel = duck.sql(sql)
    assert sorted(rel.columns) == cols
    assert {c: TYPES[t] for c, t in df.dtypes} == dict(zip(rel.columns, map(str, rel.types)))
    names = ", ".join(f'"{c}"' for c in cols)
    got, want = plain(df.select(*cols).collect()), plain(duck.sql(f"select {names} from ({sql})").fetchall())
    assert got and got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_queries_without_sql_run(name, spark, small):
    assert catalog.queries()[name](spark, small).count() > 0


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_scans_read_only_what_they_use(spark, small):
    plan = catalog.queries()["temporal_stats"](spark, small)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp" in plan.replace("timestamp_ntz", "timestamp") or "user_id" in plan
    assert "props" not in plan.split("== Physical Plan ==")[1]


@pytest.mark.parametrize("name", ["cov3dj", "lagged_covariance"])
def test_covariances_have_all_channels(name, spark, small):
    counts = catalog.queries()[name](spark, small).groupBy("clip").count().collect()
    assert counts and all(r["count"] == (3 * 21) ** 2 for r in counts)
