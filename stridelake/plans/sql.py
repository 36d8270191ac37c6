"""SQL text that Spark and DuckDB both run, and how a DataFrame meets it.

Operators are functions from relations to SQL text. ``apply`` runs the text on a DataFrame, where
Catalyst plans it like any other; the same text over the supplied tables is what DuckDB checks.
Where the dialects differ, helpers take ``duck``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame

from stridelake.plans.session import settle


_NUMBER = re.compile(r"('(?:[^']|'')*')|(?<![\w.])(\d+\.\d+)(?![\w.])")


def spark_text(sql: str) -> str:
    """Numbers with a point as doubles: Spark would read them as decimals, which are slower and round."""
    return _NUMBER.sub(lambda m: m[1] or f"{m[2]}D", sql)


def apply(df: DataFrame, sql: str, **more: DataFrame) -> DataFrame:
    """``sql`` with ``{t}`` standing for ``df`` and other names in braces for other DataFrames."""
    return settle(df.sparkSession).sql(spark_text(sql), t=df, **more)


def stages(source: str, *steps: Mapping[str, str], keep: str = "*") -> str:
    """Nested projections: each step adds named expressions over the columns of the one before."""
    sql = source
    for step in steps:
        sql = f"SELECT {keep}, {', '.join(f'{e} AS {n}' for n, e in step.items())} FROM ({sql})"
    return sql


def rounded(expr: str, digits: int = 6) -> str:
    """Rounded, and with one zero only."""
    return f"(round({expr}, {digits}) + 0.0)"


def over(keys: str, order: str = "frame", frame: str = "") -> str:
    return f"OVER (PARTITION BY {keys} ORDER BY {order}{' ' + frame if frame else ''})"


def percentile(expr: str, p: float, duck: bool) -> str:
    return f"quantile_cont({expr}, {p})" if duck else f"percentile({expr}, {p})"


def median(expr: str, duck: bool) -> str:
    return percentile(expr, 0.5, duck)


def skewness(expr: str, duck: bool) -> str:
    """Population skewness; null without spread."""
    if not duck:
        return f"CASE WHEN stddev_pop({expr}) > 1e-12 THEN skewness({expr}) END"
    m, s = f"avg({expr})", f"stddev_pop({expr})"
    return f"CASE WHEN {s} > 1e-12 THEN (avg(({expr})*({expr})*({expr})) - 3*{m}*avg(({expr})*({expr})) + 2*{m}*{m}*{m}) / ({s}*{s}*{s}) END"


def kurtosis(expr: str, duck: bool) -> str:
    """Population excess kurtosis; null without spread."""
    return f"CASE WHEN stddev_pop({expr}) > 1e-12 THEN {'kurtosis_pop' if duck else 'kurtosis'}({expr}) END"


def numbers(lo: str, hi: str, name: str, duck: bool) -> str:
    """A select item with one row for each whole number from lo to hi."""
    return f"unnest(range(CAST({lo} AS BIGINT), CAST({hi} AS BIGINT) + 1)) AS {name}" if duck else f"explode(sequence(CAST({lo} AS BIGINT), CAST({hi} AS BIGINT))) AS {name}"


def last_known(expr: str, window: str, duck: bool) -> str:
    return f"last_value({expr} IGNORE NULLS) {window}" if duck else f"last_value({expr}) IGNORE NULLS {window}"


def first_known(expr: str, window: str, duck: bool) -> str:
    return f"first_value({expr} IGNORE NULLS) {window}" if duck else f"first_value({expr}) IGNORE NULLS {window}"


def joined_text(expr: str, order: str, duck: bool, sep: str = ",") -> str:
    """All values of a group as one text, in order of a whole-number key."""
    if duck:
        return f"string_agg({expr}, '{sep}' ORDER BY {order})"
    return f"concat_ws('{sep}', transform(array_sort(collect_list(struct({order} AS k, {expr} AS v))), p -> p.v))"


def names_of(sql: str) -> set[str]:
    """Names in braces that a text asks for."""
    return set(re.findall(r"\{([A-Za-z_]\w*)\}", sql))
