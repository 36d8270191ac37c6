"""A setting that results depend on."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

_UNION = "spark.sql.unionOutputPartitioning"


def settle(spark: SparkSession) -> SparkSession:
    """Turns off the partitioning that unions claim in Spark 4.1.

    With adaptive execution, an aggregate over a union of equally partitioned inputs, joined with
    that union, came back with rows doubled (seen on 4.1.2, and right with this off).
    ``tests/test_oracles.py`` holds a query of that shape (``feature_array_full``).
    """
    try:
        on = spark.conf.get(_UNION)  # a default given here would hide the setting's own
    except PySparkException:  # other versions have no such setting
        return spark
    if on != "false":
        spark.conf.set(_UNION, "false")
    return spark
