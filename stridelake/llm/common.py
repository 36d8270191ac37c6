"""What the training-data operators share: table access, the shared folder, text kernels."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.plans.session import settle

#: Characters that part words: space and U+0009 to U+000D. ``bytes.split()`` uses the same six.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most ``rows`` rows in an Arrow batch: whole texts pass through buffers of a few megabytes, in the JVM and in Python."""
    settle(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none (local tests), a temporary folder of this machine
    takes its place, which is right only because all tasks run in one process there.
    """
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="stridelake-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    known = f"file://{folder}"
    spark.sparkContext.setCheckpointDir(known)
    spark.conf.set("spark.checkpoint.dir", known)
    return known


_MARKED: set[str] = set()


def work_dir(spark: SparkSession) -> str:
    """The part of the shared folder for this application's intermediate tables; it goes when the application ends."""
    path = f"{shared_dir(spark)}/stridelake/{spark.sparkContext.applicationId}"
    if path not in _MARKED:
        _MARKED.add(path)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(place)
        files.deleteOnExit(place)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the shared folder; its lineage ends there."""
    spark = settle(df.sparkSession)
    shared_dir(spark)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: columnar, with sizes that the planner sees."""
    spark = settle(df.sparkSession)
    path = f"{work_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def as_bytes(df: DataFrame, text: str = "text") -> DataFrame:
    """The text column as UTF-8 bytes (null: empty), so that Python kernels skip decoding."""
    return df.withColumn(text, F.coalesce(F.col(text), F.lit("")).cast("binary"))


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (a stored table of narrow rows) marked for broadcast if it has ``rows`` rows at most, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
