"""A corpus pipeline of five stages: score, rules, near duplicates, mixing, encoding.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written and read again as the next one's ``docs``. All but the last return the columns of
``docs``. Documents that the classifier or the rules reject go; of each group of near-duplicates the
smallest id stays; mixing drops or repeats documents until sources meet their targets; the last
stage gives token counts and digests for what is left, a row for each time a document is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stridelake.llm import minhash_dedup, piece_codec, quality_rank, robust_rules, source_mix
from stridelake.llm.common import small_batches, table, written
from stridelake.llm.queries import tokenizer_path

#: Fitted models and hashes cannot be written as SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rank.accept(docs, quality_rank.train(docs, table(spark, sf_dir, "labels")))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return robust_rules.accept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return minhash_dedup.drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return source_mix.apply(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return piece_codec.digests(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("rules", rules), ("near_duplicates", near_duplicates), ("mixing", mixing), ("encoding", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
