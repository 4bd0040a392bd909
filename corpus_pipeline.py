"""Corpus pipeline: known language, one of each near-duplicate group, no benchmark passages, target mix of sources, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's docs. All
but the last return the columns of ``documents``. Rows with null ids, texts or sources pass as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from limnos.llm import decontaminate, language, mixing, near_dedup, sharding
from limnos.llm.spread import landed

#: Language ID has no SQL form. Tests compare stages with brute force one by one; no test does so for run() as a whole.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the filter has learned; texts that are null or hold no letter go."""
    return language.recognised(docs, language.build_filter(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates."""
    return near_dedup.one_of_each(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the schedule: sources at their target weights, and at those of the remaining ones when one runs out."""
    return mixing.mixed(docs, whole=True)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and place of every document of the mix; a shard keeps the order of the mix."""
    return sharding.shard(docs, in_order=True)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup_stage), ("decontaminate", decontaminate_stage), ("mixing", mixing_stage), ("sharding", sharding_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
