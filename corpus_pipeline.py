"""The corpus pipeline: stages that each take ``(spark, docs, sf_dir)`` and return a DataFrame.

Every stage but the last returns the columns of its input; each works on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewake import session
from tidewake.llm import decontamination, forest, language, packing, pii
from tidewake.llm.common import stored

LEAST_LANGUAGE_SCORE = 0.25


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those no language fits."""
    return language.in_a_language(docs, language.learned(docs), LEAST_LANGUAGE_SCORE)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every group of near-duplicates (five words, similarity of 0.8 or more)."""
    return forest.one_of_each(docs, words_per_shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = stored(decontamination.leaks(docs, items).select("doc_id"), "leaks")
    return forest.among(docs, found, how="left_anti")


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a placeholder in place of personal data."""
    return pii.masked(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches over all remaining documents."""
    return packing.assign_batches(docs)


STAGES = [("language ID", identify), ("near-dedup", deduplicate), ("decontamination", decontaminate), ("PII", mask),
          ("packing", pack)]
# Fitted models and signatures are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each to the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = session.scratch(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
