"""One registered query per corpus operator: the operator over its whole table, and what is derived."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake import session
from tidewake.llm import (
    decontamination, divergence, forest, language, maxscore, merkle, packing, permutation, pii, secret_scan, sharding, tokens,
    toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
# The first ten cannot be stated in SQL over whole tables; tests/llm holds them against brute force.
ORACLES: dict[str, str] = {
    "op11_slot_pivot_manifest": merkle.oracle(), "op12_maxscore": maxscore.ORACLE, "op13_cube_divergence": divergence.ORACLE}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predicted(docs, language.learned(docs))
    held_out = F.coalesce(language.remainder("doc_id", 4) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op3_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", packing.byte_length().alias("length"))
    return packing.assign_batches(docs, F.col("length"))


@query
def op4_spelling_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(language.remainder("doc_id", 5) == 0, F.lit(False))
    sample = toxicity.labelled(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.scored(docs, toxicity.fit(sample)).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op5_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = session.scratch(spark, "shards")
    docs = table(spark, sf_dir, "documents")
    sharding.write_shards(docs, path)
    written = spark.read.schema(sharding.written_schema(docs)).parquet(path)
    return written.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op6_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@query
def op8_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query
def op9_combined_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents")).drop("found")


@query
def op10_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "documents"), words_per_shingle=4, percent=80)


@query
def op11_slot_pivot_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


@query
def op12_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


@query
def op13_cube_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))
