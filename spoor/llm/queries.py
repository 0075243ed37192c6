"""The corpus operators' queries: each applies its operator to a whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spoor.llm import decontamination, fill_in_middle, langid, lm, ngram_join, packing, pii, pipeline, quality, simhash, token_counts, token_files, toxicity, vector_codes
from spoor.llm.common import documents, scratch
from spoor.llm.encoder import vocabulary

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, so that every call does the whole work."""
    return token_counts.token_counts(documents(spark, sf_dir), vocabulary(), scratch(spark, "token-cache"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(documents(spark, sf_dir))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir), scratch(spark, "token-files"), vocabulary(), end_id=2)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(documents(spark, sf_dir))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.report(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary(), end_id=0)


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(documents(spark, sf_dir))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.report(documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    numbered = (op1_simhash, op2_pii, op3_token_counts, op4_quality, op5_token_files, op6_langid, op7_lm, op8_toxicity, op9_decontamination, op10_packing)
    return {"pipeline": pipeline.run} | {f.__name__: f for f in (*numbered, op11_ngram_join, op12_vector_codes, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    found = {"op4_quality": quality.SQL, "op9_decontamination": decontamination.SQL}
    return found | {"op12_vector_codes": vector_codes.SQL, "op13_fill_in_middle": fill_in_middle.SQL}
