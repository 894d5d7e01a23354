"""Queries of the operators over the whole of their tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from turnloom.llm import decontamination, fill_middle, license_rules, lloyd, mixing, mpeg_audio, repeats, secret_forest, sharding, simhash, token_orc, top_k, toxicity

#: Where the public tokenizers' files are; a parameter of the operator.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.digest(decontamination.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark")))


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(_table(spark, folder, "documents")))


def op3_token_orc(spark: SparkSession, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    return token_orc.tokenised(_table(spark, folder, "documents"), tokenizer)


def op4_mpeg_audio(spark: SparkSession, folder: str) -> DataFrame:
    return mpeg_audio.stored_features(_table(spark, folder, "documents"))


def op5_secret_forest(spark: SparkSession, folder: str) -> DataFrame:
    return secret_forest.digest(secret_forest.scanned(_table(spark, folder, "documents")))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.digest(mixing.mix(_table(spark, folder, "documents")))


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.digest(sharding.sharded(_table(spark, folder, "documents")))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op9_license_rules(spark: SparkSession, folder: str) -> DataFrame:
    return license_rules.digest(license_rules.scanned(_table(spark, folder, "documents")))


def op10_suffix_trees(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.digest(_table(spark, folder, "documents"))


def op11_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k.digest(top_k.nearest(_table(spark, folder, "embeddings")))


def op12_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_middle.digest(fill_middle.transformed(_table(spark, folder, "documents")))


def op13_lloyd(spark: SparkSession, folder: str) -> DataFrame:
    return lloyd.digest(lloyd.clustered(lloyd.quantised(_table(spark, folder, "embeddings"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_decontamination, op2_simhash, op3_token_orc, op4_mpeg_audio, op5_secret_forest, op6_mixing, op7_sharding, op8_toxicity, op9_license_rules, op10_suffix_trees,
        op11_top_k, op12_fill_middle, op13_lloyd,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """SQL cannot express the hashes, files, trained models and components of the other operators; tests hold them to brute force."""
    return {
        "op1_decontamination": decontamination.oracle_sql(), "op6_mixing": mixing.oracle_sql(),
        "op9_license_rules": license_rules.oracle_sql(), "op10_suffix_trees": repeats.oracle_sql(),
        "op11_top_k": top_k.oracle_sql(), "op12_fill_middle": fill_middle.oracle_sql(), "op13_lloyd": lloyd.oracle_sql(),
    }
