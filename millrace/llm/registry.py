"""The operators' queries, by name, and the SQL that DuckDB checks them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import ann, decontam, langid, licenses, lm, neardup, pieces, pii, quality, store
from millrace.llm.common import table


def op1_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.op1(table(spark, sf_dir, "documents"))


def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), decontam.SHARE)


def op3_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.op3(table(spark, sf_dir, "embeddings"))


def op4_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op4(table(spark, sf_dir, "documents"))


def op5_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_sentencepiece_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.op6(table(spark, sf_dir, "documents"))


def op7_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.op7(table(spark, sf_dir, "documents"))


def op8_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op8(table(spark, sf_dir, "documents"))


def op9_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op9(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.op10(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hidden_markov": op1_hidden_markov,
    "op2_spaced_seeds": op2_spaced_seeds,
    "op3_one_bit_codes": op3_one_bit_codes,
    "op4_weak_supervision": op4_weak_supervision,
    "op5_license_rules": op5_license_rules,
    "op6_sentencepiece_rounds": op6_sentencepiece_rounds,
    "op7_hyperminhash": op7_hyperminhash,
    "op8_cross_parsing": op8_cross_parsing,
    "op9_quality_ftrl": op9_quality_ftrl,
    "op10_content_store": op10_content_store,
}

ORACLES: dict[str, str] = {"op5_license_rules": licenses.op5_sql()}
