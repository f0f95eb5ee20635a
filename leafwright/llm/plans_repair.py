"""Queries of problem 1: recognised pages repaired."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafwright.llm import repair
from leafwright.storage import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repairs(table(spark, sf_dir, "words"), table(spark, sf_dir, "lexicon")).select("word_id", "noise")


def p1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired_paragraphs(table(spark, sf_dir, "words"), table(spark, sf_dir, "lexicon"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_paragraphs)}


def oracle_sql() -> dict[str, str]:
    return {}
