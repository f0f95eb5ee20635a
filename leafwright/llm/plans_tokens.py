"""Queries of problems 7 and 8: containers and mixtures, measured in tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.llm import mixing, packing, tokens
from leafwright.storage import table, written

CAPACITY = 4096


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.with_token_counts(table(spark, sf_dir, "documents"))
    return written(counted.withColumnsRenamed({"doc_id": "item", "n_tokens": "size"}), "sizes")


def _by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(tokens.with_token_counts(table(spark, sf_dir, "documents"), keep=("doc_id", "source")), "sizes")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack(_sizes(spark, sf_dir), CAPACITY)
    return packing.divided_items(placed).withColumnRenamed("item", "doc_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(packing.pack(_sizes(spark, sf_dir), CAPACITY), CAPACITY)


def p7_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, and whether it stands in the containers whole and once, with no container over capacity."""
    sizes = _sizes(spark, sf_dir)
    return packing.kept_items(packing.pack(sizes, CAPACITY), sizes, CAPACITY).withColumnRenamed("item", "doc_id")


def _mixture(counted: DataFrame, sf_dir: str) -> DataFrame:
    plan = mixing.mixture_plan(counted, table(counted.sparkSession, sf_dir, "mix_targets"))
    return mixing.share_report(mixing.mixed(counted, plan), plan)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that are used up in the mixture and still have fewer tokens than their share."""
    return _mixture(_by_source(spark, sf_dir), sf_dir).where("falls_short").select("source")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(_by_source(spark, sf_dir), sf_dir)


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every target source, and whether the mixture keeps its cap and meets its share to one text, if it can."""
    counted = _by_source(spark, sf_dir)
    longest = counted.groupBy("source").agg(F.max("n_tokens").alias("longest"))
    targets = table(spark, sf_dir, "mix_targets").select("source", "max_repeats").join(longest, "source", "left")
    rows = _mixture(counted, sf_dir).join(targets, "source")
    met = F.col("falls_short") | (F.col("wanted") - F.col("tokens") < F.col("longest"))
    return rows.select("source", (met & (F.col("tokens") <= F.col("wanted")) & (F.col("most_repeats") <= F.col("max_repeats"))).alias("kept"))


def p8_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares by the fitted exponent alone, without targets, each source at most four times."""
    counted = _by_source(spark, sf_dir)
    plan = mixing.mixture_plan(counted)
    return mixing.share_report(mixing.mixed(counted, plan), plan)


def queries() -> dict:
    return {f.__name__: f for f in (p7_found, p7_fill, p7_kept, p8_found, p8_shares, p8_kept, p8_tempered)}


def oracle_sql() -> dict[str, str]:
    return {"p7_kept": "SELECT doc_id, true AS kept FROM documents", "p8_kept": "SELECT source, true AS kept FROM mix_targets"}
