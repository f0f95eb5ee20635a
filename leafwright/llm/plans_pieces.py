"""Queries of problem 4: text regions cut into pieces under a limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.llm import pieces
from leafwright.storage import table

KEYS = ["page_id", "region_ord"]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.oversized_items(table(spark, sf_dir, "words"), KEYS)


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split_items(table(spark, sf_dir, "words"), KEYS).withColumn("n_chars", F.length("text"))


def p4_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions put together from their pieces, and whether all pieces keep the limit."""
    made = pieces.rejoined(pieces.split_items(table(spark, sf_dir, "words"), KEYS), KEYS)
    return made.select(*KEYS, "text", (F.col("longest") <= 1000).alias("within"))


def queries() -> dict:
    return {f.__name__: f for f in (p4_found, p4_pieces, p4_rejoined)}


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": """SELECT page_id, region_ord FROM (SELECT DISTINCT word_id, page_id, region_ord, text FROM words WHERE text IS NOT NULL)
            GROUP BY 1, 2 HAVING sum(length(text)) + count(*) - 1 > 1000""",
        "p4_rejoined": """SELECT page_id, region_ord, string_agg(text, ' ' ORDER BY line_ord NULLS FIRST, word_ord NULLS FIRST, word_id) AS text, true AS within
            FROM (SELECT DISTINCT word_id, page_id, region_ord, line_ord, word_ord, text FROM words WHERE text IS NOT NULL) GROUP BY 1, 2""",
    }
