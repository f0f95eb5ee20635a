"""Queries of problem 3: words in one consistent spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.llm import looks
from leafwright.storage import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return looks.lookalikes(table(spark, sf_dir, "words"), table(spark, sf_dir, "lexicon"))


def p3_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word in its consistent spelling; each word once, words without an id once a text."""
    spelled = looks.with_plain_text(table(spark, sf_dir, "words").select("word_id", "text"), "text", ("word_id",))
    return spelled.distinct().select("word_id", F.col("plain").alias("text"))


def p3_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in its consistent spelling, blanks and line ends kept as one each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return looks.with_plain_text(docs, "text", ("doc_id",), blank=True).select("doc_id", F.col("plain").alias("text"))


def queries() -> dict:
    return {f.__name__: f for f in (p3_found, p3_plain, p3_texts)}


def oracle_sql() -> dict[str, str]:
    plain = looks.plain_sql("text")
    return {
        "p3_found": f"""WITH w AS (SELECT DISTINCT word_id, text FROM words WHERE text IS NOT NULL),
            c AS (SELECT word_id, {looks.core_sql(plain)} AS a, {looks.core_sql('text')} AS b FROM w)
            SELECT DISTINCT word_id, lex_id FROM c JOIN lexicon ON a = lower(word) WHERE a <> b""",
        "p3_plain": f"SELECT word_id, {plain} AS text FROM (SELECT DISTINCT word_id, text FROM words)",
        "p3_texts": f"SELECT doc_id, {looks.plain_sql('text', blank=True)} AS text FROM documents",
    }
