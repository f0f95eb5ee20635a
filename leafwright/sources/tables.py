"""Interchange files with explicit schemas, and their sinks. A missing file is simply no row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_WORDS = "word string, line_id string, paragraph_id string, word_position int, perplexity double, is_error boolean, page_id string"
CHUNK_PAGES = "page_id string, all_words_page array<string>, all_word_line_ids array<string>, word_smoothed_ppl_page array<double>, problematic_regions array<struct<type:string,start_idx:int,end_idx:int,words:array<string>,line_ids:array<string>>>"
LIKELIHOOD = "word string, logP_mean double, context string, start_char_orig int, end_char_orig int"
LIKELIHOOD_LINES = "word string, color string, line_id string"
LABELS = "file_id string, para_id string, line_id string, word string, label string"
ERROR_RATES = "file_id string, error_rate double"
PAGE_SCORES = "book_id string, page_id string, xml_path string, score double"
COLOURED = "Filename string, ColoredTextHTML string"
MANUAL = "error_ratio double"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Words such as NA, null or nan stay words: nothing is inferred and only empty fields are null."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").option("nanValue", "nan").option("escape", '"').csv(path)


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """An object or an array of objects per file, or one object per line; ``file`` is the file's stem."""
    rows = spark.read.schema(schema).option("multiLine", not lines).json(path)
    return rows.withColumn("file", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))


def error_rates(labels: DataFrame) -> DataFrame:
    """``file_id, error_rate``: the share of a page's labelled words that are errors."""
    return labels.groupBy("file_id").agg(F.avg((F.col("label") == "error").cast("double")).alias("error_rate"))


def features_with_rates(features: DataFrame, rates: DataFrame) -> DataFrame:
    """Pages that have both; a page that failed on either side is left out, so rows cannot shift."""
    return features.join(rates.withColumnRenamed("file_id", "page_id"), "page_id").na.drop(subset=["error_rate"])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).json(path)


def write_region_dump(regions: DataFrame, path: str) -> None:
    """Regions as text lines: type and polygon."""
    text = F.format_string("%s [Region %d] Type: %s Polygon: %s", "page_id", "region_ord", F.coalesce("region_type", F.lit("unknown")), F.coalesce("coords", F.lit("")))
    regions.select(text.alias("value")).write.mode("overwrite").text(path)
