"""The scored books as flat tables: pages, regions, lines and words, each delivered row once."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.storage import table

#: Region and error types as written in page files.
REGION_TYPES = ("paragraph", "page_number", "header", "heading", "marginalia", "footnote", "other")
ERROR_TYPES = ("none", "ocr", "spelling", "hallucination", "missing", "error", "merge")


def once(df: DataFrame, *keys: str, apart: tuple[str, ...]) -> DataFrame:
    """Rows without repeats by their keys; rows that lack a key are told apart by the columns ``apart``.

    These are few, so that a query that needs few columns still reads few.
    """
    lacking = functools.reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    rest = {f"_apart_{c}": F.when(lacking, F.col(c)) for c in apart}
    return df.withColumns(rest).dropDuplicates([*keys, *rest]).drop(*rest)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in flat form; a word delivered twice (on the same page) counts once.

    Rows are brought together by page, which what follows groups, joins and orders by: no second shuffle.
    """
    return once(table(spark, sf_dir, "words").drop("loaded_at").repartition("page_id"), "page_id", "word_id", apart=("region_ord", "line_ord", "word_ord"))


def lines(words_: DataFrame) -> DataFrame:
    """``page_id, book_id, region_ord, line_ord, n_words, text``: words joined by blanks, in order."""
    item = F.struct("word_ord", "word_id", F.coalesce("text", F.lit("")).alias("text"))
    grouped = words_.groupBy("page_id", "region_ord", "line_ord").agg(F.max("book_id").alias("book_id"), F.array_sort(F.collect_list(item)).alias("w"), F.max("region_type").alias("region_type"))
    texts = F.filter(F.transform("w", lambda x: x["text"]), lambda t: t != "")
    return grouped.select("page_id", "book_id", "region_ord", "line_ord", "region_type", F.size(texts).alias("n_words"), F.array_join(texts, " ").alias("text"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, line_no, line`` of every document that has a text."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``book_id, page_id, score``: each page once, NaN as null."""
    rows = once(table(spark, sf_dir, "page_scores").drop("loaded_at"), "page_id", apart=("book_id", "xml_path", "score"))
    return rows.select("book_id", "page_id", "xml_path", F.nanvl("score", F.lit(None).cast("double")).alias("score"))


def scored_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``book_id, page_id, pos, word, line_id, ppl`` of every scored word of every page, each page once."""
    pages = once(table(spark, sf_dir, "chunk_pages").drop("loaded_at", "run_date"), "page_id", apart=("book_id", "word_smoothed_ppl_page"))
    zipped = F.arrays_zip(F.col("all_words_page").alias("word"), F.col("all_word_line_ids").alias("line_id"), F.col("word_smoothed_ppl_page").alias("ppl"))
    return pages.select("book_id", "page_id", F.posexplode(zipped).alias("pos", "w")).select("book_id", "page_id", "pos", "w.word", "w.line_id", "w.ppl")


def raw_region_type(value):
    """Region type as the layout reader takes it: hyphens and blanks as underscores; absent is a paragraph."""
    norm = F.lower(F.translate(F.coalesce(value, F.lit("paragraph")), "- ", "__"))
    return F.when(norm.isin(*REGION_TYPES), norm).otherwise("other")


def annotated_region_type(value):
    """Region type as the reader of scored files takes it: only the case is set aside; absent is other."""
    low = F.lower(F.coalesce(value, F.lit("")))
    return F.when(low.isin(*REGION_TYPES), low).otherwise("other")


def error_type(value):
    low = F.lower(F.coalesce(value, F.lit("")))
    return F.when(low.isin(*ERROR_TYPES), low).otherwise("none")


WORDS_SQL = "w AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM words)"
LINES_SQL = f"""{WORDS_SQL}, l AS (SELECT page_id, max(book_id) AS book_id, region_ord, line_ord, max(region_type) AS region_type, count(*) FILTER (text <> '') AS n_words,
  coalesce(string_agg(text, ' ' ORDER BY word_ord, word_id) FILTER (text <> ''), '') AS text FROM w GROUP BY page_id, region_ord, line_ord)"""
SCORES_SQL = "s AS (SELECT DISTINCT book_id, page_id, xml_path, CASE WHEN isnan(score) THEN NULL ELSE score END AS score FROM page_scores)"
PPL_SQL = """c AS (SELECT DISTINCT book_id, page_id, all_words_page AS ws, all_word_line_ids AS ls, word_smoothed_ppl_page AS ps FROM chunk_pages),
  i AS (SELECT *, unnest(range(greatest(coalesce(len(ws), 0), coalesce(len(ls), 0), coalesce(len(ps), 0)))) AS k FROM c WHERE ws IS NOT NULL AND ls IS NOT NULL AND ps IS NOT NULL),
  p AS (SELECT book_id, page_id, k::INTEGER AS pos, ws[k + 1] AS word, ls[k + 1] AS line_id, ps[k + 1] AS ppl FROM i)"""
DOC_LINES_SQL = "x AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, ls, unnest(range(len(ls)))::INTEGER AS line_no FROM x), d AS (SELECT doc_id, line_no, ls[line_no + 1] AS line FROM y)"
