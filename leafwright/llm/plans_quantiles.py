"""Queries of problem 2: percentiles of page scores and word perplexities per book."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.llm import quantiles as qs
from leafwright.storage import table, written

FIGURES = (("median_score", "score", 0.5), ("ppl_p50", "ppl", 0.5), ("ppl_p95", "ppl", 0.95))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "page_scores").withColumn("day", F.to_date("scored_at"))
    return qs.page_values(pages, F.array("score"), "score")


def _perplexities(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "chunk_pages").withColumn("day", F.col("run_date"))
    return qs.page_values(pages, F.col("word_smoothed_ppl_page"), "ppl")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "book_summaries")
    cases = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(f).alias("figure"), F.lit(q).alias("q"), F.col(f).alias("x")) for f, kind, q in FIGURES])
    figures = stored.select("book_id", F.inline(cases))
    return qs.off_figures(figures, _scores(spark, sf_dir).unionByName(_perplexities(spark, sf_dir)), (0.5, 0.95))


POINTS = (0.05, 0.25, 0.5, 0.75, 0.95)


def _name(q: float) -> str:
    return f"p{q * 100:g}".replace(".", "_")


def _merged(values: DataFrame) -> DataFrame:
    """Percentiles per book and kind from sketches of single days, merged."""
    daily = qs.sketches(values.select("kind", "book_id", "day", F.explode("vals").alias("v")), ["kind", "book_id", "day"], "v")
    books = qs.merged(daily, ["kind", "book_id"])
    return books.select("kind", "book_id", "n", *[qs.quantile(q).alias(_name(q)) for q in POINTS], F.lit(qs.rank_error(qs.K)).alias("rank_bound"))


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per book and kind, merged from sketches of single days: number of values, percentiles, rank bound."""
    return _merged(_scores(spark, sf_dir).unionByName(_perplexities(spark, sf_dir)))


def p2_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the percentiles of every book and kind lie within three times the rank bound, by counting its values."""
    values = written(_scores(spark, sf_dir).unionByName(_perplexities(spark, sf_dir)), "values")
    books = written(_merged(values), "percentiles")
    cases = F.array(*[F.struct(F.concat_ws(":", "kind", F.lit(_name(q))).alias("figure"), F.lit(q).alias("q"), F.col(_name(q)).alias("x")) for q in POINTS])
    off = qs.exactly_off(books.select("kind", "book_id", F.inline(cases)), values, 3 * qs.rank_error(qs.K))
    wrong = off.select("book_id", F.split("figure", ":")[0].alias("kind"), F.lit(True).alias("wrong")).distinct()
    return books.join(wrong, ["kind", "book_id"], "left").select("kind", "book_id", "n", F.col("wrong").isNull().alias("within"))


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_percentiles, p2_within)}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_within": """WITH v AS (SELECT DISTINCT 'score' AS kind, book_id, page_id, [score] AS vals FROM page_scores
              UNION ALL SELECT DISTINCT 'ppl', book_id, page_id, word_smoothed_ppl_page FROM chunk_pages)
            SELECT kind, book_id, count(*) AS n, true AS within FROM (SELECT kind, book_id, unnest(vals) AS x FROM v) WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY 1, 2""",
        "p2_found": """WITH v AS (SELECT DISTINCT 'score' AS kind, book_id, page_id, [score] AS vals FROM page_scores
              UNION ALL SELECT DISTINCT 'ppl', book_id, page_id, word_smoothed_ppl_page FROM chunk_pages),
            e AS (SELECT kind, book_id, x AS v FROM (SELECT kind, book_id, unnest(vals) AS x FROM v) WHERE x IS NOT NULL AND NOT isnan(x)),
            f AS (SELECT DISTINCT book_id, 'median_score' AS figure, 'score' AS kind, 0.5::DOUBLE AS q, median_score AS x FROM book_summaries
              UNION SELECT DISTINCT book_id, 'ppl_p50', 'ppl', 0.5::DOUBLE, ppl_p50 FROM book_summaries
              UNION SELECT DISTINCT book_id, 'ppl_p95', 'ppl', 0.95::DOUBLE, ppl_p95 FROM book_summaries),
            c AS (SELECT f.book_id, f.figure, f.q, f.x, count(*) AS n, count(*) FILTER (e.v < f.x) AS b, count(*) FILTER (e.v <= f.x) AS u
              FROM f JOIN e USING (kind, book_id) WHERE f.x IS NOT NULL AND NOT isnan(f.x) GROUP BY ALL)
            SELECT DISTINCT book_id, figure FROM c WHERE q < b::DOUBLE / n - 0.02 OR q > u::DOUBLE / n + 0.02""",
    }
