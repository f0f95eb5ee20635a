"""Page and book scores, comparisons of two sets of scores, viewer views and page features, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright import corpus
from leafwright.functions import numeric as nm
from leafwright.operators import features, statistics
from leafwright.plans.perplexity import BOOK, r6, r10
from leafwright.storage import table



def _pages(words: DataFrame) -> DataFrame:
    return words.groupBy("page_id").agg(F.max("book_id").alias("book_id"))


def _word_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of pages from their words' error types: the second rater beside ``page_scores``."""
    words = corpus.words(spark, sf_dir)
    return statistics.page_error_scores(words, _pages(words), corpus.error_type(F.col("error_type")) != "none")


def page_error_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _word_scores(spark, sf_dir).select("page_id", "errors", "total", r6(F.col("score")).alias("score"))


def record_page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of nested page records: the overwriting value unless unset, else errors by words; pages without words stay."""
    from leafwright.operators import nested

    records = nested.latest_records(table(spark, sf_dir, "page_records"), "page_id")
    words = nested.shred(records, "page_id", "text_regions")["text_regions.lines.words"].where("not is_null")
    scores = statistics.page_error_scores(words, records.select("page_id", "overwrite_page_error"), corpus.error_type(F.col("error_type")) != "none", "overwrite_page_error")
    return scores.select("page_id", "errors", "total", r6(F.col("score")).alias("score"))


def book_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = statistics.book_summary(corpus.page_scores(spark, sf_dir))
    return book.select("book_id", "num_pages", *[r10(F.col(c)).alias(c) for c in ("mean_score", "median_score", "best_score", "worst_score")], "best_page_id", "worst_page_id")


def book_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = corpus.page_scores(spark, sf_dir)
    return scores.rollup("book_id").agg(F.count("score").alias("n"), r10(F.avg("score")).alias("mean")).select("book_id", "n", "mean")


def page_scores_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid page scores, worst first, with their rank in the book."""
    from pyspark.sql import Window

    by = Window.partitionBy("book_id").orderBy(F.desc("score"), "page_id")
    return corpus.page_scores(spark, sf_dir).where("score is not null").select("book_id", "page_id", "score", F.row_number().over(by).alias("rank")).orderBy("book_id", "rank")


def paired_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = statistics.paired_statistics(corpus.page_scores(spark, sf_dir), _word_scores(spark, sf_dir))
    return stats.select("n", *[r6(F.col(c)).alias(c) for c in stats.columns if c != "n"])


def paired_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = statistics.with_p_values(statistics.paired_statistics(corpus.page_scores(spark, sf_dir), _word_scores(spark, sf_dir)))
    return stats.select("n", *[r6(F.col(c)).alias(c) for c in ("pearson", "pearson_p", "spearman", "spearman_p")])


def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = corpus.page_scores(spark, sf_dir).where("score is not null")
    return statistics.average_rank(scores, "score", "rank").select("page_id", r6(F.col("rank")).alias("rank"))


def top_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five pages on which two raters differ most (a report of five rows)."""
    pairs = statistics.paired(corpus.page_scores(spark, sf_dir), _word_scores(spark, sf_dir))
    return pairs.select("page_id", r10(F.abs(F.col("a") - F.col("b"))).alias("difference")).orderBy(F.desc("difference"), "page_id").limit(5)


def score_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both scores of a book's pages in the order of the first, as the overlay plot draws them."""
    from pyspark.sql import Window

    pairs = statistics.paired(corpus.page_scores(spark, sf_dir), _word_scores(spark, sf_dir)).join(corpus.page_scores(spark, sf_dir).select("page_id", "book_id"), "page_id")
    by = Window.partitionBy("book_id").orderBy("a", "page_id")
    return pairs.select("book_id", (F.row_number().over(by) - 1).alias("x"), "page_id", r6(F.col("a")).alias("a"), r6(F.col("b")).alias("b"))


def describe_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = statistics.described(corpus.page_scores(spark, sf_dir), "score", ["book_id"])
    return d.select("book_id", "n", *[r10(F.col(c)).alias(c) for c in ("mean", "median", "stdev", "min", "max")])


def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = statistics.moving_average(corpus.page_scores(spark, sf_dir).where("score is not null"), ["book_id"], "page_id", "score", 5)
    return made.select("book_id", "page_id", r10(F.col("moving_average")).alias("moving_average"))


def common_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are scored, have words and have perplexities; and those of them without a valid score."""
    scored = corpus.page_scores(spark, sf_dir)
    both = scored.select("page_id").intersect(corpus.words(spark, sf_dir).select("page_id")).intersect(table(spark, sf_dir, "chunk_pages").select("page_id"))
    return both.join(scored.select("page_id", F.col("score").isNull().alias("unscored")), "page_id")


def unprocessed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' pages without a score from before the last day of scoring: what that day's run had to do."""
    docs = table(spark, sf_dir, "documents").where("page_id is not null").select("page_id").distinct()
    scores = table(spark, sf_dir, "page_scores").select("page_id", F.to_date("scored_at").alias("day"))
    last = scores.agg(F.max("day").alias("last"))
    return docs.join(scores.crossJoin(F.broadcast(last)).where("day < last").select("page_id"), "page_id", "left_anti")


#: Methods a viewer may ask for, each a function that gives page_id, book_id and score.
METHODS = {"scores": corpus.page_scores, "words": lambda spark, sf_dir: _word_scores(spark, sf_dir).join(_pages(corpus.words(spark, sf_dir)), "page_id")}


def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = corpus.page_scores(spark, sf_dir).where("score is not null")
    return scores.groupBy(F.least(F.floor(F.col("score") * 20), F.lit(19)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def quality_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.round(1 - F.col("score"), 9)
    rows = corpus.page_scores(spark, sf_dir).where("score is not null")
    return rows.select("page_id", nm.quality_sidebar(good).alias("sidebar"), nm.quality_panel(good).alias("panel"), nm.quality_dot(good).alias("dot"), (nm.ramp(F.col("score"))["r"]).alias("red"), (nm.ramp(F.col("score"))["g"]).alias("green"))


def line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean word score of a line (1.0 if none is scored) and the class of its labels."""
    words = corpus.words(spark, sf_dir)
    bad = corpus.error_type(F.col("error_type")) != "none"
    g = words.groupBy("page_id", "region_ord", "line_ord").agg(F.coalesce(F.avg("word_error_score"), F.lit(1.0)).alias("score"), F.bool_or(bad).alias("any_bad"))
    return g.select("page_id", "region_ord", "line_ord", r6(F.col("score")).alias("score"), F.when(F.col("any_bad"), "red").otherwise("green").alias("line_class"))


def line_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line's worst word verdict set on all its words."""
    words = corpus.words(spark, sf_dir)
    verdict = words.groupBy("page_id", "region_ord", "line_ord").agg(F.max(F.coalesce("word_error_score", F.lit(0.0))).alias("score"))
    return words.select("word_id", "page_id", "region_ord", "line_ord").join(verdict, ["page_id", "region_ord", "line_ord"]).select("word_id", "score", F.when(F.col("score") > 0.5, "error").otherwise("none").alias("error_type"))


def viewer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: words by blanks, words in error, overall score (not clamped; 1.0 without words) and lines with several errors."""
    words = corpus.words(spark, sf_dir)
    bad = (F.col("error_type") == "error") | (F.coalesce("word_error_score", F.lit(0.0)) > 0.5)
    line = words.groupBy("page_id", "region_ord", "line_ord").agg(F.count(F.when(F.coalesce("text", F.lit("")) != "", 1)).alias("w"), F.sum(F.coalesce(bad, F.lit(False)).cast("int")).alias("e"))
    page = line.groupBy("page_id").agg(F.sum("w").alias("word_count"), F.sum("e").alias("error_count"), F.sum((F.col("e") > 1).cast("int")).alias("problem_lines"))
    return page.select("page_id", "word_count", "error_count", "problem_lines", F.when(F.col("word_count") > 0, r6(1 - F.col("error_count") / F.col("word_count"))).otherwise(1.0).alias("overall_score"))


def page_view(spark: SparkSession, sf_dir: str, method: str = "scores") -> DataFrame:
    """One record per page as a viewer lists it: statistics, score, quality, and the neighbours in the book (around its ends).

    ``method`` is one of ``METHODS``; any other is refused.
    """
    from pyspark.sql import Window

    if method not in METHODS:
        raise ValueError(f"unknown method {method}; known: {', '.join(METHODS)}")
    scored = METHODS[method](spark, sf_dir).select("page_id", "book_id", "score")
    stats = viewer_stats(spark, sf_dir).join(scored, "page_id", "left")
    by = Window.partitionBy("book_id").orderBy("page_id")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    quality = F.coalesce(F.round(1 - F.col("score"), 6), F.col("overall_score"), F.lit(0.0))
    return stats.select("book_id", "page_id", "word_count", "error_count", quality.alias("quality"), F.coalesce(F.lead("page_id").over(by), F.first("page_id").over(whole)).alias("next_page"), F.coalesce(F.lag("page_id").over(by), F.last("page_id").over(whole)).alias("previous_page"))


def page_view_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view by the second method: pages rated by their words' error types."""
    return page_view(spark, sf_dir, "words")


def page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that documents name, looked up by id in the view; unknown ones are told."""
    asked = table(spark, sf_dir, "documents").where("page_id is not null").select("page_id").distinct()
    view = page_view(spark, sf_dir).select("page_id", "book_id", "quality", F.lit(True).alias("known"))
    return asked.join(view, "page_id", "left").select("page_id", "book_id", r6(F.col("quality")).alias("quality"), F.coalesce("known", F.lit(False)).alias("known"))


def supervised_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.page_scores(spark, sf_dir).where("score is not null")
    return rows.select("page_id", r6(F.least(F.greatest(1 - F.col("score"), F.lit(0.0)), F.lit(1.0))).alias("overall_score"), (F.col("score") > 0.5).alias("problematic"))


def page_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = features.page_features(corpus.words(spark, sf_dir))
    return made.select("page_id", *[r6(F.col(c)).alias(c) for c in features.FEATURES])


def region_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions by type as the layout reader and as the reader of scored files take it."""
    regions = corpus.words(spark, sf_dir).select("page_id", "region_ord", "region_type").distinct()
    return regions.groupBy(corpus.raw_region_type(F.col("region_type")).alias("raw_type"), corpus.annotated_region_type(F.col("region_type")).alias("annotated_type")).agg(F.count("*").alias("n"))


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.lines(corpus.words(spark, sf_dir)).select("page_id", "region_ord", "line_ord", "n_words", "text")


def previous_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with the line before it in its region, and its first 50 characters."""
    from pyspark.sql import Window

    rows = corpus.lines(corpus.words(spark, sf_dir))
    by = Window.partitionBy("page_id", "region_ord").orderBy("line_ord")
    return rows.select("page_id", "region_ord", "line_ord", F.coalesce(F.lag("text").over(by), F.lit("")).alias("previous"), F.substring("text", 1, 50).alias("context"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.lines(corpus.words(spark, sf_dir)).where("text <> ''")
    item = F.struct("region_ord", "line_ord", "text")
    return rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]), " ").alias("text"))


def book_scores_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a book's pages as one JSON array, sorted by page."""
    item = F.struct("page_id", F.coalesce(F.col("score").cast("decimal(20,6)").cast("string"), F.lit("null")).alias("score"))
    rows = corpus.page_scores(spark, sf_dir).groupBy("book_id").agg(F.array_sort(F.collect_list(item)).alias("p"))
    return rows.select("book_id", F.array_join(F.transform("p", lambda x: F.concat_ws("=", x["page_id"], x["score"])), ",").alias("pages"))


def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values read out of JSON text, with tolerant casts."""
    rows = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("int")
    return rows.groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), r6(F.avg("value")).alias("mean_value"))


def queries() -> dict:
    names = (page_error_scores, record_page_scores, book_summary, book_rollup, page_scores_sorted, paired_stats, paired_p_values, average_ranks, top_differences, score_overlay, describe_scores, moving_average, common_pages, unprocessed_pages, score_histogram, quality_class, line_scores, line_verdicts, viewer_stats, page_view, page_view_words, page_lookup, supervised_stats, page_features, region_types, page_lines, previous_lines, page_texts, book_scores_nested, event_properties)
    return {f.__name__: f for f in names}


KIND = "CASE WHEN lower(coalesce(error_type, '')) IN ('ocr', 'spelling', 'hallucination', 'missing', 'error', 'merge') THEN 1 ELSE 0 END"
SECOND = f"{corpus.WORDS_SQL}, b AS (SELECT page_id, sum({KIND})::BIGINT AS errors, count(*) AS total, sum({KIND})::DOUBLE / count(*) AS score FROM w GROUP BY 1)"
PAIRS = f"{corpus.SCORES_SQL}, {SECOND}, pr AS (SELECT page_id, book_id, s.score AS a, b.score AS b FROM s JOIN b USING (page_id) WHERE s.score IS NOT NULL)"
TYPES = ", ".join(f"'{t}'" for t in corpus.REGION_TYPES)
LINE_BAD = "count(*) FILTER (error_type = 'error' OR coalesce(word_error_score, 0) > 0.5)"
VIEW = f"{corpus.WORDS_SQL}, ln AS (SELECT page_id, count(*) FILTER (coalesce(text, '') <> '') AS w, {LINE_BAD} AS e FROM w GROUP BY page_id, region_ord, line_ord), v AS (SELECT page_id, sum(w)::BIGINT AS word_count, sum(e)::BIGINT AS error_count, count(*) FILTER (e > 1) AS problem_lines FROM ln GROUP BY 1), vs AS (SELECT *, CASE WHEN word_count > 0 THEN round(1 - error_count::DOUBLE / word_count, 6) ELSE 1.0::DOUBLE END AS overall_score FROM v)"


def _rank(x: str) -> str:
    return f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2::DOUBLE"


def _tail(r: str) -> str:
    """The two-sided p of a correlation: the tail of its density from abs(r) to 1, by Simpson's rule over 200,000 steps."""
    u = f"(abs({r}) + (1 - abs({r})) * i / 200000::DOUBLE)"
    weight = "CASE WHEN i IN (0, 200000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    whole = "exp(lgamma(0.5) + lgamma(any_value(n) / 2::DOUBLE - 1) - lgamma(any_value(n) / 2::DOUBLE - 0.5))"
    return f"2 * sum({weight} * (greatest(1 - {u} * {u}, 0::DOUBLE)) ** (n / 2::DOUBLE - 2)) * (1 - abs(any_value({r}))) / 600000 / {whole}"


def _view(scores: str) -> str:
    return f"""SELECT book_id, page_id, word_count, error_count, coalesce(round(1 - score, 6), overall_score, 0) AS quality, coalesce(lead(page_id) OVER b, first_value(page_id) OVER a) AS next_page, coalesce(lag(page_id) OVER b, last_value(page_id) OVER a) AS previous_page
            FROM vs LEFT JOIN {scores} USING (page_id) WINDOW b AS (PARTITION BY book_id ORDER BY page_id), a AS (PARTITION BY book_id ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""


def _quality(cuts: tuple, names: tuple) -> str:
    return "CASE " + " ".join(f"WHEN g >= {c} THEN '{n}'" for c, n in zip(cuts, names[:-1], strict=True)) + f" ELSE '{names[-1]}' END"


def oracle_sql() -> dict[str, str]:
    s = corpus.SCORES_SQL
    return {
        "page_error_scores": f"WITH {SECOND} SELECT page_id, errors, total, round(score, 6) AS score FROM b",
        "record_page_scores": f"""WITH r AS (SELECT DISTINCT page_id, overwrite_page_error AS o, text_regions FROM page_records), a AS (SELECT page_id, unnest(text_regions) AS x FROM r), l AS (SELECT page_id, unnest(x.lines) AS x FROM a), q AS (SELECT page_id, unnest(x.words) AS x FROM l),
            c AS (SELECT page_id, sum({KIND.replace('error_type', 'x.error_type')})::BIGINT AS e, count(*) AS t FROM q WHERE x IS NOT NULL GROUP BY 1)
            SELECT page_id, coalesce(e, 0) AS errors, coalesce(t, 0) AS total, round(coalesce(CASE WHEN o <> -1 THEN o END, CASE WHEN coalesce(t, 0) > 0 THEN e::DOUBLE / t ELSE 0 END), 6)::DOUBLE AS score FROM r LEFT JOIN c USING (page_id)""",
        "book_summary": f"WITH {s} SELECT book_id, {BOOK} FROM s GROUP BY 1",
        "book_rollup": f"WITH {s} SELECT book_id, count(score) AS n, round(avg(score), 10) AS mean FROM s GROUP BY ROLLUP (book_id)",
        "page_scores_sorted": f"WITH {s} SELECT book_id, page_id, score, row_number() OVER (PARTITION BY book_id ORDER BY score DESC, page_id) AS rank FROM s WHERE score IS NOT NULL",
        "paired_stats": f"""WITH {PAIRS}, rk AS (SELECT *, {_rank('a')} AS ra, {_rank('b')} AS rb FROM pr)
            SELECT count(*) AS n, round(sqrt(avg((a - b) ** 2)), 6) AS rmse, round(avg(abs(a - b)), 6) AS mae, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b,
            (SELECT round(avg(score), 6) FROM s) AS whole_mean_a, (SELECT round(avg(score), 6) FROM b) AS whole_mean_b FROM rk""",
        "paired_p_values": f"""WITH {PAIRS}, rk AS (SELECT *, {_rank('a')} AS ra, {_rank('b')} AS rb FROM pr), st AS (SELECT count(*) AS n, corr(a, b) AS p, corr(ra, rb) AS s FROM rk), k AS (SELECT unnest(range(200001)) AS i)
            SELECT any_value(n) AS n, round(any_value(p), 6) AS pearson, round({_tail('p')}, 6) AS pearson_p, round(any_value(s), 6) AS spearman, round({_tail('s')}, 6) AS spearman_p FROM st, k""",
        "average_ranks": f"WITH {s} SELECT page_id, round({_rank('score')}, 6) AS rank FROM s WHERE score IS NOT NULL",
        "top_differences": f"WITH {PAIRS} SELECT page_id, round(abs(a - b), 10) AS difference FROM pr ORDER BY 2 DESC, 1 LIMIT 5",
        "score_overlay": f"WITH {PAIRS} SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY a, page_id) - 1 AS x, page_id, round(a, 6) AS a, round(b, 6) AS b FROM pr",
        "describe_scores": f"WITH {s} SELECT book_id, count(score) AS n, round(avg(score), 10) AS mean, round(median(score), 10) AS median, round(coalesce(stddev_samp(score), 0), 10) AS stdev, min(score) AS min, max(score) AS max FROM s WHERE score IS NOT NULL GROUP BY 1",
        "moving_average": f"""WITH {s}, m AS (SELECT book_id, page_id, avg(score) OVER w AS a, row_number() OVER (PARTITION BY book_id ORDER BY page_id) AS i FROM s WHERE score IS NOT NULL WINDOW w AS (PARTITION BY book_id ORDER BY page_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
            SELECT book_id, page_id, round(a, 10) AS moving_average FROM m WHERE i >= 5""",
        "common_pages": f"WITH {s} SELECT page_id, score IS NULL AS unscored FROM s WHERE page_id IN (SELECT page_id FROM words) AND page_id IN (SELECT page_id FROM chunk_pages)",
        "unprocessed_pages": "SELECT DISTINCT page_id FROM documents WHERE page_id IS NOT NULL AND page_id NOT IN (SELECT page_id FROM page_scores WHERE page_id IS NOT NULL AND scored_at::DATE < (SELECT max(scored_at)::DATE FROM page_scores))",
        "score_histogram": f"WITH {s} SELECT least(floor(score * 20), 19)::INTEGER AS bin, count(*) AS n FROM s WHERE score IS NOT NULL GROUP BY 1",
        "quality_class": f"""WITH {s}, v AS (SELECT page_id, round(1 - score, 9) AS g, least(greatest(score, 0), 1) AS c FROM s WHERE score IS NOT NULL)
            SELECT page_id, {_quality((.9, .7, .35), ('Good', 'Fair', 'Poor', 'Very Problematic'))} AS sidebar, {_quality((.9, .7, .5), ('Good', 'Fair', 'Poor', 'Very Problematic'))} AS panel, {_quality((.9, .8, .7), ('good', 'fair', 'poor', 'bad'))} AS dot,
            (CASE WHEN c <= 0.5 THEN floor(c * 2 * 255) ELSE 255 END)::INTEGER AS red, (CASE WHEN c <= 0.5 THEN 255 ELSE floor((1 - (c - 0.5::DOUBLE) * 2) * 255) END)::INTEGER AS green FROM v""",
        "line_scores": f"WITH {corpus.WORDS_SQL} SELECT page_id, region_ord, line_ord, round(coalesce(avg(word_error_score), 1), 6) AS score, CASE WHEN max({KIND}) = 1 THEN 'red' ELSE 'green' END AS line_class FROM w GROUP BY 1, 2, 3",
        "line_verdicts": f"""WITH {corpus.WORDS_SQL}, v AS (SELECT page_id, region_ord, line_ord, max(coalesce(word_error_score, 0)) AS score FROM w GROUP BY 1, 2, 3)
            SELECT word_id, score, CASE WHEN score > 0.5 THEN 'error' ELSE 'none' END AS error_type FROM w JOIN v USING (page_id, region_ord, line_ord)""",
        "viewer_stats": f"WITH {VIEW} SELECT page_id, word_count, error_count, problem_lines, overall_score FROM vs",
        "page_view": f"WITH {s}, {VIEW} {_view('s')}",
        "page_view_words": f"WITH {SECOND}, {VIEW.replace(corpus.WORDS_SQL + ', ', '')}, x AS (SELECT b.*, g.book_id FROM b JOIN (SELECT page_id, max(book_id) AS book_id FROM w GROUP BY 1) g USING (page_id)) {_view('x')}",
        "page_lookup": f"WITH {s}, {VIEW}, v2 AS ({_view('s')}) SELECT page_id, book_id, round(quality, 6) AS quality, v2.book_id IS NOT NULL OR quality IS NOT NULL AS known FROM (SELECT DISTINCT page_id FROM documents WHERE page_id IS NOT NULL) LEFT JOIN v2 USING (page_id)",
        "supervised_stats": f"WITH {s} SELECT page_id, round(least(greatest(1 - score, 0), 1), 6) AS overall_score, score > 0.5 AS problematic FROM s WHERE score IS NOT NULL",
        "page_features": f"""WITH {corpus.WORDS_SQL}, t AS (SELECT page_id, region_ord, line_ord, CASE WHEN coalesce(text, '') <> '' THEN text END AS t FROM w),
            ln AS (SELECT page_id, region_ord, line_ord, count(t) AS w, coalesce(sum(length(t)), 0) + greatest(count(t) - 1, 0) AS ch FROM t GROUP BY 1, 2, 3), rg AS (SELECT page_id, region_ord, count(*) AS l, sum(w) AS w FROM ln GROUP BY 1, 2),
            r AS (SELECT page_id, count(*) AS n, avg(l) AS a, var_pop(l) AS b, avg(w) AS c, var_pop(w) AS d, count(*) FILTER (w = 0) AS e FROM rg GROUP BY 1), l AS (SELECT page_id, count(*) AS n, max(ch) AS mx, avg(ch) AS a, var_pop(ch) AS v, count(*) FILTER (w = 0) AS e FROM ln GROUP BY 1),
            x AS (SELECT page_id, count(t) AS n, coalesce(avg(length(t)), 0) AS a, coalesce(avg(regexp_full_match(t, '\\p{{N}}+')::INTEGER), 0) AS nu, coalesce(avg(regexp_full_match(t, '[.,;:!?\\-]*')::INTEGER), 0) AS pu, coalesce(max(length(t)), 0) AS mx FROM t GROUP BY 1)
            SELECT page_id, r.n::DOUBLE AS n_regions, l.n::DOUBLE AS n_lines, x.n::DOUBLE AS n_words, round(x.a, 6) AS mean_word_len, round(r.a, 6) AS mean_lines_per_region, round(r.b, 6) AS var_lines_per_region, round(r.c, 6) AS mean_words_per_region, round(r.d, 6) AS var_words_per_region,
            l.mx::DOUBLE AS max_chars_per_line, round(l.a, 6) AS mean_chars_per_line, round(l.v, 6) AS var_chars_per_line, round(nu, 6) AS numeric_ratio, round(pu, 6) AS punct_ratio, x.mx::DOUBLE AS max_word_len, r.e::DOUBLE AS n_empty_regions, round(r.e::DOUBLE / r.n, 6) AS empty_region_share,
            l.e::DOUBLE AS n_empty_lines, round(l.e::DOUBLE / l.n, 6) AS empty_line_share FROM r JOIN l USING (page_id) JOIN x USING (page_id)""",
        "region_types": f"""WITH g AS (SELECT DISTINCT page_id, region_ord, region_type FROM words), v AS (SELECT lower(translate(coalesce(region_type, 'paragraph'), '- ', '__')) AS a, lower(coalesce(region_type, '')) AS b FROM g)
            SELECT CASE WHEN a IN ({TYPES}) THEN a ELSE 'other' END AS raw_type, CASE WHEN b IN ({TYPES}) THEN b ELSE 'other' END AS annotated_type, count(*) AS n FROM v GROUP BY 1, 2""",
        "page_lines": f"WITH {corpus.LINES_SQL} SELECT page_id, region_ord, line_ord, n_words, text FROM l",
        "previous_lines": f"WITH {corpus.LINES_SQL} SELECT page_id, region_ord, line_ord, coalesce(lag(text) OVER (PARTITION BY page_id, region_ord ORDER BY line_ord), '') AS previous, text[1:50] AS context FROM l",
        "page_texts": f"WITH {corpus.LINES_SQL} SELECT page_id, string_agg(text, ' ' ORDER BY region_ord, line_ord) AS text FROM l WHERE text <> '' GROUP BY 1",
        "book_scores_nested": f"WITH {s} SELECT book_id, string_agg(page_id || '=' || coalesce(score::DECIMAL(20,6)::VARCHAR, 'null'), ',' ORDER BY page_id) AS pages FROM s GROUP BY 1",
        "event_properties": "SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, round(avg(value), 6) AS mean_value FROM (SELECT *, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY 1",
    }
