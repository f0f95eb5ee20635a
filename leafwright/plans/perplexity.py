"""Word windows, perplexities and log probabilities over the scored pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright import corpus
from leafwright.functions import numeric as nm
from leafwright.functions import text as tx
from leafwright.operators import chunks, language, statistics
from leafwright.operators.percentiles import percentiles
from leafwright.storage import bounded_rows, table, written

SIZE, OVERLAP = 20, 10


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


def r10(c):
    """For means and medians of scores of six decimals: no tie is rounded."""
    return F.round(c, 10) + F.lit(0.0)


def _page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their words as an array, in order."""
    item = F.struct("region_ord", "line_ord", "word_ord", "word_id", F.lower("text").alias("word"))
    words = corpus.words(spark, sf_dir).where(F.coalesce("text", F.lit("")) != "")
    return words.groupBy("page_id").agg(F.max("book_id").alias("book_id"), F.transform(F.array_sort(F.collect_list(item)), lambda x: x["word"]).alias("words"))


def word_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunks.word_chunks(_page_words(spark, sf_dir), ["page_id"], "words", SIZE, OVERLAP)
    return made.select("page_id", "chunk_id", "start_word_id", "end_word_id", F.array_join("words", " ").alias("chunk"))


def _page_logp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, book_id, lp``: the log probabilities of a page's words as an array, in order."""
    pages = written(_page_words(spark, sf_dir), "page_words")  # the model and the pages both read it
    model = written(language.unigrams(pages.select(F.explode("words").alias("word"))), "model")
    return language.page_logp(pages, ["page_id", "book_id"], "words", model)


def chunk_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunks.word_chunks(_page_logp(spark, sf_dir), ["page_id"], "lp", SIZE, OVERLAP)
    return made.select("page_id", "chunk_id", r6(chunks.window_perplexity(F.col("words"))).alias("ppl"))


def smoothed_word_ppl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.smoothed(_page_logp(spark, sf_dir), ["page_id"], "lp", SIZE, OVERLAP).select("page_id", "word_id", r6(F.col("ppl")).alias("ppl"))


def page_error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows to word perplexities to errors above the quartile bound to page scores to book summaries."""
    smooth = chunks.smoothed(_page_logp(spark, sf_dir), ["page_id", "book_id"], "lp", SIZE, OVERLAP).withColumn("ppl", F.round("ppl", 6))
    smooth = written(smooth, "smooth")  # the bound and the judgement both read it
    bound = chunks.quartile_bound(smooth, "ppl").select(F.round("bound", 6).alias("bound"))
    judged = smooth.crossJoin(F.broadcast(bound))
    scores = judged.groupBy("book_id", "page_id").agg((F.sum((F.col("ppl") > F.col("bound")).cast("double")) / F.count("*")).alias("score"))
    book = statistics.book_summary(scores)
    return book.select("book_id", "num_pages", *[r10(F.col(c)).alias(c) for c in ("mean_score", "median_score", "best_score", "worst_score")], "best_page_id", "worst_page_id")


def error_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = corpus.scored_words(spark, sf_dir)
    found = chunks.islands(words, ["page_id"], "pos", F.coalesce(F.col("ppl"), F.lit(0.0)) > chunks.ERROR_PERPLEXITY, {"word": "words", "line_id": "line_ids"})
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x, F.lit("?"))), "|")
    return found.select("page_id", "start_idx", "end_idx", joined("words").alias("words"), joined("line_ids").alias("line_ids"))


def iqr_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.quartile_bound(corpus.scored_words(spark, sf_dir), "ppl").select(*[r6(F.col(c)).alias(c) for c in ("q1", "q3", "bound")])


def anomaly_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.anomaly_threshold(corpus.scored_words(spark, sf_dir), "page_id", "ppl").select(*[r6(F.col(c)).alias(c) for c in ("q1", "q3", "bound")])


def anomaly_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = corpus.scored_words(spark, sf_dir).where("ppl is not null")
    q = chunks.quartile_bound(words, "ppl")
    scored = words.crossJoin(F.broadcast(q)).withColumn("anomaly", nm.anomaly(F.col("ppl"), F.col("q1"), F.col("q3")))
    return scored.groupBy("page_id").agg(r6(F.median("anomaly")).alias("median_anomaly"), r6(F.max("anomaly")).alias("max_anomaly"))


def ppl_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive perplexities, cut at the 99th percentile, in 40 bins of their binary logarithm."""
    words = corpus.scored_words(spark, sf_dir).where("ppl > 0")
    cut = percentiles(words, "ppl", {"p99": 0.99})
    kept = words.crossJoin(F.broadcast(cut)).select(F.log2(F.least("ppl", "p99")).alias("x"))
    return kept.groupBy(F.floor(F.round("x", 9) * 2).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def page_ppl_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = corpus.scored_words(spark, sf_dir).groupBy("page_id").agg(F.count("ppl").alias("n"), F.avg("ppl").alias("mean"), F.stddev_pop("ppl").alias("stdev"), F.max("ppl").alias("max"))
    return stats.select("page_id", "n", *[r6(F.col(c)).alias(c) for c in ("mean", "stdev", "max")])


def chunk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word scores by the sigmoid at 100; above one half is an error."""
    s = nm.sigmoid(F.col("ppl"))
    return corpus.scored_words(spark, sf_dir).where("ppl is not null").select("page_id", "pos", r6(s).alias("score"), F.when(s > 0.5, "error").otherwise("none").alias("error_type"))


def word_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = corpus.words(spark, sf_dir).where(F.coalesce("text", F.lit("")) != "").select("word_id", F.col("text").alias("word"))
    scored = language.with_logp(words, written(language.unigrams(words), "model"))
    return scored.select("word_id", r6(F.col("logp")).alias("logp"), tx.word_colour(F.round("logp", 6)).alias("colour"))


def token_logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every page text with their places and log probabilities, by a scorer that runs in Arrow batches."""
    pages = written(_page_words(spark, sf_dir), "page_words")
    model = language.unigrams(pages.select(F.explode("words").alias("word"))).select("word", "logp")
    rows = bounded_rows(model, language.MAX_WORDS, "the words of the model")
    scorer = spark.sparkContext.broadcast(language.UnigramScorer({r["word"]: r["logp"] for r in rows}))
    texts = pages.select("page_id", F.array_join("words", " ").alias("text"))
    made = language.token_scores(texts, ["page_id"], "text", scorer)
    return made.select("page_id", "pos", "token", "start_char", "end_char", r6(F.when(F.col("logp") > -20.0, F.col("logp"))).alias("logp"))


def page_readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readability of a page from the log probabilities of its words."""
    lp = F.round(-F.ln("ppl"), 6)
    words = corpus.scored_words(spark, sf_dir).where("ppl > 0").withColumn("lp", lp)
    stats = words.groupBy("page_id").agg(
        F.count("*").alias("n"), F.avg("lp").alias("mean_ll"), F.min("lp").alias("ll_min"), F.median("lp").alias("ll_median"), F.max("lp").alias("ll_max"),
        F.sum((F.col("lp") < -6.0).cast("bigint")).alias("low"), F.sum((F.col("lp") < -10.0).cast("bigint")).alias("critical"),
    )
    low, mean = F.round(F.col("low") / F.col("n") * 100, 6), F.round("mean_ll", 6)
    return stats.select("page_id", "n", mean.alias("mean_ll"), r6(F.exp(-F.round("mean_ll", 6))).alias("ppl"), "ll_min", r10(F.col("ll_median")).alias("ll_median"), "ll_max", "low", "critical", low.alias("low_percent"), nm.readability(F.round(F.exp(-mean), 6), mean, low, F.col("n")).alias("category"))


def error_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of low probability with three words on either side."""
    from pyspark.sql import Window

    words = corpus.scored_words(spark, sf_dir).where("word is not null and ppl > 0")
    around = Window.partitionBy("page_id").orderBy("pos").rowsBetween(-3, 3)
    seen = words.withColumn("context", F.array_join(F.collect_list("word").over(around), " "))
    return seen.where(F.round(-F.ln("ppl"), 6) < -6.0).select("page_id", "pos", "word", "context")


def likelihood_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page words that stand inside an unlikely word of the same line: 1.0 red, 0.5 orange, the first such word counts."""
    lp = F.round(-F.ln("ppl"), 6)
    errors = corpus.scored_words(spark, sf_dir).where("word is not null and ppl > 0").select("page_id", "line_id", F.col("pos").alias("err_pos"), F.col("word").alias("err_word"), tx.word_colour(lp).alias("colour")).where("colour <> 'lightgreen'")
    words = corpus.words(spark, sf_dir).where("text is not null").select("word_id", "page_id", "line_id", "text")
    hits = words.join(errors, ["page_id", "line_id"]).where(F.contains("err_word", "text"))
    first = hits.groupBy("word_id").agg(F.min_by("colour", "err_pos").alias("colour"))
    all_words = words.select("word_id").join(first, "word_id", "left")
    return all_words.select("word_id", F.when(F.col("colour").isin("red", "darkred"), 1.0).when(F.col("colour") == "orange", 0.5).otherwise(0.0).alias("score"), F.when(F.col("colour").isin("red", "darkred"), "error").otherwise("none").alias("error_type"))


def word_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last character of every word in its page text, words joined by blanks."""
    from pyspark.sql import Window

    words = corpus.scored_words(spark, sf_dir).where("word is not null")
    before = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0))
    return words.select("page_id", "pos", start.alias("start_char"), (start + F.length("word") - 1).alias("end_char"))


def queries() -> dict:
    names = (word_chunks, chunk_perplexity, smoothed_word_ppl, page_error_summary, error_islands, iqr_threshold, anomaly_threshold, anomaly_pages, ppl_histogram, page_ppl_stats, chunk_scores, word_logprob, page_readability, error_context, likelihood_score, word_span, token_logprobs)
    return {f.__name__: f for f in names}


PAGES = f"""{corpus.WORDS_SQL}, g AS (SELECT page_id, max(book_id) AS book_id, list(lower(text) ORDER BY region_ord, line_ord, word_ord, word_id) AS ws FROM w WHERE coalesce(text, '') <> '' GROUP BY 1),
  k AS (SELECT page_id, book_id, ws, unnest(range(CASE WHEN len(ws) <= {SIZE} THEN 1 ELSE ceil((len(ws) - {SIZE}) / {SIZE - OVERLAP}::DOUBLE)::BIGINT + 1 END)) AS c FROM g),
  ch AS (SELECT page_id, book_id, c::INTEGER AS chunk_id, (c * {SIZE - OVERLAP})::INTEGER AS s, (least(c * {SIZE - OVERLAP} + {SIZE}, len(ws)) - 1)::INTEGER AS e, ws[c * {SIZE - OVERLAP} + 1 : c * {SIZE - OVERLAP} + {SIZE}] AS ws FROM k)"""
MODEL = "u AS (SELECT lower(text) AS word, count(*) AS n FROM w WHERE coalesce(text, '') <> '' GROUP BY 1), m AS (SELECT word, ln((n + 1) / (SELECT sum(n) + count(*) FROM u)::DOUBLE) AS lp FROM u)"
CHUNK_PPL = f"{PAGES}, {MODEL}, cw AS (SELECT page_id, book_id, chunk_id, s, e, unnest(ws) AS word FROM ch), cp AS (SELECT page_id, book_id, chunk_id, s, e, exp(-sum(lp) / count(*)) AS ppl FROM cw JOIN m USING (word) GROUP BY ALL)"
SMOOTH = f"{CHUNK_PPL}, sw AS (SELECT page_id, book_id, unnest(range(s, e + 1))::INTEGER AS word_id, ppl FROM cp), sm AS (SELECT page_id, book_id, word_id, avg(ppl) AS ppl FROM sw GROUP BY ALL)"
QUART = "q AS (SELECT quantile_cont(ppl, 0.25) AS q1, quantile_cont(ppl, 0.75) AS q3 FROM p WHERE ppl IS NOT NULL)"
COLOUR = "CASE WHEN {0} < -10 THEN 'darkred' WHEN {0} < -5.5 THEN 'red' WHEN {0} < -3.5 THEN 'orange' ELSE 'lightgreen' END"
BOOK = """count(score) AS num_pages, round(avg(score), 10) AS mean_score, round(median(score), 10) AS median_score, round(min(score), 10) AS best_score, round(max(score), 10) AS worst_score,
  arg_min(page_id, {'s': score, 'p': page_id}) FILTER (score IS NOT NULL) AS best_page_id, arg_min(page_id, {'s': -score, 'p': page_id}) FILTER (score IS NOT NULL) AS worst_page_id"""


def oracle_sql() -> dict[str, str]:
    three = ", round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 + 1.5::DOUBLE * (q3 - q1), 6) AS bound".lstrip(", ")
    return {
        "word_chunks": f"WITH {PAGES} SELECT page_id, chunk_id, s AS start_word_id, e AS end_word_id, array_to_string(ws, ' ') AS chunk FROM ch",
        "chunk_perplexity": f"WITH {CHUNK_PPL} SELECT page_id, chunk_id, round(ppl, 6) AS ppl FROM cp",
        "smoothed_word_ppl": f"WITH {SMOOTH} SELECT page_id, word_id, round(ppl, 6) AS ppl FROM sm",
        "page_error_summary": f"""WITH {SMOOTH}, sr AS (SELECT page_id, book_id, word_id, round(ppl, 6) AS ppl FROM sm), q AS (SELECT quantile_cont(ppl, 0.25) AS q1, quantile_cont(ppl, 0.75) AS q3 FROM sr),
            b AS (SELECT round(q3 + 1.5::DOUBLE * (q3 - q1), 6) AS bound FROM q), sc AS (SELECT book_id, page_id, count(*) FILTER (ppl > bound)::DOUBLE / count(*) AS score FROM sr, b GROUP BY 1, 2)
            SELECT book_id, {BOOK} FROM sc GROUP BY 1""",
        "error_islands": f"""WITH {corpus.PPL_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM p), f AS (SELECT *, n - row_number() OVER (PARTITION BY page_id ORDER BY pos) AS run FROM a WHERE coalesce(ppl, 0) > 158)
            SELECT page_id, min(pos) AS start_idx, max(pos) AS end_idx, string_agg(coalesce(word, '?'), '|' ORDER BY pos) AS words, string_agg(coalesce(line_id, '?'), '|' ORDER BY pos) AS line_ids FROM f GROUP BY page_id, run""",
        "iqr_threshold": f"WITH {corpus.PPL_SQL}, {QUART} SELECT {three} FROM q",
        "anomaly_threshold": f"""WITH {corpus.PPL_SQL}, {QUART}, md AS (SELECT page_id FROM p, q WHERE ppl IS NOT NULL GROUP BY page_id HAVING median(greatest((ppl - q3) / (q3 - q1), 0::DOUBLE)) < 1.5),
            r AS (SELECT quantile_cont(ppl, 0.25) AS q1, quantile_cont(ppl, 0.75) AS q3 FROM p SEMI JOIN md USING (page_id) WHERE ppl IS NOT NULL) SELECT {three} FROM r""",
        "anomaly_pages": f"WITH {corpus.PPL_SQL}, {QUART}, s AS (SELECT page_id, greatest((ppl - q3) / (q3 - q1), 0::DOUBLE) AS a FROM p, q WHERE ppl IS NOT NULL) SELECT page_id, round(median(a), 6) AS median_anomaly, round(max(a), 6) AS max_anomaly FROM s GROUP BY 1",
        "ppl_histogram": f"WITH {corpus.PPL_SQL}, h AS (SELECT quantile_cont(ppl, 0.99) AS p99 FROM p WHERE ppl > 0) SELECT floor(round(log2(least(ppl, p99)), 9) * 2)::INTEGER AS bin, count(*) AS n FROM p, h WHERE ppl > 0 GROUP BY 1",
        "page_ppl_stats": f"WITH {corpus.PPL_SQL} SELECT page_id, count(ppl) AS n, round(avg(ppl), 6) AS mean, round(stddev_pop(ppl), 6) AS stdev, round(max(ppl), 6) AS max FROM p GROUP BY 1",
        "chunk_scores": f"WITH {corpus.PPL_SQL}, s AS (SELECT page_id, pos, 1 / (1 + exp(-0.1::DOUBLE * (ppl - 100))) AS s FROM p WHERE ppl IS NOT NULL) SELECT page_id, pos, round(s, 6) AS score, CASE WHEN s > 0.5 THEN 'error' ELSE 'none' END AS error_type FROM s",
        "word_logprob": f"WITH {corpus.WORDS_SQL}, {MODEL} SELECT word_id, round(lp, 6) AS logp, {COLOUR.format('round(lp, 6)')} AS colour FROM w JOIN m ON lower(text) = word",
        "token_logprobs": f"""WITH {PAGES.split(', k AS')[0].split(',\n  k AS')[0]}, {MODEL}, t AS (SELECT page_id, string_split(array_to_string(ws, ' '), ' ') AS ts FROM g), i AS (SELECT page_id, ts, unnest(range(len(ts))) AS k FROM t),
            o AS (SELECT page_id, k, ts[k + 1] AS token, sum(length(ts[k + 1]) + 1) OVER (PARTITION BY page_id ORDER BY k) - length(ts[k + 1]) - 1 AS s FROM i),
            n AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS pos, token, s FROM o WHERE token <> '')
            SELECT page_id, pos::INTEGER AS pos, token, s::INTEGER AS start_char, (s + length(token))::INTEGER AS end_char, CASE WHEN pos > 0 THEN round(lp, 6) END AS logp FROM n LEFT JOIN m ON lower(token) = word""",
        "page_readability": f"""WITH {corpus.PPL_SQL}, v AS (SELECT page_id, round(-ln(ppl), 6) AS lp FROM p WHERE ppl > 0),
            s AS (SELECT page_id, count(*) AS n, round(avg(lp), 6) AS mean_ll, min(lp) AS ll_min, round(median(lp), 10) AS ll_median, max(lp) AS ll_max, count(*) FILTER (lp < -6) AS low, count(*) FILTER (lp < -10) AS critical FROM v GROUP BY 1),
            t AS (SELECT *, round(exp(-mean_ll), 6) AS ppl, round(low::DOUBLE / n * 100, 6) AS low_percent FROM s),
            b AS (SELECT *, CASE WHEN ppl < 150 AND mean_ll > -4.5 AND low_percent < 3 THEN 'Good' WHEN ppl < 400 AND mean_ll > -6 AND low_percent < 7 THEN 'Fair' WHEN ppl < 1000 AND mean_ll > -8 AND low_percent < 15 THEN 'Poor' ELSE 'Very Poor / Problematic' END AS base FROM t)
            SELECT page_id, n, mean_ll, ppl, ll_min, ll_median, ll_max, low, critical, low_percent,
            CASE WHEN n < 10 AND base IN ('Good', 'Fair') AND low_percent > 10 THEN 'Poor (Short with errors)' WHEN n < 3 THEN 'Very Short / Unanalyzable' ELSE base END AS category FROM b""",
        "error_context": f"""WITH {corpus.PPL_SQL}, v AS (SELECT page_id, pos, word, ppl, array_to_string(list(word) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), ' ') AS context FROM p WHERE word IS NOT NULL AND ppl > 0)
            SELECT page_id, pos, word, context FROM v WHERE round(-ln(ppl), 6) < -6""",
        "likelihood_score": f"""WITH {corpus.PPL_SQL}, {corpus.WORDS_SQL}, e AS (SELECT page_id, line_id, pos, word, {COLOUR.format('round(-ln(ppl), 6)')} AS colour FROM p WHERE word IS NOT NULL AND ppl > 0),
            h AS (SELECT word_id, arg_min(colour, pos) AS colour FROM w JOIN e ON w.page_id = e.page_id AND w.line_id = e.line_id AND contains(e.word, w.text) WHERE colour <> 'lightgreen' GROUP BY 1)
            SELECT w.word_id, CASE WHEN colour IN ('red', 'darkred') THEN 1.0::DOUBLE WHEN colour = 'orange' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score, CASE WHEN colour IN ('red', 'darkred') THEN 'error' ELSE 'none' END AS error_type
            FROM w LEFT JOIN h USING (word_id) WHERE w.text IS NOT NULL""",
        "word_span": f"""WITH {corpus.PPL_SQL}, v AS (SELECT page_id, pos, length(word) AS n, coalesce(sum(length(word) + 1) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM p WHERE word IS NOT NULL)
            SELECT page_id, pos, s AS start_char, s + n - 1 AS end_char FROM v""",
    }
