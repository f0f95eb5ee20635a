"""The chunk analysis of whole pages paragraph by paragraph, and views of errors as a viewer needs them, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafwright import corpus
from leafwright.functions import numeric as nm
from leafwright.functions import text as tx
from leafwright.operators import chunks, labels, language, nested, statistics
from leafwright.plans.perplexity import MODEL, r6
from leafwright.storage import table

SIZE, OVERLAP = 15, 5


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with their text (lines joined by line ends), the words after merging, and line ids by position."""
    rows = corpus.lines(corpus.words(spark, sf_dir)).where("text <> ''")
    item = F.struct("line_ord", "text", "n_words")
    g = rows.groupBy("page_id", "region_ord").agg(F.array_sort(F.collect_list(item)).alias("l"))
    ids = F.flatten(F.transform("l", lambda x: F.array_repeat(x["line_ord"], x["n_words"])))
    text = F.array_join(F.transform("l", lambda x: x["text"]), "\n")
    words = tx.words_of(F.lower(tx.historical(tx.merge_marked(text))))
    return g.select("page_id", "region_ord", text.alias("text"), words.alias("words"), ids.alias("line_ords"))


def paragraph_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words after merging, numbered through the page, each with the line its position had (so ids drift behind a merged word)."""
    p = _paragraphs(spark, sf_dir).select("page_id", "region_ord", "line_ords", F.posexplode("words").alias("i", "word"))
    by = Window.partitionBy("page_id").orderBy("region_ord", "i")
    return p.select("page_id", "region_ord", (F.row_number().over(by) - 1).alias("word_position"), "word", tx.at_or_last(F.col("line_ords"), F.col("i")).alias("line_ord"))


def chunk_page_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean window perplexity of every word of every paragraph; words of page-number paragraphs have 0; errors are above 158."""
    p = _paragraphs(spark, sf_dir)
    words = corpus.words(spark, sf_dir).where(F.coalesce("text", F.lit("")) != "").select(F.col("text").alias("word"))
    flat = p.select("page_id", "region_ord", tx.is_page_number(F.col("text")).alias("is_number"), F.posexplode("words").alias("i", "word"))
    scored = language.with_logp(flat, language.unigrams(words)).withColumn("logp", F.coalesce("logp", F.lit(-20.0)))
    keys = ["page_id", "region_ord", "is_number"]
    arrays = scored.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "logp"))), lambda x: x["logp"]).alias("lp"))
    smooth = chunks.smoothed(arrays, keys, "lp", SIZE, OVERLAP)
    ppl = F.when(F.col("is_number"), 0.0).otherwise(F.col("ppl"))
    return smooth.select("page_id", "region_ord", F.col("word_id").alias("i"), r6(ppl).alias("ppl"), (F.round(ppl, 6) > chunks.ERROR_PERPLEXITY).alias("is_error"))


def chunk_word_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page words scored by the aligned perplexities; words without one stay unscored and without error."""
    words = corpus.words(spark, sf_dir).where("page_id is not null").select("page_id", "word_id", "region_ord", "line_ord", "word_ord", "text")
    aligned = labels.chunk_alignment(words, corpus.scored_words(spark, sf_dir).select("page_id", "pos", "word", "ppl"))
    score = nm.sigmoid(F.col("ppl"))
    return aligned.select("word_id", r6(score).alias("score"), F.when(score > 0.5, "error").otherwise("none").alias("error_type"))


def mapped_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with words in error (by type, or by a score above one half) and a polygon of four points or more; the first three such words."""
    t = nested.shred(nested.latest_records(table(spark, sf_dir, "page_records"), "page_id"), "page_id", "text_regions")
    words = t["text_regions.lines.words"].where("not is_null").where((F.lower(F.coalesce("error_type", F.lit(""))) == "error") | (F.coalesce("error_score", F.lit(0.0)) > 0.5))
    bad = words.groupBy("page_id", F.col("parent").alias("dewey")).agg(F.count("*").alias("n_errors"), F.array_sort(F.collect_list(F.struct("ord", F.coalesce("text", F.lit("")).alias("t")))).alias("w"))
    coords = t["text_regions.lines.coords"].where(F.size(F.filter(F.split(F.trim("points"), r"\s+"), lambda p: F.contains(p, F.lit(",")))) >= 4)
    first = F.array_join(F.transform(F.slice("w", 1, 3), lambda x: x["t"]), "|")
    return bad.join(coords.select("page_id", "dewey"), ["page_id", "dewey"]).select("page_id", F.col("dewey")[0].alias("region_ord"), F.col("dewey")[1].alias("line_ord"), "n_errors", first.alias("first_words"))


def word_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("page_id").orderBy("pos")
    words = corpus.scored_words(spark, sf_dir)
    return words.select("page_id", "pos", F.lag("word").over(by).alias("previous"), F.lead("word").over(by).alias("next"))


def line_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Red and green of a line's mean word score, and the palette colour of its region's type."""
    words = corpus.words(spark, sf_dir)
    g = words.groupBy("page_id", "region_ord", "line_ord").agg(F.round(F.coalesce(F.avg("word_error_score"), F.lit(1.0)), 9).alias("s"), corpus.raw_region_type(F.max("region_type")).alias("type"))
    ramp = nm.ramp(F.col("s"))
    return g.select("page_id", "region_ord", "line_ord", ramp["r"].alias("red"), ramp["g"].alias("green"), nm.region_colour(F.col("type")).alias("region_colour"))


def score_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About sixty labelled pages along a book's plot: every n // 60-th, at least every one."""
    rows = corpus.page_scores(spark, sf_dir)
    by = Window.partitionBy("book_id").orderBy("page_id")
    n = rows.groupBy("book_id").agg(F.count("*").alias("n"))
    placed = rows.select("book_id", "page_id", (F.row_number().over(by) - 1).alias("x")).join(n, "book_id")
    return placed.where(F.col("x") % F.greatest(F.lit(1), F.floor(F.col("n") / 60)) == 0).select("book_id", "page_id", "x")


def last_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score per page, the last delivered, NaN included."""
    return statistics.last_by_key(table(spark, sf_dir, "page_scores"), "page_id", "scored_at", "loaded_at")


def words_by_error_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by error type and book, all books and all types together too."""
    kinds = corpus.words(spark, sf_dir).select("book_id", corpus.error_type(F.col("error_type")).alias("error_type"))
    return kinds.cube("book_id", "error_type").agg(F.count("*").alias("n"))


def queries() -> dict:
    names = (paragraph_words, chunk_page_analysis, chunk_word_scores, mapped_errors, word_neighbours, line_colours, score_ticks, last_scores, words_by_error_type)
    return {f.__name__: f for f in names}


PARTS = f"""{corpus.LINES_SQL}, g AS (SELECT page_id, region_ord, string_agg(text, chr(10) ORDER BY line_ord) AS text, flatten(list(list_transform(range(n_words), lambda i: line_ord) ORDER BY line_ord)) AS ids FROM l WHERE text <> '' GROUP BY 1, 2),
  pw AS (SELECT page_id, region_ord, text, ids, list_filter(string_split(trim(regexp_replace(lower(translate(nfc_normalize(regexp_replace(regexp_replace(text, '⸗\\n*', '', 'g'), '\\n+', ' ', 'g')), 'ſʒƷƶ', 'szZz')), '[\\s\\p{{Z}}]+', ' ', 'g'), ' '), ' '), lambda x: x <> '') AS ws FROM g),
  pf AS (SELECT *, unnest(range(len(ws)))::INTEGER AS i FROM pw)"""


def oracle_sql() -> dict[str, str]:
    from leafwright.plans.layouts import ALIGNED

    step = SIZE - OVERLAP
    return {
        "chunk_word_scores": f"""WITH RECURSIVE {ALIGNED}, s AS (SELECT word_id, 1 / (1 + exp(-0.1::DOUBLE * (ppl - 100))) AS s FROM al)
            SELECT word_id, round(s, 6) AS score, CASE WHEN s > 0.5 THEN 'error' ELSE 'none' END AS error_type FROM s""",
        "paragraph_words": f"WITH {PARTS} SELECT page_id, region_ord, row_number() OVER (PARTITION BY page_id ORDER BY region_ord, i) - 1 AS word_position, ws[i + 1] AS word, ids[least(i + 1, len(ids))]::INTEGER AS line_ord FROM pf",
        "chunk_page_analysis": f"""WITH {PARTS}, {MODEL}, lp AS (SELECT page_id, region_ord, i, regexp_matches(trim(text, ' '), '^(?:[—\\-]\\s*)?\\p{{Nd}}+(?:\\s*[—\\-])?$') AS num, len(ws) AS n, coalesce(lp, -20) AS lp FROM pf LEFT JOIN m ON ws[i + 1] = word),
            c AS (SELECT page_id, region_ord, n, unnest(range(CASE WHEN n <= {SIZE} THEN 1 ELSE ceil((n - {SIZE}) / {step}::DOUBLE)::BIGINT + 1 END)) * {step} AS s FROM (SELECT DISTINCT page_id, region_ord, n FROM lp)),
            cp AS (SELECT c.page_id, c.region_ord, s, exp(-avg(lp)) AS ppl FROM c JOIN lp ON c.page_id = lp.page_id AND c.region_ord = lp.region_ord AND i >= s AND i < s + {SIZE} GROUP BY 1, 2, 3),
            w2 AS (SELECT lp.page_id, lp.region_ord, i, num, avg(ppl) AS ppl FROM lp JOIN cp ON cp.page_id = lp.page_id AND cp.region_ord = lp.region_ord AND i >= s AND i < s + {SIZE} GROUP BY ALL)
            SELECT page_id, region_ord, i, round(CASE WHEN num THEN 0 ELSE ppl END, 6)::DOUBLE AS ppl, round(CASE WHEN num THEN 0 ELSE ppl END, 6) > 158 AS is_error FROM w2""",
        "mapped_errors": """WITH r AS (SELECT DISTINCT page_id, text_regions FROM page_records), a AS (SELECT page_id, text_regions, unnest(range(len(text_regions)))::INTEGER AS region_ord FROM r), b AS (SELECT page_id, region_ord, text_regions[region_ord + 1].lines AS ls FROM a),
            c AS (SELECT page_id, region_ord, ls, unnest(range(len(ls)))::INTEGER AS line_ord FROM b), d AS (SELECT page_id, region_ord, line_ord, ls[line_ord + 1] AS x FROM c),
            e AS (SELECT page_id, region_ord, line_ord, list_filter(x.words, lambda w: w IS NOT NULL AND (lower(coalesce(w.error_type, '')) = 'error' OR coalesce(w.error_score, 0) > 0.5)) AS bad FROM d WHERE len(list_filter(string_split_regex(trim(x.coords.points), '\\s+'), lambda p: contains(p, ','))) >= 4)
            SELECT page_id, region_ord, line_ord, len(bad)::BIGINT AS n_errors, array_to_string(list_transform(bad[1:3], lambda w: coalesce(w.text, '')), '|') AS first_words FROM e WHERE len(bad) > 0""",
        "word_neighbours": f"WITH {corpus.PPL_SQL} SELECT page_id, pos, lag(word) OVER w AS previous, lead(word) OVER w AS next FROM p WINDOW w AS (PARTITION BY page_id ORDER BY pos)",
        "line_colours": f"""WITH {corpus.WORDS_SQL}, g AS (SELECT page_id, region_ord, line_ord, least(greatest(round(coalesce(avg(word_error_score), 1), 9), 0), 1) AS s, lower(translate(coalesce(max(region_type), 'paragraph'), '- ', '__')) AS t FROM w GROUP BY 1, 2, 3)
            SELECT page_id, region_ord, line_ord, (CASE WHEN s <= 0.5 THEN floor(s * 2 * 255) ELSE 255 END)::INTEGER AS red, (CASE WHEN s <= 0.5 THEN 255 ELSE floor((1 - (s - 0.5::DOUBLE) * 2) * 255) END)::INTEGER AS green,
            coalesce(MAP {{{', '.join(f"'{k}': '{v}'" for k, v in nm.REGION_COLOURS.items())}}}[t], '{nm.REGION_COLOURS['other']}') AS region_colour FROM g""",
        "score_ticks": f"WITH {corpus.SCORES_SQL}, v AS (SELECT book_id, page_id, row_number() OVER (PARTITION BY book_id ORDER BY page_id) - 1 AS x, count(*) OVER (PARTITION BY book_id) AS n FROM s) SELECT book_id, page_id, x FROM v WHERE x % greatest(1, n // 60) = 0",
        "last_scores": "SELECT page_id, arg_max(scored_at, loaded_at) AS scored_at FROM page_scores GROUP BY 1",
        "words_by_error_type": f"WITH {corpus.WORDS_SQL}, k AS (SELECT book_id, CASE WHEN lower(coalesce(error_type, '')) IN ({', '.join(repr(t) for t in corpus.ERROR_TYPES)}) THEN lower(error_type) ELSE 'none' END AS error_type FROM w) SELECT book_id, error_type, count(*) AS n FROM k GROUP BY CUBE (book_id, error_type)",
    }
