"""Layout, labelling, alignment and model queries.

Ground truth and prediction come from the page records: the true regions are the records' regions; the
predicted ones are their boxes moved by a fixed rule of their ordinals, so overlaps have a closed form.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright import corpus
from leafwright.functions import geometry as geo
from leafwright.functions import similarity
from leafwright.functions import text as tx
from leafwright.operators import features, labels, layout, nested, statistics
from leafwright.plans.perplexity import r6
from leafwright.storage import table, work_dir, written
from leafwright.streaming import incremental


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    latest = nested.latest_records(table(spark, sf_dir, "page_records"), "page_id")
    return nested.shred(written(latest, "records"), "page_id", "text_regions")  # several tables are read from it


def _regions(t: dict[str, DataFrame]) -> DataFrame:
    """``page_id, ord, type, coords`` of the regions that are not null."""
    coords = t["text_regions.coords"].select("page_id", "dewey", F.col("points").alias("coords"))
    rows = t["text_regions"].where("not is_null").join(coords, ["page_id", "dewey"], "left")
    return rows.select("page_id", "ord", corpus.raw_region_type(F.col("type")).alias("type"), "coords")


def _lines(t: dict[str, DataFrame]) -> DataFrame:
    coords = t["text_regions.lines.coords"].select("page_id", "dewey", F.col("points").alias("coords"))
    rows = t["text_regions.lines"].where("not is_null").join(coords, ["page_id", "dewey"], "left")
    return rows.select("page_id", F.col("parent")[0].alias("region_ord"), F.col("ord").alias("line_ord"), "id", "text", "coords")


def _rect(x0, y0, x1, y1):
    return F.format_string("%d,%d %d,%d %d,%d %d,%d", x0, y0, x1, y0, x1, y1, x0, y1)


def _moved(regions: DataFrame) -> DataFrame:
    """Predicted regions: the boxes of the true ones, moved down by 7 pixels for every place on the page (modulo 5)."""
    b = geo.box(geo.points(F.col("coords")))
    by = F.col("ord") % 5 * 7
    return regions.withColumn("b", b).where("b.x0 is not null").select("page_id", "ord", "type", _rect(F.col("b.x0"), F.col("b.y0") + by, F.col("b.x1"), F.col("b.y1") + by).alias("coords"))


def polygon_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = geo.points(F.col("coords"))
    rows = _regions(_tables(spark, sf_dir)).select("page_id", "ord", pts.alias("pts"))
    return rows.select("page_id", F.col("ord").alias("region_ord"), F.size("pts").alias("n_points"), geo.area(F.col("pts")).alias("area"), geo.box(F.col("pts")).alias("b")).select("page_id", "region_ord", "n_points", "area", "b.x0", "b.y0", "b.x1", "b.y1")


def rect_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and IoU of the box of every region with the moved boxes of its page."""
    true = _regions(_tables(spark, sf_dir))
    b = geo.box(geo.points(F.col("coords")))
    boxes = true.withColumn("b", b).where("b.x0 is not null")
    left = boxes.select("page_id", "ord", "b")
    right = boxes.select("page_id", F.col("ord").alias("other"), F.struct(F.col("b.x0"), (F.col("b.y0") + F.col("ord") % 5 * 7).alias("y0"), F.col("b.x1"), (F.col("b.y1") + F.col("ord") % 5 * 7).alias("y1")).alias("m"))
    pairs = left.join(right, "page_id").where(geo.boxes_meet(F.col("b"), F.col("m")))
    shared = (F.least("b.x1", "m.x1") - F.greatest("b.x0", "m.x0")) * (F.least("b.y1", "m.y1") - F.greatest("b.y0", "m.y0")).cast("double")
    size = lambda c: ((F.col(f"{c}.x1") - F.col(f"{c}.x0")) * (F.col(f"{c}.y1") - F.col(f"{c}.y0"))).cast("double")
    return pairs.select("page_id", "ord", "other", r6(F.when(size("b") > 0, shared / size("b")).otherwise(0.0)).alias("coverage"), r6(geo.iou(shared, size("b"), size("m"))).alias("iou"))


def _layout(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = _tables(spark, sf_dir)
    true, rows = _regions(t), _lines(t)
    tokens = rows.groupBy("page_id", "region_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_ord", tx.tokens(tx.normal_hybrid(F.coalesce("text", F.lit("")))).alias("t")))), lambda x: x["t"]).alias("ts"), F.min_by("coords", "line_ord").alias("first_line")).select("page_id", F.col("region_ord").alias("ord"), F.flatten("ts").alias("tokens"), "first_line")
    truth = written(layout.measured(true, "coords").join(tokens, ["page_id", "ord"], "left"), "truth")  # its areas are read several times
    predicted = layout.measured(_moved(true), "coords").select("page_id", F.col("ord").alias("region_ord"), F.col("coords").alias("region_coords"), F.col("polygon_area").alias("region_area"))
    lines = layout.measured(rows, "coords").select("page_id", F.col("line_ord").alias("ord"), "region_ord", "coords", "bbox", "polygon_area", "text")
    return lines, predicted, truth


def overlay_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, predicted, truth = _layout(spark, sf_dir)
    return layout.overlay_verdicts(lines, predicted, truth.drop("tokens", "first_line")).select("page_id", "region_ord", "ord", "error_type", r6(F.col("score")).alias("score"))


def hybrid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, predicted, truth = _layout(spark, sf_dir)
    return layout.overlay_verdicts(lines, predicted, truth, with_text=True).select("page_id", "region_ord", "ord", "error_type", r6(F.col("score")).alias("score"))


def region_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    true = _regions(_tables(spark, sf_dir))
    return layout.region_matching(true, _moved(true))


def line_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio of every line of a page record to the line after it, and of their token lists."""
    from pyspark.sql import Window

    by = Window.partitionBy("page_id").orderBy("region_ord", "line_ord")
    rows = _lines(_tables(spark, sf_dir)).select("page_id", "region_ord", "line_ord", tx.normal_supervised(F.coalesce("text", F.lit(""))).alias("t")).withColumn("n", F.lead("t").over(by))
    rows = rows.where("n is not null")
    return rows.select("page_id", "region_ord", "line_ord", similarity.text_ratio("t", "n").alias("ratio"), similarity.token_ratio(F.split("t", " "), F.split("n", " ")).alias("partial"), (F.size(F.array_intersect(F.split("t", " "), F.split("n", " ")))).alias("common"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word labels of the records' pages: each page's own words against the text of its lines."""
    t = _tables(spark, sf_dir)
    kinds = _regions(t).select("page_id", F.col("ord").alias("region_ord"), F.col("type").alias("kind"))
    para = F.concat_ws(".", "page_id", "region_ord")
    norm = lambda c: tx.tokens(tx.normal_supervised(c))
    place = F.shiftleft(F.col("region_ord").cast("bigint"), 32) + F.col("line_ord")  # both are 32-bit: no two lines share a place
    truth = _lines(t).join(kinds, ["page_id", "region_ord"]).select("page_id", place.alias("line_ord"), "kind", para.alias("para"), norm(F.coalesce("text", F.lit(""))).alias("words"))
    w = t["text_regions.lines.words"].where("not is_null").select("page_id", F.col("parent")[0].alias("region_ord"), F.col("parent")[1].alias("line_ord"), "ord", "text")
    joined = w.groupBy("page_id", "region_ord", "line_ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), " ").alias("text"))
    predicted = joined.join(kinds, ["page_id", "region_ord"]).select("page_id", place.alias("line_ord"), "kind", para.alias("para"), norm(F.col("text")).alias("words"))
    return labels.word_labels(predicted, truth)


def word_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir)


def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.line_classes(_labels(spark, sf_dir))


def label_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).groupBy("page_id").agg(F.avg((F.col("label") == "error").cast("double")).alias("error_rate"))


def chunk_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexities of scored words on the words of the pages, divided words taking one together."""
    words = corpus.words(spark, sf_dir).where("page_id is not null").select("page_id", "word_id", "region_ord", "line_ord", "word_ord", "text")
    return labels.chunk_alignment(words, corpus.scored_words(spark, sf_dir).select("page_id", "pos", "word", "ppl"))


def error_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of words predicted by their score, against the region types, by page."""
    words = corpus.words(spark, sf_dir).where("text is not null and page_id is not null")
    near = corpus.lines(words).select("page_id", "region_ord", "line_ord", F.col("text").alias("context"))
    wrong = words.where("word_error_score > 0.5").join(near, ["page_id", "region_ord", "line_ord"]).select("page_id", tx.normal_gold(F.col("text")).alias("word"), tx.normal_gold(F.col("context")).alias("context"))
    item = F.struct("line_ord", "word_ord", tx.normal_gold(F.col("text")).alias("t"))
    region = words.groupBy("page_id", "region_ord").agg(F.lower(F.coalesce(F.max("region_type"), F.lit(""))).alias("kind"), F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]).alias("words"))
    judged = labels.predicted_errors(wrong, region.withColumnRenamed("region_ord", "ord"))
    return judged.select("page_id", "tp", "fp", "actual", statistics.f1(F.col("tp"), F.col("fp"), F.col("actual")).alias("f")).select("page_id", "tp", "fp", "actual", "f.*")


def rf_page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page scores predicted from features and text by a random forest fitted on a bounded sample of scored pages.

    The 18 features and the embedding of the whole page text are one vector; the model is chosen by three-fold
    cross-validation, kept, loaded again and scores all pages.
    """
    words = corpus.words(spark, sf_dir)
    texts = corpus.lines(words).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("region_ord", "line_ord", "text"))), lambda x: x["text"]), " ").alias("text"))
    made = features.page_features(words).join(features.hashed_embedding(texts, "text").select("page_id", "embedding"), "page_id")
    made = written(made, "features")  # search and scoring both read it
    rated = made.join(corpus.page_scores(spark, sf_dir).select("page_id", F.col("score").alias("label")), "page_id", "left")
    model, _ = features.train(rated, "label")
    kept = f"{work_dir(spark)}/model-{uuid.uuid4().hex}"
    features.save_model(model, kept)
    return features.score_pages(features.load_model(kept), made)


def naive_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.naive(corpus.words(spark, sf_dir))


def manual_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated ratios of pages: here the records' overwriting values; pages without one score 0."""
    pages = nested.latest_records(table(spark, sf_dir, "page_records"), "page_id")
    ratios = pages.where("overwrite_page_error <> -1").select("page_id", F.col("overwrite_page_error").alias("error_ratio"))
    return layout.manual(pages, ratios)


def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages scored by a file stream that reads the table as it stands."""
    folder = f"{work_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    source = table(spark, sf_dir, "chunk_pages")
    scored = incremental.score_arrivals(spark, f"{sf_dir}/chunk_pages.parquet*", source.schema, f"{folder}/scores", f"{folder}/checkpoint")
    return scored.dropDuplicates(["page_id"]).select("page_id", "book_id", r6(F.col("score")).alias("score"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = incremental.event_windows(table(spark, sf_dir, "events"))
    return made.select("start", "event_type", "n", r6(F.col("total")).alias("total"))


def queries() -> dict:
    names = (polygon_areas, rect_overlaps, overlay_scores, hybrid_scores, region_matching, line_similarity, word_labels, line_classes, label_error_rates, chunk_align, error_f1, rf_page_scores, naive_scores, manual_scores, stream_scores, event_windows)
    return {f.__name__: f for f in names}


def _both(i: str, a: str) -> str:
    """1 where page word i is divided and, with the next one, near enough to scored word a, else 0."""
    letters = lambda x: f"translate({x}, 'äöüßſʒƶ⸗é', '123456789')"  # noqa: E731 (one byte each, as levenshtein counts bytes)
    whole = f"replace(translate(lower(regexp_replace(ws[{i}], '⸗+$', '') || replace(ws[{i} + 1], '⸗', '')), 'ſʒƶ', 'szz'), '-', '')"
    near = f"levenshtein({letters(whole)}, {letters(f'lower(ss[{a}])')}) <= greatest(1, floor(0.3::DOUBLE * length(ss[{a}])))"
    return f"CASE WHEN ends_with(ws[{i}], '⸗') AND {i} < len(ws) AND {near} THEN 1 ELSE 0 END"


ALIGNED = f"""{corpus.WORDS_SQL}, {corpus.PPL_SQL}, g AS (SELECT page_id, list(coalesce(text, '') ORDER BY region_ord, line_ord, word_ord, word_id) AS ws, list(word_id ORDER BY region_ord, line_ord, word_ord, word_id) AS ids FROM w WHERE page_id IS NOT NULL GROUP BY 1),
  sc AS (SELECT page_id, list(coalesce(word, '') ORDER BY pos) AS ss, list(ppl ORDER BY pos) AS ps FROM p GROUP BY 1), b AS (SELECT * FROM g LEFT JOIN sc USING (page_id)),
  r AS (SELECT page_id, 1 AS i, 1 AS a, {_both('1', '1')} AS t FROM b WHERE len(ss) > 0
    UNION ALL SELECT page_id, n, m, {_both('n', 'm')} FROM (SELECT b.*, r.i + 1 + r.t AS n, r.a + 1 AS m FROM r JOIN b ON r.page_id = b.page_id WHERE r.i + 1 + r.t <= len(ws) AND r.a + 1 <= len(ss))),
  m AS (SELECT page_id, i, a FROM r UNION ALL SELECT page_id, i + 1, a FROM r WHERE t = 1), e AS (SELECT page_id, unnest(range(1, len(ws) + 1)) AS i, ids, ps FROM b),
  al AS (SELECT ids[e.i] AS word_id, ps[m.a] AS ppl FROM e LEFT JOIN m ON e.page_id = m.page_id AND e.i = m.i)"""
REG = """r AS (SELECT DISTINCT page_id, overwrite_page_error AS o, text_regions FROM page_records), a AS (SELECT page_id, unnest(range(len(text_regions)))::INTEGER AS ord, text_regions FROM r), n AS (SELECT page_id, ord, text_regions[ord + 1] AS x FROM a),
  t AS (SELECT page_id, ord, list_transform(list_filter(string_split_regex(trim(x.coords.points), '\\s+'), lambda p: contains(p, ',')), lambda p: [try_cast(string_split(p, ',')[1] AS INTEGER), try_cast(string_split(p, ',')[2] AS INTEGER)]) AS p FROM n WHERE x IS NOT NULL),
  b AS (SELECT page_id, ord, coalesce(p, []) AS p, list_min(list_transform(p, lambda q: q[1])) AS x0, list_min(list_transform(p, lambda q: q[2])) AS y0, list_max(list_transform(p, lambda q: q[1])) AS x1, list_max(list_transform(p, lambda q: q[2])) AS y1 FROM t)"""


def oracle_sql() -> dict[str, str]:
    follow = "p[(i % len(p)) + 1]"
    return {
        "polygon_areas": f"""WITH {REG} SELECT page_id, ord AS region_ord, len(p)::INTEGER AS n_points,
            CASE WHEN len(p) >= 3 THEN abs(list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i][1]::DOUBLE * {follow}[2] - {follow}[1]::DOUBLE * p[i][2]))) / 2 ELSE 0::DOUBLE END AS area, x0, y0, x1, y1 FROM b""",
        "rect_overlaps": f"""WITH {REG}, m AS (SELECT page_id, ord AS other, x0 AS u0, y0 + ord % 5 * 7 AS v0, x1 AS u1, y1 + ord % 5 * 7 AS v1 FROM b WHERE x0 IS NOT NULL),
            j AS (SELECT *, ((least(x1, u1) - greatest(x0, u0)) * (least(y1, v1) - greatest(y0, v0)))::DOUBLE AS sh, ((x1 - x0) * (y1 - y0))::DOUBLE AS sa, ((u1 - u0) * (v1 - v0))::DOUBLE AS sb FROM b JOIN m USING (page_id) WHERE x0 <= u1 AND u0 <= x1 AND y0 <= v1 AND v0 <= y1)
            SELECT page_id, ord, other, round(CASE WHEN sa > 0 THEN sh / sa ELSE 0 END, 6) AS coverage, round(CASE WHEN sa + sb - sh > 0 THEN sh / (sa + sb - sh) ELSE 0 END, 6) AS iou FROM j""",
        "chunk_align": f"WITH RECURSIVE {ALIGNED} SELECT word_id, ppl FROM al",
        "naive_scores": f"""WITH {corpus.WORDS_SQL}, u AS (SELECT word_id, ('0x' || substr(md5(word_id || ':0'), 1, 13))::BIGINT / 4503599627370496::DOUBLE AS score FROM w)
            SELECT word_id, score, CASE WHEN score > 0.5 THEN 'error' ELSE 'none' END AS error_type FROM u""",
        "manual_scores": "SELECT DISTINCT page_id, CASE WHEN overwrite_page_error <> -1 THEN overwrite_page_error ELSE 0 END::DOUBLE AS score FROM page_records",
        "stream_scores": """WITH c AS (SELECT DISTINCT page_id, book_id, list_filter(word_smoothed_ppl_page, lambda x: x IS NOT NULL AND NOT isnan(x)) AS p FROM chunk_pages)
            SELECT page_id, book_id, round(CASE WHEN len(p) > 0 THEN len(list_filter(p, lambda x: 1 / (1 + exp(-0.1::DOUBLE * (x - 100))) > 0.5))::DOUBLE / len(p) ELSE 0 END, 6)::DOUBLE AS score FROM c""",
        "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    }
