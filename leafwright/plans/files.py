"""Page files and interchange files written and read back, with the SQL of the tables they were written from."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright import corpus
from leafwright.operators import chunks, nested
from leafwright.plans.perplexity import r6
from leafwright.plans.texts import _squeezed
from leafwright.sources import pagexml, tables
from leafwright.storage import table, work_dir


def _folder(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/files-{uuid.uuid4().hex}"


def page_trees(records: DataFrame) -> DataFrame:
    """Nested page records in the form page files are written from; null regions, lines and words are none."""
    present = lambda items: F.filter(items, lambda x: x.isNotNull())
    word = lambda w: F.struct(w["text"].alias("text"), w["error_score"].alias("word_error_score"), w["error_type"].alias("error_type"))
    line = lambda x: F.struct(x["id"].alias("line_id"), x["coords"]["points"].alias("coords"), F.transform(present(x["words"]), word).alias("words"))
    region = lambda r: F.struct(r["id"].alias("region_id"), r["type"].alias("region_type"), r["coords"]["points"].alias("coords"), F.transform(present(r["lines"]), line).alias("lines"))
    return records.select("page_id", "image_filename", "image_height", "image_width", "overwrite_page_error", F.transform(present(F.col("text_regions")), region).alias("regions"))


def _read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All page records as one page file each, read by the reader of scored page files."""
    folder = _folder(spark)
    pagexml.write_pages(page_trees(nested.latest_records(table(spark, sf_dir, "page_records"), "page_id")), folder)
    return pagexml.read_pages(spark, folder)


def xml_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(spark, sf_dir).select("page_id", "image_filename", "image_height", "image_width", "overwrite_page_error", F.col("corrupt").isNotNull().alias("corrupt"))


def xml_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the page files with the type of their region and the points of their polygon."""
    return pagexml.lines(_read_back(spark, sf_dir)).select("page_id", "region_ord", "region_id", "region_type", "line_ord", "line_id", "n_points")


def xml_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagexml.words(_read_back(spark, sf_dir)).select("page_id", "region_ord", "line_ord", "word_ord", "text", "word_error_score", "error_type")


def xml_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in error of the page files, and why."""
    return pagexml.predicted_words(pagexml.words(_read_back(spark, sf_dir))).select("page_id", "region_ord", "line_ord", "word_ord", "reason")


def xml_gold_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page file as a list of normalised words: how many, and the words themselves."""
    made = pagexml.gold_words(_read_back(spark, sf_dir))
    return made.select("page_id", F.size("words").alias("n_words"), F.array_join("words", " ").alias("text"), "corrupt")


def json_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored pages with their islands of errors as JSON, one object a line, read back: words and perplexity of each."""
    words = corpus.scored_words(spark, sf_dir)
    found = chunks.islands(words, ["page_id"], "pos", F.coalesce(F.col("ppl"), F.lit(0.0)) > chunks.ERROR_PERPLEXITY, {"word": "words", "line_id": "line_ids"})
    island = F.struct(F.lit("island").alias("type"), "start_idx", "end_idx", "words", "line_ids")
    problems = found.groupBy("page_id").agg(F.array_sort(F.collect_list(island)).alias("problematic_regions"))
    pages = corpus.once(table(spark, sf_dir, "chunk_pages").drop("loaded_at", "run_date"), "page_id", apart=("book_id", "word_smoothed_ppl_page")).select("page_id", "all_words_page", "all_word_line_ids", "word_smoothed_ppl_page")
    folder = _folder(spark)
    tables.write_json(pages.join(problems, "page_id", "left"), folder)
    back = tables.read_json(spark, folder, tables.CHUNK_PAGES, lines=True)
    valid = F.filter("word_smoothed_ppl_page", lambda x: x.isNotNull() & ~F.isnan(x))
    total = F.aggregate(valid, F.lit(0.0), lambda a, x: a + x)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    held = F.aggregate(F.coalesce("problematic_regions", F.array()), F.lit(0), lambda a, x: a + F.size(x["words"]))
    return back.select("page_id", F.greatest(size("all_words_page"), F.lit(0)).alias("n_words"), F.greatest(size("all_word_line_ids"), F.lit(0)).alias("n_ids"), r6(total).alias("ppl"), F.greatest(size("problematic_regions"), F.lit(0)).alias("n_islands"), held.alias("n_island_words"))


def csv_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored words as CSV, read back with the stated schema: nothing is inferred, only empty fields are null."""
    ppl = F.nanvl("ppl", F.lit(None).cast("double"))
    rows = corpus.scored_words(spark, sf_dir).select("word", "line_id", F.lit(None).cast("string").alias("paragraph_id"), F.col("pos").alias("word_position"), F.round(ppl, 6).alias("perplexity"), (F.coalesce(ppl, F.lit(0.0)) > chunks.ERROR_PERPLEXITY).alias("is_error"), "page_id")
    folder = _folder(spark)
    tables.write_csv(rows, folder)
    return tables.read_csv(spark, folder, tables.CHUNK_WORDS)


def csv_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates of pages through a file, joined with the pages that have features."""
    words = corpus.words(spark, sf_dir).where("page_id is not null")
    labelled = words.select(F.col("page_id").alias("file_id"), F.when(corpus.error_type(F.col("error_type")) != "none", "error").otherwise("correct").alias("label"))
    folder = _folder(spark)
    tables.write_csv(tables.error_rates(labelled), folder)
    rates = tables.read_csv(spark, folder, tables.ERROR_RATES)
    pages = words.groupBy("page_id").agg(F.count_distinct("region_ord").alias("n_regions"))
    return tables.features_with_rates(pages, rates).select("page_id", "n_regions", r6(F.col("error_rate")).alias("error_rate"))


def queries() -> dict:
    return {f.__name__: f for f in (xml_pages, xml_lines, xml_words, xml_errors, xml_gold_words, json_pages, csv_words, csv_error_rates)}


# The same rows from the table: positions among the elements that are there.
TREE = """pg AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM page_records),
  rs AS (SELECT page_id, list_filter(text_regions, lambda x: x IS NOT NULL) AS xs FROM pg), ri AS (SELECT page_id, xs, unnest(range(len(xs)))::INTEGER AS region_ord FROM rs), r AS (SELECT page_id, region_ord, xs[region_ord + 1] AS x FROM ri),
  ls AS (SELECT page_id, region_ord, x, list_filter(x.lines, lambda y: y IS NOT NULL) AS ys FROM r), li AS (SELECT *, unnest(range(len(ys)))::INTEGER AS line_ord FROM ls), l AS (SELECT page_id, region_ord, x, line_ord, ys[line_ord + 1] AS y FROM li),
  ws AS (SELECT page_id, region_ord, line_ord, list_filter(y.words, lambda z: z IS NOT NULL) AS zs FROM l), wi AS (SELECT *, unnest(range(len(zs)))::INTEGER AS word_ord FROM ws),
  w AS (SELECT page_id, region_ord, line_ord, word_ord, coalesce(zs[word_ord + 1].text, '') AS text, round(zs[word_ord + 1].error_score, 3) AS word_error_score, lower(coalesce(zs[word_ord + 1].error_type, '')) AS k FROM wi)"""
ERRORS = ", ".join(f"'{t}'" for t in corpus.ERROR_TYPES)
TYPES = ", ".join(f"'{t}'" for t in corpus.REGION_TYPES)


def oracle_sql() -> dict[str, str]:
    kind = "replace(replace(lower(coalesce(x.type, 'paragraph')), '-', '_'), ' ', '_')"
    points = "len(list_filter(string_split_regex(trim(coalesce(y.coords.points, '')), '\\s+'), lambda p: contains(p, ',')))"
    return {
        "xml_pages": f"WITH {TREE} SELECT page_id, coalesce(image_filename, '') AS image_filename, coalesce(image_height, 0) AS image_height, coalesce(image_width, 0) AS image_width, CASE WHEN overwrite_page_error <> -1 AND NOT isnan(overwrite_page_error) THEN overwrite_page_error END AS overwrite_page_error, false AS corrupt FROM pg WHERE page_id IS NOT NULL",
        "xml_lines": f"WITH {TREE} SELECT page_id, region_ord, coalesce(x.id, '') AS region_id, CASE WHEN {kind} IN ({TYPES}) THEN {kind} ELSE 'other' END AS region_type, line_ord, coalesce(y.id, '') AS line_id, {points}::INTEGER AS n_points FROM l WHERE page_id IS NOT NULL",
        "xml_words": f"WITH {TREE} SELECT page_id, region_ord, line_ord, word_ord, text, word_error_score, CASE WHEN k IN ({ERRORS}) THEN k ELSE 'none' END AS error_type FROM w WHERE page_id IS NOT NULL",
        "xml_errors": f"WITH {TREE} SELECT page_id, region_ord, line_ord, word_ord, CASE WHEN k = 'error' THEN 'type' ELSE format('score {{:.3f}}', word_error_score) END AS reason FROM w WHERE page_id IS NOT NULL AND (k = 'error' OR word_error_score > 0.5)",
        "xml_gold_words": f"""WITH {TREE}, gl AS (SELECT page_id, region_ord, line_ord, array_to_string(list_transform(coalesce(list_filter(y.words, lambda z: z IS NOT NULL), []), lambda z: coalesce(z.text, '')), ' ') AS t FROM l),
            gp AS (SELECT page_id, {_squeezed("translate(string_agg(t, ' ' ORDER BY region_ord, line_ord), '⸗–—' || chr(160), '--- ')")} AS t FROM gl GROUP BY 1), ga AS (SELECT page_id, coalesce(t, '') AS t FROM pg LEFT JOIN gp USING (page_id) WHERE page_id IS NOT NULL)
            SELECT page_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END::INTEGER AS n_words, t AS text, false AS corrupt FROM ga""",
        "json_pages": f"""WITH {corpus.PPL_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM p), f AS (SELECT *, n - row_number() OVER (PARTITION BY page_id ORDER BY pos) AS run FROM a WHERE coalesce(ppl, 0) > 158),
            g AS (SELECT page_id, count(DISTINCT run) AS islands, count(*) AS held FROM f GROUP BY 1)
            SELECT c.page_id, coalesce(len(ws), 0)::INTEGER AS n_words, coalesce(len(ls), 0)::INTEGER AS n_ids, round(CASE WHEN ps IS NOT NULL THEN coalesce(list_sum(list_filter(ps, lambda x: x IS NOT NULL AND NOT isnan(x))), 0::DOUBLE) END, 6) AS ppl, coalesce(islands, 0)::INTEGER AS n_islands, coalesce(held, 0)::INTEGER AS n_island_words FROM c LEFT JOIN g ON c.page_id = g.page_id""",
        "csv_words": f"""WITH {corpus.PPL_SQL} SELECT nullif(word, '') AS word, nullif(line_id, '') AS line_id, NULL::VARCHAR AS paragraph_id, pos AS word_position, round(CASE WHEN isnan(ppl) THEN NULL ELSE ppl END, 6) AS perplexity, coalesce(CASE WHEN isnan(ppl) THEN NULL ELSE ppl END, 0) > 158 AS is_error, nullif(page_id, '') AS page_id FROM p""",
        "csv_error_rates": f"WITH {corpus.WORDS_SQL} SELECT page_id, count(DISTINCT region_ord) AS n_regions, round(count(*) FILTER (lower(coalesce(error_type, '')) IN ({ERRORS}) AND lower(error_type) <> 'none')::DOUBLE / count(*), 6) AS error_rate FROM w WHERE page_id IS NOT NULL GROUP BY 1",
    }
