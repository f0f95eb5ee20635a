"""Queries over nested page records and tiny files (problems 5 and 6)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.operators import compaction, nested
from leafwright.storage import table, work_dir, written

REGIONS, LINES, WORDS = "text_regions", "text_regions.lines", "text_regions.lines.words"


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "page_records").select("page_id", REGIONS)
    nodes = nested.node_table(pages, "page_id", REGIONS)
    return nodes.where((F.col("n_children") == 0) & ~F.col("is_null") & F.col("path").isin("", REGIONS, LINES)).select("page_id", *_ords()).distinct()


def _ords() -> list:
    return [F.coalesce(F.get("dewey", F.lit(i)), F.lit(-1)).alias(f"{n}_ord") for i, n in enumerate(("region", "line"))]


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    pages = nested.latest_records(table(spark, sf_dir, "page_records"), "page_id")
    return nested.shred(pages, "page_id", REGIONS)


def p5_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir)[""]


def p5_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir)[REGIONS].select("page_id", F.col("ord").alias("region_ord"), "is_null", "id", "type")


def p5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)[LINES]
    return t.select("page_id", F.col("parent")[0].alias("region_ord"), F.col("ord").alias("line_ord"), "is_null", "id", "text")


def p5_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)[WORDS]
    return t.select("page_id", F.col("parent")[0].alias("region_ord"), F.col("parent")[1].alias("line_ord"), F.col("ord").alias("word_ord"), "is_null", "id", "text", "error_score", "error_type")


def p5_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    both = t[f"{REGIONS}.coords"].unionByName(t[f"{LINES}.coords"])
    return both.select("page_id", F.concat_ws(".", "parent").alias("owner"), "points")


def _store(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/store-{uuid.uuid4().hex}"


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a record in common: compacts all files into a new store and asks it where its records came from."""
    folder = _store(spark)
    compaction.compact(table(spark, sf_dir, "html_files"), folder)
    return compaction.files_sharing_records(compaction.origins(spark, folder))


def p6_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.tier_plan(table(spark, sf_dir, "html_files")).groupBy("tier").agg(F.sum("n_files").alias("n_files"), F.sum("bytes").alias("bytes"))


def p6_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compacts all files into a new store and returns what it holds: each record once."""
    folder = _store(spark)
    compaction.compact(table(spark, sf_dir, "html_files"), folder)
    return compaction.stored_records(spark, folder).select("filename", "html")


def p6_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in six loads, the last one twice, with merges between: files loaded, records held, records held twice."""
    files, folder = table(spark, sf_dir, "html_files"), _store(spark)
    for load in (*range(6), 5):
        compaction.compact(files.where(F.pmod("file_id", F.lit(6)) == load), folder, fanout=3)
    loaded = compaction.journal(spark, folder).where("level = 0").agg(F.sum("n_inputs").alias("files"))
    held = compaction.stored_records(spark, folder).groupBy("filename", "html").agg(F.count("*").alias("n"))
    return held.agg(F.count("*").alias("records"), F.count(F.when(F.col("n") > 1, 1)).alias("repeated")).crossJoin(loaded)


def queries() -> dict:
    return {f.__name__: f for f in (p5_found, p5_pages, p5_regions, p5_lines, p5_words, p5_coords, p6_found, p6_tiers, p6_compacted, p6_loads)}


LATEST = "pages AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM page_records)"
REGION_ROWS = f"{LATEST}, ro AS (SELECT page_id, unnest(range(len(text_regions)))::INTEGER AS region_ord, text_regions FROM pages), r AS (SELECT page_id, region_ord, text_regions[region_ord + 1] AS node FROM ro)"
LINE_ROWS = f"{REGION_ROWS}, lo AS (SELECT page_id, region_ord, unnest(range(len(node.lines)))::INTEGER AS line_ord, node.lines AS kids FROM r), l AS (SELECT page_id, region_ord, line_ord, kids[line_ord + 1] AS node FROM lo)"
WORD_ROWS = f"{LINE_ROWS}, wo AS (SELECT page_id, region_ord, line_ord, unnest(range(len(node.words)))::INTEGER AS word_ord, node.words AS kids FROM l), w AS (SELECT page_id, region_ord, line_ord, word_ord, kids[word_ord + 1] AS node FROM wo)"


def _childless(array: str) -> str:
    return f"({array} IS NULL OR len(list_filter({array}, lambda x: x IS NOT NULL)) = 0)"


JSON_OK = "json_valid(body) AND body <> ''"
RECORDS = f"""f AS (SELECT DISTINCT file_id, body FROM html_files WHERE {JSON_OK}),
  items AS (SELECT file_id, unnest(CASE json_type(body) WHEN 'ARRAY' THEN json_extract(body, '$[*]') ELSE [body::JSON] END) AS o FROM f),
  rec AS (SELECT DISTINCT file_id, json_extract_string(o, '$.Filename') AS filename, json_extract_string(o, '$.ColoredTextHTML') AS html FROM items
    WHERE json_type(o, '$.Filename') = 'VARCHAR' AND json_type(o, '$.ColoredTextHTML') = 'VARCHAR')"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": f"""WITH {LINE_ROWS}
            SELECT DISTINCT page_id, -1 AS region_ord, -1 AS line_ord FROM pages WHERE {_childless('text_regions')}
            UNION SELECT page_id, region_ord, -1 FROM r WHERE node IS NOT NULL AND {_childless('node.lines')}
            UNION SELECT page_id, region_ord, line_ord FROM l WHERE node IS NOT NULL AND {_childless('node.words')}""",
        "p5_pages": f"WITH {LATEST} SELECT page_id, book_id, xml_path, image_filename, image_height, image_width, overwrite_page_error FROM pages",
        "p5_regions": f"WITH {REGION_ROWS} SELECT page_id, region_ord, node IS NULL AS is_null, node.id AS id, node.type AS type FROM r",
        "p5_lines": f"WITH {LINE_ROWS} SELECT page_id, region_ord, line_ord, node IS NULL AS is_null, node.id AS id, node.text AS text FROM l",
        "p5_words": f"WITH {WORD_ROWS} SELECT page_id, region_ord, line_ord, word_ord, node IS NULL AS is_null, node.id AS id, node.text AS text, node.error_score AS error_score, node.error_type AS error_type FROM w",
        "p5_coords": f"""WITH {LINE_ROWS} SELECT page_id, region_ord::VARCHAR AS owner, node.coords.points AS points FROM r WHERE node.coords IS NOT NULL
            UNION ALL SELECT page_id, region_ord || '.' || line_ord, node.coords.points FROM l WHERE node.coords IS NOT NULL""",
        "p6_found": f"WITH {RECORDS} SELECT DISTINCT a.file_id AS file_a, b.file_id AS file_b FROM rec a JOIN rec b ON a.filename = b.filename AND a.html = b.html AND a.file_id < b.file_id",
        "p6_tiers": "SELECT floor(ln(greatest(coalesce(size_bytes, 0), 1)) / ln(4))::INTEGER AS tier, count(*) AS n_files, coalesce(sum(size_bytes), 0)::BIGINT AS bytes FROM (SELECT DISTINCT file_id, size_bytes FROM html_files) GROUP BY 1",
        "p6_compacted": f"WITH {RECORDS} SELECT DISTINCT filename, html FROM rec",
        "p6_loads": f"WITH {RECORDS} SELECT (SELECT count(DISTINCT file_id) FROM html_files) AS files, (SELECT count(*) FROM (SELECT DISTINCT filename, html FROM rec)) AS records, 0::BIGINT AS repeated",
    }
