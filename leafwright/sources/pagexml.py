"""Page layout files: raw layout XML (with namespaces) and scored XML (words as attributes), read and written.

One schema covers both formats. Children of other kinds (tables, images, reading order) are ignored.
Text of a raw line: the first non-empty text equivalent, split at blanks, else the texts of its words.
Files that cannot be parsed keep a row with ``corrupt`` filled.
"""

from __future__ import annotations

import os
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright import corpus
from leafwright.functions import geometry as geo
from leafwright.functions.text import normal_gold, words_of

WORD = "struct<_id:string,_text:string,_error_score:double,_error_type:string,TextEquiv:array<struct<Unicode:string>>>"
LINE = f"struct<_id:string,_text:string,Coords:struct<_points:string>,TextEquiv:array<struct<Unicode:string>>,Word:array<{WORD}>>"
REGION = f"struct<_id:string,_type:string,Coords:struct<_points:string>,TextLine:array<{LINE}>>"
SCHEMA = f"_imageFilename string, _imageHeight int, _imageWidth int, _overwritePageError double, TextRegion array<{REGION}>, _corrupt_record string"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, image_filename, image_height, image_width, overwrite_page_error, regions, corrupt``; -1 is unset."""
    raw = spark.read.format("xml").option("rowTag", "Page").option("pathGlobFilter", "*.{xml,XML}").option("mode", "PERMISSIVE").option("ignoreSurroundingSpaces", False).schema(SCHEMA).load(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"(?i)^(.*)\.xml$", 1)
    image = F.regexp_replace("_imageFilename", r"(?<!\.bin)\.png$", ".bin.png")
    return raw.select(name.alias("page_id"), F.col("_imageFilename").alias("image_filename"), image.alias("raw_image_filename"), F.col("_imageHeight").alias("image_height"), F.col("_imageWidth").alias("image_width"), F.when(F.col("_overwritePageError") != -1.0, F.col("_overwritePageError")).alias("overwrite_page_error"), F.col("TextRegion").alias("regions"), F.col("_corrupt_record").alias("corrupt"))


def regions(pages: DataFrame) -> DataFrame:
    r = pages.select("page_id", F.posexplode("regions").alias("region_ord", "r"))
    return r.select("page_id", "region_ord", F.col("r._id").alias("region_id"), F.col("r._type").alias("type"), corpus.raw_region_type(F.col("r._type")).alias("region_type"), F.col("r.Coords._points").alias("coords"), F.col("r.TextLine").alias("lines"))


def _line_text(line):
    """The first text equivalent that is not empty, else the texts of the words, else the text as an attribute."""
    text = lambda e: F.get(F.filter(e, lambda t: F.coalesce(t["Unicode"], F.lit("")) != ""), F.lit(0))["Unicode"]
    return F.coalesce(text(line["TextEquiv"]), F.array_join(F.transform(line["Word"], lambda w: F.trim(F.coalesce(text(w["TextEquiv"]), w["_text"]))), " "), line["_text"])


def lines(pages: DataFrame) -> DataFrame:
    """Lines with their text and words; ``n_points`` allows dropping lines without a usable polygon."""
    x = regions(pages).select("page_id", "region_ord", "region_id", "region_type", F.posexplode("lines").alias("line_ord", "l"))
    own = _line_text(F.col("l"))
    return x.select("page_id", "region_ord", "region_id", "region_type", "line_ord", F.col("l._id").alias("line_id"), F.col("l.Coords._points").alias("coords"), F.size(geo.points(F.col("l.Coords._points"))).alias("n_points"), own.alias("text"), F.col("l.Word").alias("scored"))


def words(pages: DataFrame) -> DataFrame:
    """Words in flat form: scored words as stated, else the words of the line text without score."""
    rows = lines(pages)
    scored = F.filter(F.transform("scored", lambda w: F.struct(w["_text"].alias("text"), w["_error_score"].alias("score"), w["_error_type"].alias("kind"))), lambda w: w["text"].isNotNull())
    plain = F.transform(words_of(F.col("text")), lambda t: F.struct(t.alias("text"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("kind")))
    items = F.when(F.size(scored) > 0, scored).otherwise(plain)
    flat = rows.select("page_id", "region_ord", "region_id", "region_type", "line_ord", "line_id", F.posexplode(items).alias("word_ord", "w"))
    return flat.select("page_id", "region_ord", "region_id", "region_type", "line_ord", "line_id", "word_ord", F.col("w.text").alias("text"), F.col("w.score").alias("word_error_score"), corpus.error_type(F.col("w.kind")).alias("error_type"))


def gold_words(pages: DataFrame) -> DataFrame:
    """``page_id, words, corrupt``: a ground-truth page as one list of normalised words, region by region in order.

    A page without text has no words (an empty list), and so has a file that cannot be parsed, which ``corrupt`` tells; a
    missing file is no row.
    """
    texts = F.transform(F.coalesce("regions", F.array()), lambda r: F.transform(F.coalesce(r["TextLine"], F.array()), lambda x: F.coalesce(_line_text(x), F.lit(""))))
    return pages.select("page_id", words_of(normal_gold(F.array_join(F.flatten(texts), " "))).alias("words"), F.col("corrupt").isNotNull().alias("corrupt"))


def predicted_words(words_: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Words in error: by type, or else by a score above the threshold, with the reason."""
    by_type, by_score = F.col("error_type") == "error", F.coalesce(F.col("word_error_score") > threshold, F.lit(False))
    return words_.where(by_type | by_score).withColumn("reason", F.when(by_type, "type").otherwise(F.format_string("score %.3f", "word_error_score")))


def page_xml(record: dict) -> str:
    """One scored page file; unset parts are left out, an unset page error is -1.0."""
    error = record["overwrite_page_error"]
    page = ET.Element("Page", {"imageFilename": record["image_filename"] or "", "imageHeight": str(record["image_height"] or 0), "imageWidth": str(record["image_width"] or 0), "orientation": "0.0", "overwritePageError": str(-1.0 if error is None or error != error else error)})
    for r in record["regions"] or []:
        region = ET.SubElement(page, "TextRegion", {"id": r["region_id"] or "", "type": (r["region_type"] or "paragraph").lower()})
        ET.SubElement(region, "Coords", {"points": r["coords"] or ""})
        for k in r["lines"] or []:
            line = ET.SubElement(region, "TextLine", {"id": k["line_id"] or "", "text": " ".join(w["text"] or "" for w in k["words"] or [])})
            ET.SubElement(line, "Coords", {"points": k["coords"] or ""})
            for i, w in enumerate(k["words"] or [], 1):
                word = {"id": f"{k['line_id']}-w_{i:04d}", "text": w["text"] or ""}
                if w["word_error_score"] is not None:
                    word["error_score"] = f"{w['word_error_score']:.3f}"
                if (w["error_type"] or "none") != "none":
                    word["error_type"] = w["error_type"]
                ET.SubElement(line, "Word", word)
    ET.indent(page, "  ")
    return ET.tostring(page, encoding="unicode")


def nest(words_: DataFrame, pages: DataFrame) -> DataFrame:
    """Flat words (with coords) to one row per page; pages without words stay."""
    word = F.struct("word_ord", "text", "word_error_score", "error_type")
    line = words_.groupBy("page_id", "region_ord", "region_id", "region_type", "region_coords", "line_ord", "line_id", "line_coords").agg(F.array_sort(F.collect_list(word)).alias("words"))
    item = F.struct("line_ord", "line_id", F.col("line_coords").alias("coords"), "words")
    region = line.groupBy("page_id", "region_ord", "region_id", "region_type", "region_coords").agg(F.array_sort(F.collect_list(item)).alias("lines"))
    whole = region.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("region_ord", "region_id", "region_type", F.col("region_coords").alias("coords"), "lines"))).alias("regions"))
    return pages.join(whole, "page_id", "left")


def _file_system(folder: str):
    """The file system of a folder (a path, or a URI such as file:// or hdfs://) and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    where, root = _file_system(folder)
    for batch in batches:
        for record in batch.to_pylist():
            path = f"{root}/{os.path.basename(record['page_id'])}.xml"
            with where.open_output_stream(f"{path}.tmp") as out:
                out.write(page_xml(record).encode("utf-8"))
            where.move(f"{path}.tmp", path)
        yield batch.select(["page_id"])


def write_pages(nested: DataFrame, folder: str) -> int:
    """One file per page below ``folder``, which all executors must share; returns how many were written.

    A file appears whole or not at all, so a lost task can run again.
    """
    where, root = _file_system(folder)
    where.create_dir(root, recursive=True)
    return nested.where("page_id is not null").mapInArrow(partial(_write, folder=folder), "page_id string").count()
