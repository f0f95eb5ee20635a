"""Page files read and written, interchange tables, and the file stream."""

import json

from pyspark.sql import functions as F

from leafwright.sources import pagexml, tables
from leafwright.streaming import incremental

RAW = """<?xml version="1.0"?><PcGts xmlns="http://schema.example/page"><Metadata/><Page imageFilename="p.png" imageHeight="10" imageWidth="20">
<TextRegion id="r1" type="page-number"><Coords points="0,0 5,0 5,5"/><TextLine id="l1"><Coords points="0,0 5,0"/><TextEquiv><Unicode></Unicode></TextEquiv><TextEquiv><Unicode>Der  alte Turm</Unicode></TextEquiv></TextLine>
<TextLine id="l2"><Coords points="0,0 5,0 5,5 0,5"/><Word><TextEquiv><Unicode>ein</Unicode></TextEquiv></Word><Word><TextEquiv><Unicode>Wort</Unicode></TextEquiv></Word></TextLine></TextRegion>
<TextRegion id="r2"/><TextRegion id="r3" type="caption"/></Page></PcGts>"""


def test_raw_files(spark, tmp_path):
    (tmp_path / "one.xml").write_text(RAW)
    (tmp_path / "note.txt").write_text("no page")
    pages = pagexml.read_pages(spark, str(tmp_path)).cache()
    p = pages.first()
    assert (p["page_id"], p["image_height"], p["raw_image_filename"], p["overwrite_page_error"]) == ("one", 10, "p.bin.png", None)
    assert [r["region_type"] for r in pagexml.regions(pages).orderBy("region_ord").collect()] == ["page_number", "paragraph", "other"]
    assert [r["text"] for r in pagexml.words(pages).orderBy("line_ord", "word_ord").collect()] == ["Der", "alte", "Turm", "ein", "Wort"]
    assert [r["n_points"] for r in pagexml.lines(pages).orderBy("line_ord").collect()] == [2, 4]


def test_written_pages_read_back(spark, tmp_path):
    kind = "page_id string, region_ord int, region_id string, region_type string, region_coords string, line_ord int, line_id string, line_coords string, word_ord int, text string, word_error_score double, error_type string"
    rows = [("a", 0, "r", "heading", "0,0 1,1", 0, "l", "0,0", 0, 'Tür & "x"', 0.25, "ocr"), ("a", 0, "r", "heading", "0,0 1,1", 0, "l", "0,0", 1, "zu", None, "none"), ("a", 1, "s", "paragraph", None, 0, "m", None, 0, "ſo", 1.0, "error")]
    words = spark.createDataFrame(rows, kind)
    pages = spark.createDataFrame([("a", "a.bin.png", 5, 6, 0.5), ("b", "b.bin.png", 5, 6, None)], "page_id string, image_filename string, image_height int, image_width int, overwrite_page_error double")
    assert pagexml.write_pages(pagexml.nest(words, pages), str(tmp_path)) == 2
    back = pagexml.read_pages(spark, str(tmp_path)).cache()
    assert {r["page_id"]: r["overwrite_page_error"] for r in back.collect()} == {"a": 0.5, "b": None}
    got = [(r["region_ord"], r["word_ord"], r["text"], r["word_error_score"], r["error_type"]) for r in pagexml.words(back).orderBy("region_ord", "word_ord").collect()]
    assert got == [(0, 0, 'Tür & "x"', 0.25, "ocr"), (0, 1, "zu", None, "none"), (1, 0, "ſo", 1.0, "error")]
    assert [r["reason"] for r in pagexml.predicted_words(pagexml.words(back)).collect()] == ["type"]


def test_words_that_look_like_null_stay_words(spark, tmp_path):
    (tmp_path / "c.csv").write_text("word,line_id,paragraph_id,word_position,perplexity,is_error,page_id\nNA,l,p,0,1.5,true,x\nnull,l,p,1,,false,x\n")
    got = tables.read_csv(spark, str(tmp_path / "c.csv"), tables.CHUNK_WORDS).collect()
    assert [(r["word"], r["perplexity"]) for r in got] == [("NA", 1.5), ("null", None)]


def test_json_objects_and_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"Filename": "f", "ColoredTextHTML": "h"}))
    (tmp_path / "b.json").write_text(json.dumps([{"Filename": "g", "ColoredTextHTML": "h"}] * 2))
    got = tables.read_json(spark, str(tmp_path), tables.COLOURED)
    assert sorted((r["file"], r["Filename"]) for r in got.collect()) == [("a", "f"), ("b", "g"), ("b", "g")]


def test_sinks_and_rates(spark, tmp_path):
    labels = spark.createDataFrame([("a", "error"), ("a", "correct"), ("b", "correct")], "file_id string, label string")
    rates = tables.error_rates(labels)
    tables.write_csv(rates, str(tmp_path / "r"))
    assert {r["file_id"]: r["error_rate"] for r in tables.read_csv(spark, str(tmp_path / "r"), tables.ERROR_RATES).collect()} == {"a": 0.5, "b": 0.0}
    pages = spark.createDataFrame([("a", 1.0), ("z", 2.0)], "page_id string, f double")
    assert [r["page_id"] for r in tables.features_with_rates(pages, rates).collect()] == ["a"]
    tables.write_region_dump(spark.createDataFrame([("p", 0, None, "0,0")], "page_id string, region_ord int, region_type string, coords string"), str(tmp_path / "d"))
    assert spark.read.text(str(tmp_path / "d")).first()[0] == "p [Region 0] Type: unknown Polygon: 0,0"


def test_each_arrival_is_scored_once(spark, tmp_path):
    kind = "page_id string, book_id string, word_smoothed_ppl_page array<double>"
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.createDataFrame([("a", "x", [50.0, 500.0, None]), ("b", "x", None)], kind).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    first = incremental.score_arrivals(spark, source, schema, target, check)
    assert {r["page_id"]: r["score"] for r in first.collect()} == {"a": 0.5, "b": 0.0}
    spark.createDataFrame([("c", "x", [500.0])], kind).write.mode("append").parquet(source)
    assert incremental.score_arrivals(spark, source, schema, target, check).count() == 3
    assert incremental.score_arrivals(spark, source, schema, target, check).count() == 3


def test_event_windows(spark):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type, 1.0D AS value UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a', 2.0D")
    assert [(r["n"], r["total"]) for r in incremental.event_windows(rows).collect()] == [(2, 3.0)]
    assert incremental.event_windows(rows.where(F.lit(False))).count() == 0


def test_gold_pages_as_word_lists(spark, tmp_path):
    (tmp_path / "one.xml").write_text(RAW)
    (tmp_path / "empty.xml").write_text('<PcGts><Page imageFilename="p.png" imageHeight="1" imageWidth="1"></Page></PcGts>')
    (tmp_path / "bad.xml").write_text("<PcGts><Page><TextRegion></Page>")
    got = {r["page_id"]: (list(r["words"]), r["corrupt"]) for r in pagexml.gold_words(pagexml.read_pages(spark, str(tmp_path))).collect()}
    assert got["one"] == (["Der", "alte", "Turm", "ein", "Wort"], False) and got["empty"] == ([], False)
    assert "bad" not in got or got["bad"] == ([], True)
