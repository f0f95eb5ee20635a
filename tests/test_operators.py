"""Windows, islands, ranks, books, labels, alignment and layout scores on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafwright.operators import chunks, features, labels, layout, statistics


def test_windows_cover_all_words_and_one_reaches_the_end(spark):
    for size, overlap in ((5, 2), (3, 3), (20, 10), (1, 0)):
        rows = spark.createDataFrame([(n, [str(i) for i in range(n)]) for n in range(31)], "n int, w array<string>")
        got = {}
        for r in chunks.word_chunks(rows, ["n"], "w", size, overlap).collect():
            got.setdefault(r["n"], []).append((r["start_word_id"], r["end_word_id"]))
        for n in range(31):
            want, i, step = [], 0, max(1, size - overlap)
            while n:
                want.append((i, min(i + size, n) - 1))
                if i + size >= n:
                    break
                i += step
            assert sorted(got.get(n, [])) == want


def test_islands(spark):
    rows = [("p", i, w, f"l{i}", w in "xyz") for i, w in enumerate("axybzz")]
    df = spark.createDataFrame(rows, "page string, pos int, word string, line string, bad boolean")
    got = chunks.islands(df, ["page"], "pos", F.col("bad"), {"word": "words", "line": "lines"}).collect()
    assert sorted((r["start_idx"], r["end_idx"], "".join(r["words"])) for r in got) == [(1, 2, "xy"), (4, 5, "zz")]


def test_average_ranks_and_statistics(spark):
    values = [3.0, 1.0, 3.0, 2.0, 3.0, 1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "page_id int, score double")
    got = {r["page_id"]: r["r"] for r in statistics.average_rank(df, "score", "r").collect()}
    assert [got[i] for i in range(6)] == [5.0, 1.5, 5.0, 3.0, 5.0, 1.5]
    s = statistics.with_p_values(statistics.paired_statistics(df, df)).first()
    assert s["n"] == 6 and s["rmse"] == 0 and s["spearman"] == pytest.approx(1) and s["pearson_p"] == pytest.approx(0, abs=1e-9)
    assert statistics.paired_statistics(df, df.where("score > 9")).first()["n"] == 0


def test_books_with_ties_nulls_and_nothing(spark):
    rows = [("a", "p2", 0.5), ("a", "p1", 0.5), ("a", "p3", None), ("b", "q", None)]
    got = {r["book_id"]: r for r in statistics.book_summary(spark.createDataFrame(rows, "book_id string, page_id string, score double")).collect()}
    assert got["a"]["num_pages"] == 2 and got["a"]["best_page_id"] == got["a"]["worst_page_id"] == "p1"
    assert got["b"]["num_pages"] == 0 and got["b"]["best_page_id"] is None and got["b"]["mean_score"] is None


def test_pages_without_words_score_zero(spark):
    pages = spark.createDataFrame([("a", -1.0), ("b", 0.7), ("c", None)], "page_id string, o double")
    words = spark.createDataFrame([("a", "error"), ("a", "none"), ("b", "none")], "page_id string, error_type string")
    got = statistics.page_error_scores(words, pages, F.col("error_type") != "none", "o").collect()
    assert {r["page_id"]: r["score"] for r in got} == {"a": 0.5, "b": 0.7, "c": 0.0}


def lines(*rows):
    return [{"words": r[0].split(), "kind": r[1] if len(r) > 1 else "paragraph", "para": r[2] if len(r) > 2 else "x"} for r in rows]


def test_labels():
    truth = lines(("der alte turm steht",), ("am neuen tor",), ("rand", "marginalia"))
    got = labels.label_page(lines(("rand",), ("der alte turm steht",), ("am ncuen tor rand",), ("",)), truth)
    assert got == [["correct"], ["correct"] * 4, ["correct", "error", "correct", "error"], []]
    assert labels.label_page(lines(("am rand tor",)), lines(("am neuen tor",), ("rand", "marginalia"), ("x", "heading"))) == [["correct", "error", "correct"]]
    assert labels.label_page([], truth) == [] and labels.label_page(lines(("a",)), []) == [["error"]]


def test_most_similar_equals_trying_all():
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdeß ", k=rng.randint(1, 25))) for _ in range(60)]
    known = list(enumerate(texts))
    shapes = np.array([labels._shape(t) for t in texts])
    for _ in range(60):
        t = rng.choice([rng.choice(texts), "".join(rng.choices("abcdeß xyz", k=12))])
        best, at = 0.0, None
        for j, o in known:
            if labels.ratio(t, o) > best:
                best, at = labels.ratio(t, o), j
        assert labels._most_similar(t, known, shapes) == (best, at)


def test_alignment_takes_divided_words_together():
    assert labels.align(["Wein⸗", "berg", "ist"], ["weinberg", "ist"]) == [0, 0, 1]
    assert labels.align(["Wein⸗", "berg"], ["ganz", "anders"]) == [0, 1]
    assert labels.align(["a", "b", "c"], ["a"]) == [0, -1, -1] and labels.align([], ["a"]) == []


def test_predicted_errors():
    regions = [("paragraph", "der alte turm steht".split()), ("header", ["kopf"])]
    assert labels.judge_predictions([("turm", "alte turm steht"), ("kopf", "kopf"), ("", "x")], regions) == (1, 1, 1)
    assert labels.judge_predictions([], regions) == (0, 0, 1)


def rect(x0, y0, x1, y1):
    return f"{x0},{y0} {x1},{y0} {x1},{y1} {x0},{y1}"


def test_region_penalties():
    a, b = rect(0, 0, 10, 10), rect(20, 0, 30, 10)
    assert layout.match_penalty([("paragraph", a)], [a]) == 0
    assert layout.match_penalty([("paragraph", a), ("paragraph", b)], [a]) == 0.5
    assert layout.match_penalty([("header", a)], [b]) == 2.0
    assert layout.match_penalty([("header", a)], [rect(0, 0, 10, 5), rect(0, 5, 10, 10)]) == 2.0
    assert layout.match_penalty([], [a]) == 1.0 and layout.match_penalty([("paragraph", "")], []) == 0.5


def test_overlay_decisions(spark):
    flat = "page_id string, ord int, region_ord int, coords string"
    ln = spark.createDataFrame([("p", 0, 0, rect(0, 0, 100, 10)), ("p", 1, 0, rect(0, 95, 100, 105)), ("p", 2, 1, rect(0, 300, 100, 310)), ("p", 3, 0, ""), ("p", 4, 2, rect(0, 200, 100, 210))], flat)
    gt = spark.createDataFrame([("p", 0, "paragraph", rect(0, 0, 100, 100)), ("p", 1, "other", rect(0, 200, 100, 230))], "page_id string, ord int, type string, coords string")
    pred = spark.createDataFrame([("p", 0, rect(0, 0, 100, 110)), ("p", 1, rect(0, 290, 100, 320)), ("p", 2, rect(0, 200, 100, 230))], "page_id string, region_ord int, coords string")
    p = layout.measured(pred, "coords").select("page_id", "region_ord", F.col("coords").alias("region_coords"), F.col("polygon_area").alias("region_area"))
    got = layout.overlay_verdicts(layout.measured(ln, "coords"), p, layout.measured(gt, "coords")).collect()
    kinds = {r["ord"]: (r["error_type"], r["score"]) for r in got}
    assert kinds == {0: ("none", 0.0), 1: ("hallucination", 1.0), 2: ("hallucination", 1.0), 3: ("error", 1.0), 4: ("none", 0.0)}


def test_features_of_odd_pages(spark):
    kind = "page_id string, region_ord int, line_ord int, text string"
    rows = [("a", 0, 0, "ab"), ("a", 0, 0, "12"), ("a", 0, 1, None), ("a", 1, 0, ""), ("b", None, None, None)]
    got = {r["page_id"]: r for r in features.page_features(spark.createDataFrame(rows, kind)).collect()}
    a, b = got["a"], got["b"]
    assert (a["n_regions"], a["n_lines"], a["n_words"], a["max_chars_per_line"], a["numeric_ratio"], a["n_empty_regions"], a["n_empty_lines"]) == (2, 3, 2, 5, 0.5, 1, 2)
    assert b["n_words"] == 0 and b["mean_word_len"] == 0 and b["empty_line_share"] == 1


def test_hybrid_puts_the_last_overlapping_line_before(spark):
    ln = spark.createDataFrame([("p", 0, 0, rect(0, 200, 100, 210), "kopf "), ("p", 1, 0, rect(0, 0, 100, 10), "der alte turm"), ("p", 2, 0, rect(0, 20, 100, 30), "zzzz qqqqq wwww yyyyy")], "page_id string, ord int, region_ord int, coords string, text string")
    gt = spark.createDataFrame([("p", 0, "paragraph", rect(0, 0, 100, 100), "kopf der alte turm steht".split(), "x"), ("p", 1, "other", rect(0, 200, 100, 230), ["kopf"], "x")], "page_id string, ord int, type string, coords string, tokens array<string>, first_line string")
    pred = spark.createDataFrame([("p", 0, rect(0, 0, 100, 230))], "page_id string, region_ord int, coords string")
    p = layout.measured(pred, "coords").select("page_id", "region_ord", F.col("coords").alias("region_coords"), F.col("polygon_area").alias("region_area"))
    got = layout.overlay_verdicts(layout.measured(ln, "coords"), p, layout.measured(gt, "coords"), with_text=True).collect()
    assert {r["ord"]: r["error_type"] for r in got} == {0: "error", 1: "none", 2: "merge"}


def test_percentiles_are_exact_over_narrowed_bands(spark):
    """Bands of a few values, ties, one group with most rows, null keys, null values: as Spark's own percentile."""
    from leafwright.operators.percentiles import percentiles

    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "a", "b", None]), rng.choice([rng.gauss(0, 1), rng.expovariate(1), 0.0, 7.0, None])) for _ in range(6000)] + [("c", 1.5), ("d", None)]
    rows += [("two", float(i % 2)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, v double")
    points = {"mid": 0.5, "hi": 0.95}
    for by in (None, ["k"]):
        want = df.where("v is not null").groupBy(*(by or [])).agg(*[F.percentile("v", F.lit(q)).alias(n) for n, q in points.items()]).collect()
        for band in (100, 100_000):
            got = percentiles(df, "v", points, by, band=band).collect()
            key = lambda r: (str(r[0]), r[-1])
            assert len(got) == len(want)
            for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
                assert tuple(g) == pytest.approx(tuple(w), abs=1e-12) if by is None else (g["k"] == w["k"] and tuple(g)[1:] == pytest.approx(tuple(w)[1:], abs=1e-12))
    assert tuple(percentiles(df.where("1 = 0"), "v", points).first()) == (None,) * 2 and percentiles(df.where("1 = 0"), "v", points, ["k"]).count() == 0


def test_a_model_of_any_size_gives_the_same_probabilities(spark, monkeypatch):
    from leafwright.operators import language

    words = spark.createDataFrame([(i, w) for i, w in enumerate("der der der Turm steht DER und und x".split() + [None])], "i int, word string")
    model = language.unigrams(words)
    want = sorted(language.with_logp(words, model).collect(), key=lambda r: r["i"])
    monkeypatch.setattr(language, "MAX_WORDS", 2)
    monkeypatch.setattr(language, "HOT_WORDS", 2)
    assert sorted(language.with_logp(words, model).collect(), key=lambda r: r["i"]) == want and len(want) == 10


def test_token_scores_have_places_and_none_for_the_first(spark):
    from leafwright.operators import language

    texts = spark.createDataFrame([(1, "Der  Turm x"), (2, " "), (3, None), (4, "")], "doc bigint, text string")
    scorer = language.UnigramScorer({"der": -1.0, "turm": -2.0})
    want = [(1, 0, "Der", 0, 3, None), (1, 1, "Turm", 5, 9, -2.0), (1, 2, "x", 10, 11, -20.0)]
    for held in (scorer, spark.sparkContext.broadcast(scorer)):
        assert [tuple(r) for r in language.token_scores(texts, ["doc"], "text", held).orderBy("pos").collect()] == want
    assert language.token_scores(texts.where("1 = 0"), ["doc"], "text", scorer).count() == 0


def test_a_view_by_an_unknown_method_is_refused(spark):
    from leafwright.plans import scores

    with pytest.raises(ValueError, match="unknown method"):
        scores.page_view(spark, "nowhere", "colour")


def test_a_trained_model_is_kept_and_loaded(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"p{i}", *[rng.random() for _ in features.FEATURES], "der Turm steht" if i % 2 else "das Haus") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id string, " + ", ".join(f"{f} double" for f in features.FEATURES) + ", text string")
    made = features.hashed_embedding(df, "text", 8).withColumn("label", (F.length("text") > 8).cast("double"))
    model, metrics = features.train(made, "label", {"numTrees": [5], "maxDepth": [4]}, folds=2)
    assert metrics["rmse"] < 0.3  # only the embedding tells
    features.save_model(model, f"file://{tmp_path}/m")
    want, got = (sorted(map(tuple, features.score_pages(m, made).collect())) for m in (model, features.load_model(f"file://{tmp_path}/m")))
    assert got == want and len(got) == 60


def test_rows_without_a_key_are_kept_apart(spark):
    from leafwright import corpus

    rows = [("p", 1, "a"), ("p", 1, "a"), ("p", 2, "b"), ("p", None, "c"), ("p", None, "d"), ("p", None, "d"), (None, 1, "e"), (None, 1, "f")]
    got = corpus.once(spark.createDataFrame(rows, "page_id string, word_id int, text string"), "page_id", "word_id", apart=("text",)).collect()
    assert sorted(r["text"] for r in got) == ["a", "b", "c", "d", "e", "f"]
