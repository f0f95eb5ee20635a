"""Hand-made expectations for text, numeric, similarity and geometry functions."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafwright.functions import geometry as geo
from leafwright.functions import numeric as nm
from leafwright.functions import similarity as sim
from leafwright.functions import text as tx


def one(spark, column, *values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"t {kind}").select(column).collect()]


def test_text_forms(spark):
    t = F.col("t")
    assert one(spark, tx.normal_supervised(t), " Grö ße  X", None, "") == ["gro ße x", None, ""]
    assert one(spark, tx.normal_hybrid(t), "Straße") == ["strasse"]
    assert one(spark, tx.normal_chunk(t), "Haus-Tür ſo") == ["haustür so"]
    assert one(spark, tx.normal_gold(t), "a⸗b – c") == ["a-b - c"]
    assert one(spark, tx.tokens(t), "Stein⸗weg, Größe_1!", "") == [["Stein", "weg", "Größe_1"], []]
    assert one(spark, tx.merge_marked(t), "Wein⸗\nberg\n\nist") == ["Weinberg ist"]
    assert one(spark, tx.historical(t), "ſo ä", None) == ["so ä", None]
    assert one(spark, tx.join_hyphens(t), "a- b- c- d", "Ab- Cd") == ["abcd", "Ab- Cd"]
    assert one(spark, tx.is_page_number(t), "— 12 —", "-7", "12a", "12") == [True, True, False, True]
    assert one(spark, tx.escaped(t), "<a&'\">") == ["&lt;a&amp;&#x27;&quot;&gt;"]
    assert one(spark, tx.file_stem(t), "a\\b/c.d.xml", "x") == ["c.d", "x"]
    assert one(spark, tx.base_name(t), "a/c.d.xml") == ["c"]
    assert one(spark, tx.readable_size(t), 0, 999, 1024, 3 * 1024**2, None, kind="bigint") == ["0 B", "999.0 B", "1.0 KB", "3.0 MB", None]


def test_sentences(spark):
    got = one(spark, tx.sentences(F.col("t")), "Nr. 5. Abschnitt ist da. Er kam... dann. Ja", "Dr. Müller kam.", "", "Auf S.. Weiter")
    assert got == [["Nr. 5. Abschnitt ist da.", "Er kam... dann.", "Ja"], ["Dr.", "Müller kam."], [], ["Auf S.. Weiter"]]


def test_characters_keep_their_places(spark):
    got = one(spark, tx.mapped_characters(F.col("t")), "aßb")[0]
    assert got["text"] == "assb" and got["places"] == [0, 1, 1, 2]


def test_p_value_against_known_points():
    assert nm.correlation_p(0.0, 10) == pytest.approx(1.0)
    assert nm.correlation_p(0.5, 20) == pytest.approx(0.0248, abs=2e-4)
    assert nm.correlation_p(0.9, 5) == pytest.approx(0.0374, abs=2e-4)
    assert nm.correlation_p(1.0, 5) == 0.0 and nm.correlation_p(None, 9) is None and nm.correlation_p(0.3, 2) is None


def test_similarity(spark):
    assert sim.partial_token_ratio([], ["a"]) == 1.0 and sim.partial_token_ratio(["b"], ["a", "b"]) == 1.0
    df = spark.createDataFrame([("abc", "abd"), ("", "x"), (None, "x")], "a string, b string")
    assert [round(r[0], 4) for r in df.select(sim.text_ratio("a", "b")).collect()] == [0.6667, 0.0, 0.0]
    phrases = spark.createDataFrame([(["a", "b", "a", "b"], ["a", "b"]), (["a"], []), ([], ["a"])], "w array<string>, p array<string>")
    assert [r[0] for r in phrases.select(sim.phrase_places(F.col("w"), F.col("p"))).collect()] == [[0, 2], [], []]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text("abä", max_size=17), max_size=12, unique=True), st.lists(st.text("abä", max_size=17), max_size=12, unique=True))
def test_near_pairs_are_those_of_brute_force(spark, forms, words):
    a, b = spark.createDataFrame([(x,) for x in forms], "form string"), spark.createDataFrame([(x,) for x in words], "listed string")
    every = a.crossJoin(b).where(sim.within_edits(F.col("form"), F.col("listed"))).select("form", "listed", F.levenshtein("form", "listed"))
    assert sorted(map(tuple, sim.near_pairs(a, b).collect())) == sorted(map(tuple, every.collect()))


def test_near_pairs_differ_in_any_letter(spark):
    forms = spark.createDataFrame([("nühlenwerk",), ("xa",), ("",)], "form string")
    words = spark.createDataFrame([("mühlenwerk",), ("ühlenwerke",), ("a",), ("turm",)], "listed string")
    assert sorted(map(tuple, sim.near_pairs(forms, words).collect())) == [("", "a", 1), ("nühlenwerk", "mühlenwerk", 1), ("nühlenwerk", "ühlenwerke", 2), ("xa", "a", 1)]


def test_points_and_shoelace(spark):
    pts = geo.points(F.col("t"))
    got = spark.createDataFrame([("0,0 4,0 4,3 0,3",), ("1,1 bad 2,2",), ("",), (None,)], "t string").select(F.size(pts), geo.area(pts)).collect()
    assert [tuple(r) for r in got] == [(4, 12.0), (2, 0.0), (0, 0.0), (0, 0.0)]


SQUARE, L_SHAPE = "0,0 10,0 10,10 0,10", "0,0 10,0 10,4 4,4 4,10 0,10"


@pytest.mark.parametrize(("a", "b", "area"), [(SQUARE, SQUARE, 100), (SQUARE, "5,5 15,5 15,15 5,15", 25), (SQUARE, "10,0 20,0 20,10 10,10", 0), (L_SHAPE, SQUARE, 64), (L_SHAPE, "4,4 10,4 10,10 4,10", 0), (SQUARE, "5,-5 15,5 5,15 -5,5", 100), ("0,0 10,10 10,0 0,10", SQUARE, 50), ("1,1 2,2", SQUARE, 0)])
def test_intersections(a, b, area):
    assert geo.intersection_area(geo.ring(a), geo.ring(b)) == pytest.approx(area)
    assert geo.intersection_area(geo.ring(b), geo.ring(a)) == pytest.approx(area)
    assert geo.common_area(a, b) == geo.common_area(b, a) == pytest.approx(area)


corner = st.tuples(st.integers(0, 30), st.integers(0, 30))


@settings(max_examples=200, deadline=None)
@given(st.lists(corner, min_size=3, max_size=5), st.lists(corner, min_size=3, max_size=5))
def test_clipping_equals_slabs(a, b):
    x, y = (" ".join(f"{p},{q}" for p, q in c) for c in (a, b))
    assert geo.common_area(x, y) == pytest.approx(geo.intersection_area(geo.ring(x), geo.ring(y)), abs=1e-6)


def test_a_star_is_not_convex():
    assert geo.convex("0,3 6,3 1,7 3,0 5,7") is None and geo.convex(L_SHAPE) is None and geo.convex(SQUARE)


box = st.tuples(*[st.integers(0, 40)] * 4).filter(lambda b: b[0] < b[2] and b[1] < b[3])


@settings(max_examples=60, deadline=None)
@given(box, box, st.integers(-9, 9))
def test_rectangles_have_a_closed_form(a, b, shift):
    text = lambda r: f"{r[0] + shift},{r[1]} {r[2] + shift},{r[1]} {r[2] + shift},{r[3]} {r[0] + shift},{r[3]}"
    want = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    assert geo.intersection_area(geo.ring(text(a)), geo.ring(text(b))) == pytest.approx(want)


def test_ring_skips_flat_edges():
    assert len(geo.ring(SQUARE)) == 2 and np.isfinite(geo.ring(L_SHAPE)).all() and math.isclose(geo.polygon_area(geo.ring(L_SHAPE)), 64)
