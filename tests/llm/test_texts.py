"""Percentiles, spellings, pieces, containers, mixtures and shared spans on small fixtures."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafwright.llm import looks, mixing, packing, pieces, quantiles, spans, tokens

# --- percentiles ---


def values(spark, rows):
    return spark.createDataFrame(rows, "kind string, book_id string, vals array<double>")


def test_sketch_ranks_stay_within_the_bound_and_merge(spark):
    data = [float(x) for x in np.random.default_rng(1).lognormal(size=60_000)]
    df = spark.createDataFrame([("b", i % 7, x) for i, x in enumerate(data)], "book string, day int, v double").repartition(9)
    whole = quantiles.sketches(df, ["book"], "v", 400)
    parts = quantiles.merged(quantiles.sketches(df, ["book", "day"], "v", 400), ["book"], 400)
    order = np.sort(data)
    for sketch in (whole, parts):
        row = sketch.select("n", *[quantiles.quantile(q).alias(f"q{i}") for i, q in enumerate((0.01, 0.5, 0.95))]).first()
        assert row["n"] == 60_000
        for i, q in enumerate((0.01, 0.5, 0.95)):
            assert abs(np.searchsorted(order, row[f"q{i}"], side="right") / len(order) - q) <= 2 * quantiles.rank_error(400)


def test_off_figures_equal_counting(spark):
    rng = random.Random(3)
    groups = {f"b{i}": [rng.choice([rng.gauss(0, 1), 0.0, float(rng.randint(-2, 2))]) for _ in range(rng.choice([1, 2, 5, 60, 3000]))] for i in range(25)}
    rows = [("k", b, [*v[: len(v) // 2], None, float("nan")]) for b, v in groups.items()] + [("k", b, v[len(v) // 2 :]) for b, v in groups.items()] + [("k", "none", None), ("k", "empty", [])]
    figures, want = [], set()
    for b, v in groups.items():
        s = np.sort(v)
        for j, (q, x) in enumerate([(0.5, float(np.median(s))), (0.5, float(np.quantile(s, 0.53))), (0.95, float(np.quantile(s, 0.95))), (0.5, float(np.quantile(s, 0.52))), (0.95, 99.0)]):
            figures.append((b, "k", f"f{j}", q, x))
            below, upto = np.mean(s < x), np.mean(s <= x)
            if q < below - 0.02 or q > upto + 0.02:
                want.add((b, f"f{j}"))
    figures += [("empty", "k", "f", 0.5, 1.0), ("none", "k", "f", 0.5, 1.0), ("b0", "k", "n", 0.5, None), ("b0", "k", "m", 0.5, float("nan"))]
    f = spark.createDataFrame(figures + figures[:3], "book_id string, kind string, figure string, q double, x double")
    got = quantiles.off_figures(f, values(spark, rows), (0.5, 0.95), k=64).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_pages_count_once(spark):
    pages = spark.createDataFrame([("b", "p", 1, 1, [1.0], "k"), ("b", "p", 2, 2, [2.0], "k"), ("b", None, 1, 1, [3.0], "k")], "book_id string, page_id string, day int, loaded_at int, v array<double>, kind string")
    assert sorted(r["vals"] for r in quantiles.page_values(pages, F.col("v"), "x").collect()) == [[2.0], [3.0]]


# --- spellings ---


def test_spellings(spark):
    cases = {1: "Ｓｏｂａｌｄ", 2: "Grеnzsсhеunе", 3: "ſo", 4: "d\xade\u200br", 5: "Straβe", 6: "ﬆark", 7: "Mu\u0308de", 8: "Βrücke ", 9: "der", 10: "Der.", 11: "νόμος", 12: None, 13: "", 14: "\u200b", 15: "Haus．", 16: "(Ηaus)", 17: "x" * 50_000 + "\u200b"}
    lex = ["sobald", "Grenzscheune", "so", "der", "Straße", "stark", "müde", "Brücke", "Haus"]
    words = spark.createDataFrame([(i, t, 0) for i, t in cases.items()] + [(1, cases[1], 1)], "word_id bigint, text string, plain int")
    lexicon = spark.createDataFrame([(i, w) for i, w in enumerate(lex)], "lex_id bigint, word string")
    got = {r["word_id"]: lex[r["lex_id"]] for r in looks.lookalikes(words, lexicon).collect()}
    assert got == {1: "sobald", 2: "Grenzscheune", 3: "so", 4: "der", 5: "Straße", 6: "stark", 7: "müde", 8: "Brücke", 15: "Haus", 16: "Haus"}
    assert looks.lookalikes(words.where("1 = 0"), lexicon).count() == 0 and looks.lookalikes(words, lexicon.where("1 = 0")).count() == 0


def test_python_and_sql_spell_alike(spark):
    from leafwright.llm.channel import plain

    rng = random.Random(5)
    letters = [*looks.letter_map(), *looks.long_forms(), *"aäzß.,-̈\u200b\xa0\u2060 é1"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 9))) for _ in range(800)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    assert all(r["plain"] == plain(texts[r["i"]]) for r in looks.with_plain_text(df, "text", ("i",)).collect())


# --- pieces ---

word = st.sampled_from(["der", "Turm,", "steht.", "Mühlenwerk", "a", "x" * 45, "und"])


@settings(max_examples=80, deadline=None)
@given(st.lists(word, max_size=60), st.integers(20, 60), st.integers(0, 15), st.integers(1, 9))
def test_pieces_cover_all_words_within_the_limit(words, limit, overlap, per_line):
    ends = [i % per_line == 0 for i in range(len(words))]
    got = pieces.split_words(words, ends, limit, overlap)
    assert all(len(t) <= limit for *_, t in got)
    done = 0
    for first, end, again, text in got:
        assert first <= done <= end and len(" ".join(words[first : first + again])) <= max(overlap, 45)
        done = end
    assert done == len(words)
    if len(" ".join(words)) <= limit:
        assert len(got) == (1 if words else 0) and (not words or got[0][3] == " ".join(words))


def overlap_of(words, end, overlap):
    """How many words the longest run of whole words before ``end`` within the overlap has."""
    return max((k for k in range(end + 1) if len(" ".join(words[end - k : end])) <= overlap), default=0)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["der", "Turm,", "steht.", "Mühlenwerk", "a", "und"]), max_size=80), st.integers(30, 60), st.integers(0, 15), st.integers(1, 9), st.integers(0, 6))
def test_every_overlap_is_the_longest_that_fits(words, limit, overlap, per_line, carried):
    got = pieces.split_words(words, [i % per_line == 0 for i in range(len(words))], limit, overlap, carried)
    done = carried
    for first, end, again, text in got:
        assert again == overlap_of(words, done, overlap) == done - first and text == " ".join(words[first:end]) and len(text) <= limit
        done = end
    assert done == max(len(words), carried) or not got


def test_a_region_just_under_two_pieces_keeps_its_overlap():
    words, ends = ["wort"] * 392, [i % 10 == 9 for i in range(392)]  # 1,959 characters, a line end every 50
    got = pieces.split_words(words, ends, 1000, 100)
    assert len(got) == 3 and [again for _, _, again, _ in got] == [0, 20, 20] and max(len(t) for *_, t in got) <= 1000


def test_a_word_too_long_for_the_overlap_shortens_it_and_no_more():
    got = pieces.split_words(["aa", "bb", "cc", "x" * 48, "dd", "ee"], [False] * 6, 50, 8)
    assert [(again, t) for _, _, again, t in got] == [(0, "aa bb cc"), (0, "x" * 48), (0, "dd ee")]


def test_cuts_fall_on_sentence_ends_where_they_can():
    words = ("aaa bbb ccc. " * 12).split()
    got = pieces.split_words(words, [False] * len(words), 60, 0)
    assert all(t.endswith(".") for *_, t in got) and len(got) >= 3


def region(spark, texts, page="p", reg=0, lines_of=5):
    rows = [(i, page, reg, i // lines_of, i % lines_of, t, "c") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:1], "word_id bigint, page_id string, region_ord int, line_ord int, word_ord int, text string, items string")


def test_long_regions_only(spark):
    exact = ["x" * 99] * 9 + ["y" * 100]  # 991 letters and 9 blanks
    df = region(spark, exact).union(region(spark, [*exact, "z"], "q")).union(region(spark, [None, ""], "r")).union(region(spark, ["w" * 2500], None, None))
    got = {tuple(r) for r in pieces.oversized_items(df, ["page_id", "region_ord"]).collect()}
    assert got == {("q", 0), (None, None)}
    texts = pieces.split_items(df, ["page_id", "region_ord"]).collect()
    assert max(len(r["text"]) for r in texts) <= 1000 and {r["page_id"] for r in texts} == {"p", "q", "r", None}
    assert pieces.oversized_items(df.where("1 = 0"), ["page_id", "region_ord"]).count() == 0


def test_blocks_of_a_huge_item_keep_all_words(spark):
    words = [f"w{i}." for i in range(400)]
    df = region(spark, words)
    got = pieces.cut_items(df, ["page_id", "region_ord"], 100, 20, giant_chars=300).orderBy("block", "piece").collect()
    seen = [w for r in got for w in r["text"].split()[r["overlap_words"] :]]
    assert [w for w in dict.fromkeys(seen)] == words and all(len(r["text"]) <= 100 for r in got)


@pytest.mark.parametrize("partitions", [1, 3, 40])
@pytest.mark.parametrize("lines_of", [7, 100_000])
def test_a_giant_item_is_cut_in_stretches_like_any_other(spark, partitions, lines_of):
    """Over stretches of any length, on many lines or one: no word lost, limit kept, overlaps as long as fit."""
    rng = random.Random(partitions)
    words = [rng.choice(["der", "Turm,", "steht.", "Mühlenwerk", "a", "und", "b c"]) + str(i) for i in range(900)]
    df = region(spark, words, lines_of=lines_of).union(region(spark, ["kurz", "x" * 250, "lang"], "q")).union(region(spark, ["y" * 1300], "r"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = pieces.split_items(df, ["page_id", "region_ord"], 100, 20, giant_chars=600).collect()
        joined = {r["page_id"]: r["text"] for r in pieces.rejoined(spark.createDataFrame(got), ["page_id", "region_ord"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert joined == {"p": " ".join(words), "q": f"kurz {'x' * 250} lang", "r": "y" * 1300}
    mine = sorted((r for r in got if r["page_id"] == "p"), key=lambda r: (r["block"], r["piece"]))
    assert len({(r["block"], r["piece"]) for r in mine}) == len(mine) and max(len(r["text"]) for r in got) <= 100
    done = 0
    for r in mine:
        assert r["overlap_words"] == (overlap_of(words, done, 20) if done else 0)
        done = r["last_word"] + 1


# --- containers ---


def test_packing_keeps_every_item_and_the_capacity(spark):
    rng = random.Random(2)
    sizes = [rng.choice([rng.randint(1, 900), rng.randint(1, 100), 4096]) for _ in range(3000)] + [0, 9000, 8192, None]
    df = spark.createDataFrame([(i, s, 1) for i, s in enumerate(sizes)] + [(None, 5, 1)], "item bigint, size bigint, bin_no int")
    placed = packing.pack(df, 4096, group_items=256).collect()
    assert [r["size"] for r in placed if r["item"] == -1] == [5]
    loads, seen = {}, {}
    for r in placed:
        key = (r["epoch"], r["island"], r["bin_no"])
        loads[key] = loads.get(key, 0) + r["size"]
        seen.setdefault(r["item"], []).append((r["part"], r["size"]))
    assert max(loads.values()) <= 4096 and sum(loads.values()) == sum(s or 0 for s in sizes) + 5 and set(seen) == {-1, *range(len(sizes))}
    assert all(sum(x for _, x in v) == (sizes[i] or 0) and len(v) == max(1, -(-(sizes[i] or 0) // 4096)) for i, v in seen.items() if i >= 0)
    assert sum(loads.values()) / (4096 * len(loads)) > 0.98
    assert {r["item"] for r in packing.divided_items(spark.createDataFrame(placed)).collect()} == {3001, 3002}


def test_packing_nothing(spark):
    none = spark.createDataFrame([], "item bigint, size bigint")
    assert packing.pack(none).count() == 0 and packing.fill_report(packing.pack(none)).first()["containers"] == 0


def test_evolution_beats_or_equals_best_fit():
    for seed in range(5):
        rng = np.random.default_rng(seed)
        sizes = [int(x) for x in rng.integers(20, 60, 60)]
        bins: list = []
        packing._best_fit(list(range(60)), sizes, 100, bins, [])
        made = packing.evolve(sizes, 100, seed)
        assert sorted(i for b in made for i in b) == list(range(60)) and len(made) <= len(bins) and all(sum(sizes[i] for i in b) <= 100 for b in made)


# --- mixtures ---


def counted(spark):
    rows = [(i, s, n) for i, (s, n) in enumerate([("a", 100)] * 50 + [("b", 10)] * 30 + [("c", 7)] * 100 + [(None, 5)] * 4 + [("a", None)])]
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


def test_sources_that_fall_short(spark):
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 1), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    got = {r["source"]: r["falls_short"] for r in mixing.reach_report(counted(spark), targets).collect()}
    assert got == {"a": False, "b": True, "c": False, "none": True}


def test_budgets_are_met_to_one_text(spark):
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4)], "source string, target_share double, max_repeats int")
    plan = mixing.mixture_plan(counted(spark), targets)
    used = mixing.mixed(counted(spark), plan, block_tokens=200)
    tokens_of = {r["source"]: r["t"] for r in used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("t")).collect()}
    for p in plan:
        assert p["budget"] - max(100, 10, 7) <= tokens_of[p["source"]] <= p["budget"] + 1e-6
    most = {r["source"]: r["most_repeats"] for r in mixing.share_report(used, plan).collect()}
    assert most["a"] <= 1 and most["b"] <= 2 and most["c"] <= 4


def test_exponent_meets_the_cap():
    sizes, caps = [1000.0, 100.0, 10.0], [4.0, 4.0, 4.0]
    alpha = mixing.fitted_exponent(sizes, caps, 1110.0, 10.0)
    shares = mixing.tempered(sizes, alpha)
    assert max(p * 1110 / s for p, s in zip(shares, sizes, strict=True)) == pytest.approx(4.0, rel=1e-6)
    assert mixing.fitted_exponent([5.0, 5.0], [9, 9], 10.0, 1.0) == 0.0 and mixing.tempered([], 1.0) == [] and mixing.tempered([0.0], 0.5) == [0.0]


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Der Turm"), (2, ""), (3, None), (4, "<|endoftext|>")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.with_token_counts(df).collect()}
    assert got[2] == 0 and got[3] is None and got[1] == len(tokens.encoder(tokens.VOCABULARY).encode_ordinary("Der Turm")) and got[4] > 1


# --- shared spans ---


def brute(texts, least):
    """Pairs, and the covered places of each text."""
    pairs, covered = set(), {d: set() for d in texts}
    where = {}
    for d, t in texts.items():
        for i in range(len(t or "") - least + 1):
            where.setdefault(t[i : i + least], []).append((d, i))
    for places in where.values():
        docs = {d for d, _ in places}
        if len(docs) > 1:
            pairs |= {(a, b) for a in docs for b in docs if a < b}
            for d, i in places:
                covered[d] |= set(range(i, i + least))
    return pairs, covered


def documents(spark, texts):
    return spark.createDataFrame([(d, t, 1, 2) for d, t in texts.items()], "doc_id bigint, text string, digest int, pos int")


def test_spans_equal_brute_force(spark):
    rng = random.Random(7)
    passages = ["".join(rng.choices("abcde \n", k=rng.randint(15, 60))) for _ in range(6)] + ["·" * 50, "ab" * 30]
    texts = {}
    for d in range(80):
        parts = ["".join(rng.choices("abcde \n", k=rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 2)
            parts += [p[cut:], "".join(rng.choices("abcde \n", k=rng.randint(0, 20)))]
        texts[d] = "".join(parts)
    texts |= {80: None, 81: "", 82: texts[3], 83: texts[3]}
    pairs, covered = brute(texts, 24)
    docs = documents(spark, texts)
    got = spans.shared_pairs(docs, 24).collect()
    assert len(got) == len(pairs) and {tuple(r) for r in got} == pairs
    share = {r["doc_id"]: r["shared_chars"] for r in spans.shared_share(docs, 24).collect()}
    assert share == {d: len(c) for d, c in covered.items()}


def test_removal_keeps_the_earliest(spark):
    passage = "".join(random.Random(1).choices("abcdefgh", k=60))
    texts = {5: "xx" + passage, 2: passage + "yy", 9: "zz" + passage + "ww"}
    got = {(r["doc_id"], r["start"], r["end"]) for r in spans.shared_spans(documents(spark, texts), 40, earlier_only=True).collect()}
    assert got == {(5, 2, 62), (9, 2, 62)}


def test_no_documents(spark):
    assert spans.shared_pairs(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_chunks_of_a_very_long_text_find_the_same(monkeypatch):
    rng = np.random.default_rng(4)
    codes = rng.integers(97, 105, 5000).astype(np.uint32)
    whole = spans.anchors(codes, 20, 21, spans.Hasher())
    monkeypatch.setattr(spans, "CHUNK_CHARS", 600)
    at, digest = spans._long_anchors(codes, 20, 21, spans.Hasher())
    assert set(zip(whole[0].tolist(), whole[1].tolist(), strict=True)) <= set(zip(at.tolist(), digest.tolist(), strict=True))


# Texts and the spelling they must come out in, written down by hand, not taken from the operator's tables.
SPELLED = [
    ("Ｓｏｂａｌｄ　ｄｅｒ", "Sobald der"), ("Gren​z­scheune", "Grenzscheune"), ("ſo ﬁel der ﬅurm", "so fiel der sturm"), ("Mühle", "Mühle"),
    ("im Ⅳ. Jahr, №7", "im IV. Jahr, No7"), ("der  Turm", "der Turm"), ("eins\r\n  zwei drei", "eins\nzwei\ndrei"), ("Βrücke und Наus", "Brücke und Haus"),
    ("𝐓𝐮𝐫𝐦 ⑩", "Turm 10"), ("plain text, 1832.", "plain text, 1832."), ("", ""), (None, None), (" \t ", " "), ("a\x00b﻿", "ab"), ("Straβe", "Straße"),
]


def test_running_text_keeps_its_blanks_and_line_ends(spark):
    df = spark.createDataFrame([(i, t, 1) for i, (t, _) in enumerate(SPELLED)], "i int, text string, plain int")
    got = {r["i"]: r["plain"] for r in looks.with_plain_text(df, "text", ("i",), blank=True).collect()}
    assert [got[i] for i in range(len(SPELLED))] == [want for _, want in SPELLED]
    words = {r["i"]: r["plain"] for r in looks.with_plain_text(df, "text", ("i",)).collect()}
    assert [words[i] for i in range(len(SPELLED))] == [want and want.replace(" ", "").replace("\n", "") for _, want in SPELLED]
    assert looks.with_plain_text(df.where("1 = 0"), "text", ("i",), blank=True).count() == 0


def test_plain_texts_are_their_own_spelling():
    import duckdb

    con, letters = duckdb.connect(), [c for c in map(chr, range(0x20, 0x180)) if __import__("re").match(rf"[{looks.PLAIN}]", c)]
    assert len(letters) > 80
    got = con.execute(f"SELECT {looks.plain_sql('t')}, {looks.plain_sql('t', blank=True)} FROM (SELECT ?::VARCHAR AS t)", ["".join(letters)]).fetchone()
    assert got == ("".join(letters), "".join(letters))


def triplets(rng, n):
    """Sizes that fill n containers of 1,000 exactly, three each: best fit needs about a tenth more."""
    out = []
    for _ in range(n):
        a, b = rng.randint(380, 490), rng.randint(250, 300)
        out += [a, b, 1000 - a - b]
    return rng.sample(out, len(out))


def test_evolution_beats_best_fit():
    for seed, n in ((1, 20), (2, 40)):
        sizes = triplets(random.Random(seed), n)
        assert len(packing.evolve(sizes, 1000, seed)) < len(packing.first_packing(sizes, 1000))


def test_islands_hand_on_their_elites(spark):
    """Hard groups evolve on islands; in the next epoch each starts from its neighbour's best as well."""
    sizes = triplets(random.Random(4), 40)
    df = spark.createDataFrame([(7 if i < 5 else i, s) for i, s in enumerate(sizes)] + [(7, sizes[0])], "item bigint, size bigint")  # repeated ids
    best_fit = len(packing.first_packing([*sizes, sizes[0]], 1000))
    placed = packing.pack(df, 1000, group_items=200).collect()
    assert len(placed) == len(sizes) + 1 and len({(r["epoch"], r["island"], r["bin_no"]) for r in placed}) < best_fit
    rows = [(0, i, n, n, 0, 10, False, (n + i) % 2, -1) for i in range(3) for n in range(4)]
    moved = packing.migrated(spark.createDataFrame(rows, packing.ITEM), 3).collect()
    assert len(moved) == 12 and all(r["guest_bin"] == (r["row"] + (r["island"] - 1) % 3) % 2 for r in moved)


def test_items_that_do_not_stand_whole_are_told(spark):
    sizes = spark.createDataFrame([(1, 10), (2, 5000), (3, None)], "item bigint, size bigint")
    placed = packing.pack(sizes)
    assert {r["item"]: r["kept"] for r in packing.kept_items(placed, sizes).collect()} == {1: True, 2: True, 3: True}
    assert {r["item"]: r["kept"] for r in packing.kept_items(placed.where("part = 0"), sizes).collect()} == {1: True, 2: False, 3: True}
    assert not any(r["kept"] for r in packing.kept_items(placed, sizes, 4000).collect())


def test_a_text_too_long_for_the_rest_is_passed_over(spark):
    rows = [(i, "a", n) for i, n in enumerate([900, *[10] * 40])] + [(100 + i, "b", 10) for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.195, 3), ("b", 0.7, 2), ("c", 0.105, 1)], "source string, target_share double, max_repeats int")
    plan = mixing.mixture_plan(docs, targets)
    got = {r["source"]: r for r in mixing.share_report(mixing.mixed(docs, plan), plan).collect()}
    assert got["a"]["tokens"] == 390 and got["b"]["tokens"] == 1400 and got["c"]["tokens"] == 0
    assert {k: r["falls_short"] for k, r in got.items()} == {"a": False, "b": False, "c": True}


def test_exponents_beyond_one_and_caps_that_cannot_be_kept():
    sizes = [1000.0, 100.0, 10.0]
    wanted = mixing.entropy(mixing.tempered(sizes, 2.5))
    alpha = mixing.fitted_exponent(sizes, [9.0] * 3, 1110.0, wanted)
    assert alpha == pytest.approx(2.5) and mixing.within_caps(alpha, sizes, [9.0] * 3, 1110.0)
    assert not mixing.within_caps(mixing.fitted_exponent(sizes, [0.5] * 3, 1110.0, 9.0), sizes, [0.5] * 3, 1110.0)


@pytest.mark.parametrize("hot", [0, 3])
def test_crowded_digests_are_grouped_by_windows(spark, hot):
    """A formula in many surroundings: grouping windows gives what comparing all pairs gives."""
    rng = random.Random(11)
    formula = "".join(rng.choices("abcdefgh", k=14))
    endings = ["".join(rng.choices("abcdefgh", k=12)) for _ in range(5)]
    texts = {d: "".join(rng.choices("abcdefgh", k=rng.randint(0, 12))) + rng.choice(endings)[6:] + formula + rng.choice(endings)[: rng.randint(0, 12)] + "".join(rng.choices("abcdefgh", k=5)) for d in range(60)}
    pairs, covered = brute(texts, 20)
    docs = documents(spark, texts)
    assert {tuple(r) for r in spans.shared_pairs(docs, 20, hot=hot).collect()} == pairs and pairs
    for earlier in (False, True):
        got, want = ({tuple(r) for r in spans.shared_spans(docs, 20, earlier, hot=h).collect()} for h in (hot, 10_000))
        assert got == want
    assert sum(r["end"] - r["start"] for r in spans.shared_spans(docs, 20, hot=hot).collect()) == sum(map(len, covered.values()))


def test_what_remains_keeps_its_offsets(spark):
    passage = "".join(random.Random(1).choices("abcdefgh", k=60))
    texts = {5: "xx" + passage, 2: passage + "yy", 9: "zz" + passage + "ww", 11: passage, 12: None, 13: ""}
    got = {tuple(r) for r in spans.remaining(documents(spark, texts), 40).collect()}
    assert got == {(2, 0, 62, passage + "yy"), (5, 0, 2, "xx"), (9, 0, 2, "zz"), (9, 62, 64, "ww")}


def test_empty_tables_and_clashing_columns(spark):
    """No rows in, no rows out, whatever else the tables hold."""
    docs = spark.createDataFrame([], "doc_id bigint, text string, start int, end int, window string, doc_a int")
    assert spans.remaining(docs).count() == 0 and spans.shared_share(docs).count() == 0 and spans.shared_spans(docs, hot=0).count() == 0
    words = spark.createDataFrame([], "word_id bigint, page_id string, region_ord int, line_ord int, word_ord int, text string, piece int, block int, most int, ends string")
    cut = pieces.split_items(words, ["page_id", "region_ord"])
    assert cut.count() == 0 and pieces.rejoined(cut, ["page_id", "region_ord"]).count() == 0
    sizes = spark.createDataFrame([], "item bigint, size bigint, grp int, row int, bin_no int")
    assert packing.kept_items(packing.pack(sizes), sizes).count() == 0 and packing.divided_items(packing.pack(sizes)).count() == 0
    counted_ = spark.createDataFrame([], "doc_id bigint, source string, n_tokens bigint, block int, room int, span int")
    targets = spark.createDataFrame([("a", 0.5, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    for plan in (mixing.mixture_plan(counted_, targets), mixing.mixture_plan(counted_)):
        report = mixing.share_report(mixing.mixed(counted_, plan), plan).collect()
        assert all(r["tokens"] == 0 and not r["falls_short"] for r in report)


def test_null_sources_sizes_and_ids(spark):
    rows = [(1, "a", 10), (1, "a", 10), (None, "a", 5), (2, None, 50), (3, "a", None), (4, "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 3), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    plan = mixing.mixture_plan(docs, targets)
    got = {r["source"]: (r["tokens"], r["falls_short"]) for r in mixing.share_report(mixing.mixed(docs, plan), plan).collect()}
    assert got["b"] == (0, True) and got["a"][0] <= 15 and not got["a"][1] and set(got) == {"a", "b"}
