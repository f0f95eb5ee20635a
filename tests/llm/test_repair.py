"""Page repair on hand-made books."""

import pytest

from leafwright.llm import channel, furniture, repair

LEX = [("der", 900), ("die", 900), ("das", 500), ("und", 800), ("oder", 300), ("alte", 50), ("Turm", 40), ("steht", 60), ("Mühlenwerk", 5), ("Salzweg", 4), ("Holzweg", 4), ("unter", 70), ("Tor", 40), ("wieder", 30), ("wie", 50), ("dem", 400), ("Haus", 60), ("sehr", 50), ("Zeit", 40), ("hier", 30)]
KIND = "word_id bigint, page_id string, book_id string, region_ord int, region_id string, region_type string, line_ord int, line_id string, word_ord int, text string, loaded_at int, kind string"


def book(spark, pages, book_id="b", types=None):
    """pages: lists of regions, each a list of lines."""
    rows, n = [], 0
    for p, regions in enumerate(pages, 1):
        for r, lines in enumerate(regions):
            for k, line in enumerate(lines):
                for w, text in enumerate(line.split("|") if "|" in line else line.split()):
                    n += 1
                    kind = (types or {}).get((p, r), "paragraph")
                    rows.append((n, f"{book_id}_{p:08d}", book_id, r, f"r{r}", kind, k, f"l{k}", w, None if text == "NULL" else text, 1, "x"))
    return spark.createDataFrame(rows + rows[:2], KIND)


def lexicon(spark):
    return spark.createDataFrame([(i, w, n) for i, (w, n) in enumerate(LEX)], "lex_id bigint, word string, n_seen bigint")


def found(spark, words, lex=None):
    got = repair.repairs(words, lex if lex is not None else lexicon(spark)).collect()
    text = {r["word_id"]: r["text"] for r in words.collect()}
    assert len(got) == len({r["word_id"] for r in got})
    return sorted((text[r["word_id"]], r["noise"], r["repaired"]) for r in got)


def test_a_column_that_differs_in_case_only(spark):
    from pyspark.sql import functions as F

    words = book(spark, [[["der Turrn"]]]).select("*", F.lit("y")).toDF(*KIND.replace(",", "").split()[::2], "TEXT")
    assert [r["repaired"] for r in repair.repairs(words, lexicon(spark)).collect()] == ["turm"]


def test_divided_words(spark):
    pages = [[["der alte Müh⸗", "lenwerk, und Salz-", "oder Holzweg wie", "der Turm Torar-", "anfeld steht un", "ter dem Haus"]]]
    assert found(spark, book(spark, pages)) == [
        ("Müh⸗", "break", "Mühlenwerk,"), ("Torar-", "break", "Toraranfeld"), ("anfeld", "break", None), ("lenwerk,", "break", None), ("ter", "break", None), ("un", "break", "unter"),
    ]


def test_misread_words_but_no_names_numbers_or_look_alikes(spark):
    pages = [[["Dcr a*lte Turrn ftcht hier.", "1832 Torarnfeld idem NULL νόμος", "das Наus ſteht 17*04 Salz- und"]]]
    got = found(spark, book(spark, pages))
    assert got == [("Dcr", "misread", "der"), ("Turrn", "misread", "turm"), ("a*lte", "misread", "alte"), ("ftcht", "misread", "steht")]


def test_furniture_and_a_word_over_the_page_end(spark):
    pages = [
        [["Der Turm"], ["das alte Tor steht un-"]],
        [["Der Tnrm"], ["ter dem Haus sehr hier"], ["(12)"]],
        [["Der Turm"], ["die Zeit steht hier und"], ["1832"], ["(13)"]],
        [["(14)", "Der Turm"], ["das Haus steht"], ["99)"]],
    ]
    types = {(1, 0): "heading", (3, 2): "marginalia", (4, 2): "marginalia", (2, 0): "other"}
    got = found(spark, book(spark, pages, types=types))
    assert [x[:2] for x in got if x[1] == "furniture"] == [("(12)", "furniture"), ("(13)", "furniture"), ("(14)", "furniture"), *[("Der", "furniture")] * 3, ("Tnrm", "furniture"), ("Turm", "furniture"), ("Turm", "furniture")]
    assert [x for x in got if x[1] != "furniture"] == [("ter", "break", None), ("un-", "break", "unter")]


def test_a_page_end_before_more_than_four_open_ends(spark):
    pages = [[["das alte Tor steht un-"], *[[f"der xyz{c}q"] for c in "abcdef"]], [*[[f"ab{c}q der"] for c in "abcdef"], ["ter dem Haus"]]]
    assert [x for x in found(spark, book(spark, pages)) if x[1] == "break"] == [("ter", "break", None), ("un-", "break", "unter")]


def test_a_page_keeps_its_furniture_where_another_book_goes_on(spark):
    from pyspark.sql import functions as F

    words = book(spark, [[["der Turm steht"], ["(12)"]], [["das Haus"]]], types={(1, 1): "page-number"})
    other = words.withColumn("book_id", F.when(F.col("page_id") == "b_00000002", F.lit("c")).otherwise(F.col("book_id")))
    none = words.withColumn("book_id", F.when(F.col("page_id") == "b_00000002", F.col("book_id")))
    for table in (other, none):
        assert [x for x in found(spark, table) if x[1] == "furniture"] == [("(12)", "furniture", None)]


def test_paragraphs_are_whole(spark):
    pages = [[["Dcr alte Müh⸗", "lenwerk, steht hier."]]]
    words = book(spark, pages)
    got = repair.repaired_paragraphs(words, lexicon(spark)).collect()
    assert [r["text"] for r in got] == ["Der alte Mühlenwerk, steht hier."]


def test_odd_tables(spark):
    words = book(spark, [[["der Turm"]]])
    assert found(spark, book(spark, [[["der Turm"]]]).where("1 = 0")) == []
    bare = words.selectExpr("word_id", "cast(null as string) page_id", "cast(null as string) book_id", "cast(null as int) region_ord", "cast(null as string) region_type", "cast(null as int) line_ord", "cast(null as int) word_ord", "case when word_id = 1 then 'Dcr' when word_id = 2 then null else text end as text")
    assert [tuple(r) for r in repair.repairs(bare, lexicon(spark)).collect()] == [(1, "misread", "der")]
    no_words = repair.repairs(words, lexicon(spark).where("1 = 0")).collect()
    assert no_words == []


def test_a_huge_page_in_parts(spark):
    lines = ["der alte Müh-", "lenwerk steht"] * 40
    words = book(spark, [[lines]])
    listed = spark.sparkContext.broadcast([(w, n) for w, n in LEX])
    steps = repair.read_pages(words, listed, max_held=10)
    assert steps.where(f"kind = {repair.REPAIR}").count() == 80


def test_channel_probabilities_come_from_distinct_forms():
    words = channel.WordList(LEX)
    assert {c[1] for c in words.one_edit("turrn") if words.words[c[0]] == "turm"} == {"m>rn"}
    decoder = repair.Decoder(words, {"m>rn": -2.0, "e>c": -1.0, "s>f": -1.5})
    best = decoder.readings("ftcht")
    assert words.words[best[0][0]] == "steht" and best[0][1] == pytest.approx(-2.5)
    assert decoder.readings("turm") == () and decoder.readings("12") == () and decoder.readings("xyzxyz") == ()


def test_all_readings_reach_the_lattice():
    listed = ["haus", "maus", "laus", "raus", "faus", "naun"]
    words = channel.WordList([(w, 10) for w in listed])
    decoder = repair.Decoder(words, {f"{a}>x": -1.0 - i / 10 for i, a in enumerate("hmlrfn")} | {"n>s": -1.0})
    got = dict(decoder.readings("xaus"))
    assert {words.words[i] for i in got} == set(listed) and got[words.ids["naun"]] == pytest.approx(-2.5)


def test_a_long_word_may_have_more_confusions():
    words = channel.WordList([("feststellenes", 10), ("haus", 10)])
    decoder = repair.Decoder(words, {"s>f": -1.0, "e>c": -1.0})
    assert [words.words[i] for i, _ in decoder.readings("fcftftcllenes")] == ["feststellenes"]


def test_viterbi_weighs_neighbours():
    words = channel.WordList([("haus", 10), ("maus", 10), ("das", 100), ("die", 100)])
    ids, size = words.ids, 5
    items = [[1, "xaus", [[ids["haus"], -3.0], [ids["maus"], -3.0]]]]
    counts = {ids["das"] * size + ids["haus"]: 50, ids["das"] * size + 4: 60, ids["die"] * size + ids["maus"]: 50, ids["die"] * size + 4: 60}
    assert repair.viterbi(ids["das"], -1, items, counts, words) == [ids["haus"]]
    assert repair.viterbi(ids["die"], -1, items, counts, words) == [ids["maus"]]
    assert repair.viterbi(-1, -1, [[1, "ab", []]], {}, words) == [-1]


@pytest.mark.parametrize(("text", "value"), [("— 12 —", 12), ("(7)", 7), ("S. 9", 9), ("-3-", 3), ("xiv", 14), ("I9", 19), ("12.", 12), ("Haus", None), ("civil", None), ("", None), ("1579 der", None)])
def test_page_numbers(text, value):
    got = furniture.number_of(text)
    assert (got[0] if got else None) == value


def test_headers_alike():
    assert furniture.alike("meerundregister", "mecrundregister") and not furniture.alike("meer", "moor") and not furniture.alike("a", "b" * 30)


def test_word_list_bound(spark):
    from leafwright.storage import TooLarge

    with pytest.raises(TooLarge):
        repair.repairs(book(spark, [[["der"]]]), lexicon(spark), limit=3)


def _headed(pages, header):
    return [[[header(p)], ["der alte Turm steht hier", "und das Haus"]] for p in range(1, pages + 1)]


def test_many_chapter_headers_in_a_long_book(spark):
    """30 chapters: each has its own header, on 6 pages of 180 or 66 of 1,980 alike."""
    names = [f"{a}{b}tal" for a in ("Morgen", "Abend", "Winter", "Sommer", "Herbst") for b in ("berg", "fluß", "wald", "stein", "burg", "markt")]
    for length in (6, 66):
        words = book(spark, _headed(30 * length, lambda p, n=length: names[(p - 1) // n]))
        got = repair.repairs(words, lexicon(spark)).where("noise = 'furniture'").count()
        assert got == 30 * length - 1  # the first page carries the title


def test_headers_far_apart_are_headings(spark):
    pages = _headed(60, lambda p: "Zweiter Teil" if p in (10, 40) else f"der Turm {chr(97 + p // 8) * 4}{chr(110 + p % 8) * 5}")
    got = repair.repairs(book(spark, pages), lexicon(spark)).where("noise = 'furniture'").collect()
    assert got == []


def test_two_numberings_of_one_book(spark):
    roman = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii")
    pages = [[["der alte Turm", "steht hier"], [roman[p]]] for p in range(8)] + [[["das alte Haus", "steht hier"], [str(p)]] for p in range(1, 13)]
    got = repair.repairs(book(spark, pages), lexicon(spark)).where("noise = 'furniture'").count()
    assert got == 20


def test_a_page_in_parts_is_read_as_one(spark):
    """Parts of every size give what the whole page gives: divided words, foot number and page-end break."""
    pages = [[["der alte Müh-", "lenwerk steht hier", "Dcr Turm und Müh⸗", "lenwerk", "das Haus un-"], ["(12)"]], [["Der Turm"], ["ter dem Haus sehr Müh-"], ["lenwerk steht"], ["(13)"]]]
    words = book(spark, pages).repartition(3).cache()
    whole = sorted(map(tuple, repair.placed_repairs(words, lexicon(spark)).collect()))
    assert sum(r[3] == "break" for r in whole) == 8 and sum(r[3] == "furniture" for r in whole) == 2
    for held in (1, 2, 3, 5, 8):
        for partitions in ("1", "3"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(held))
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            try:
                assert sorted(map(tuple, repair.placed_repairs(words, lexicon(spark), max_held=held + 3).collect())) == whole
            finally:
                spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
                spark.conf.unset("spark.sql.adaptive.enabled")
                spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_marks_and_capitals_stay(spark):
    words = book(spark, [[["(Holzwcg) der Turrn, die ZEIT; dcr Müh-", "lcnwerk."]]])
    lex = lexicon(spark)
    got = repair.repaired_paragraphs(words, lex).collect()
    assert [r["text"] for r in got] == ["(Holzweg) der Turm, die ZEIT; der Mühlenwerk."]


def test_words_without_an_id_stay_in_the_text(spark):
    from pyspark.sql import functions as F

    words = book(spark, [[["das alte Haus"]]]).withColumn("word_id", F.lit(None).cast("bigint"))
    assert [r["text"] for r in repair.repaired_paragraphs(words, lexicon(spark)).collect()] == ["das alte Haus"]
