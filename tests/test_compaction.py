"""Records out of tiny files, and a store that neither loses nor doubles them."""

import itertools
import json
import shutil

import pytest

from leafwright.operators import compaction as cp

BODIES = {
    1: '{"Filename":"a","ColoredTextHTML":"x"}',
    2: '[{"Filename":"a","ColoredTextHTML":"x"},{"ColoredTextHTML":"y","Filename":"b","more":1.5}]',
    3: '{"Filename": "b", "ColoredTextHTML": "\\u0079"}',
    4: "",
    5: None,
    6: '{"Filename":"a","ColoredTextHTML":"x"',
    7: "[]",
    8: '[{"Filename":1,"ColoredTextHTML":"x"},{"Filename":"ab","ColoredTextHTML":""},3,null]',
    9: '{"Filename":"a","ColoredTextHTML":"bx"}',
    10: '{"Filename":"ab","ColoredTextHTML":"x", "n": NaN}',
    11: '{"Filename":"ab","ColoredTextHTML":""} trailing',
}


def files(spark, ids=BODIES):
    rows = [(i, f"p{i}", len(BODIES[i] or ""), BODIES[i]) for i in ids]
    return spark.createDataFrame(rows + rows[:1], "file_id bigint, xml_path string, size_bytes bigint, body string")


def test_only_valid_json_holds_records():
    held = {i: [(n, h) for _, n, h in cp.parse_records(b)] for i, b in BODIES.items()}
    assert held[2] == [("a", "x"), ("b", "y")] and held[3] == [("b", "y")] and held[8] == [("ab", "")]
    assert not any(held[i] for i in (4, 5, 6, 7, 10, 11))


def test_digest_keeps_the_strings_apart():
    assert cp.record_digest("ab", "c") != cp.record_digest("a", "bc")
    assert cp.record_digest("\ud800", "x") != cp.record_digest("?", "x")


def test_sharing_files_equal_brute_force(spark):
    held = {i: {(n, h) for _, n, h in cp.parse_records(b)} for i, b in BODIES.items()}
    want = {(a, b) for a, b in itertools.combinations(sorted(held), 2) if held[a] & held[b]}
    got = cp.files_sharing_records(cp.file_records(files(spark))).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.fixture
def store(tmp_path):
    yield f"file://{tmp_path}/store"
    shutil.rmtree(tmp_path, ignore_errors=True)


def records(spark, folder):
    return sorted((r["filename"], r["html"]) for r in cp.stored_records(spark, folder).collect())


def test_compaction_is_idempotent_and_incremental(spark, store):
    first = cp.compact(files(spark, [1, 2, 4]), store).collect()
    assert len(first) == 1 and records(spark, store) == [("a", "x"), ("b", "y")]
    assert cp.compact(files(spark, [1, 2, 4]), store).count() == 1
    cp.compact(files(spark, [1, 2, 3, 8]), store)
    assert records(spark, store) == [("a", "x"), ("ab", ""), ("b", "y")]


def test_levels_merge(spark, store):
    one = "file_id bigint, body string"
    for i in range(4):
        cp.compact(spark.createDataFrame([(i, json.dumps({"Filename": str(i), "ColoredTextHTML": "t"}))], one), store, fanout=2)
    runs = cp.live_runs(spark, store)
    assert len(runs) == 1 and runs[0]["level"] == 2 and len(records(spark, store)) == 4


def test_an_output_without_journal_entry_is_written_again(spark, store, tmp_path):
    cp.compact(files(spark, [1, 2]), store)
    shutil.rmtree(f"{tmp_path}/store/journal")
    assert cp.live_runs(spark, store) == []
    cp.compact(files(spark, [1, 2]), store)
    assert records(spark, store) == [("a", "x"), ("b", "y")]


def test_files_without_an_id_are_kept_apart(spark, store):
    rows = [(None, BODIES[1]), (None, BODIES[3]), (None, BODIES[1]), (7, BODIES[9])]
    df = spark.createDataFrame(rows, "file_id bigint, body string")
    assert cp.file_records(df).count() == 3
    cp.compact(df, store)
    assert records(spark, store) == [("a", "bx"), ("a", "x"), ("b", "y")]
    assert cp.compact(df.withColumn("x", df.body), store).count() >= 1 and len(records(spark, store)) == 3


def test_no_files(spark, store):
    assert cp.compact(files(spark, []), store).count() == 0 and records(spark, store) == []
    assert cp.tier_plan(files(spark, [])).count() == 0


def test_only_runs_of_similar_size_are_merged(spark, store):
    """A large run and three tiny ones: the tiny ones merge, the large one is not written again."""
    one = "file_id bigint, body string"
    cp.compact(spark.createDataFrame([(99, json.dumps({"Filename": "large", "ColoredTextHTML": "t" * 5000}))], one), store, fanout=3)
    large = cp.live_runs(spark, store)[0]["output"]
    for i in range(3):
        cp.compact(spark.createDataFrame([(i, json.dumps({"Filename": str(i), "ColoredTextHTML": "t"}))], one), store, fanout=3)
    runs = {r["output"]: r for r in cp.live_runs(spark, store)}
    assert len(runs) == 2 and runs[large]["level"] == 0 and {r["level"] for r in runs.values()} == {0, 1}
    assert cp.next_merge([{"bytes": 500}] * 9, 3, target_bytes=400) == [] and len(cp.next_merge([{"bytes": 500}] * 9, 3, 4000)) == 9
    assert [cp.byte_tier(b, 4) for b in (0, 1, 3, 4, 15, 16)] == [0, 0, 0, 1, 1, 2]


def test_the_store_knows_where_its_records_came_from(spark, store):
    """Files with a record in common, from the journal of two loads; an unfinished load counts for nothing."""
    held = {i: {(n, h) for _, n, h in cp.parse_records(b)} for i, b in BODIES.items()}
    want = {(a, b) for a, b in itertools.combinations(sorted(held), 2) if held[a] & held[b]}
    assert cp.origins(spark, store).count() == 0
    cp.compact(files(spark, [1, 2, 4, 8]), store)
    spark.createDataFrame([(b"x", 1), (b"x", 2)], "digest binary, file_id bigint").write.parquet(f"{store}/origins/unfinished")
    cp.compact(files(spark, list(BODIES)), store)
    got = cp.files_sharing_records(cp.origins(spark, store)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
