"""Dewey labels: nothing lost, parents right, odd cases defined."""

from leafwright.operators import nested

KIND = "key string, extra int, loaded_at int, kids array<struct<id:string,ord:int,at:struct<points:string>,kids:array<struct<id:string,parent:string>>>>"


def tree(spark):
    rows = [
        ("a", 1, 1, [("r0", 5, ("1,1",), [("x", "p"), None, ("y", None)]), None, ("r2", None, None, [])]),
        ("b", None, 1, None),
        ("c", 2, 1, []),
        (None, 3, 1, [("n", None, None, None)]),
        ("d", 4, 1, [None, None]),
    ]
    return spark.createDataFrame(rows, KIND)


def test_tables_hold_every_element(spark):
    t = nested.shred(tree(spark), "key", "kids")
    assert set(t) == {"", "kids", "kids.at", "kids.kids"}
    assert t[""].count() == 5
    kids = {(r["key"], r["field_ord"], r["id"], r["is_null"], tuple(r["dewey"]), tuple(r["parent"])) for r in t["kids"].collect()}
    assert ("a", 5, "r0", False, (0,), ()) in kids and ("a", None, None, True, (1,), ()) in kids and len(kids) == 6
    grand = {(tuple(r["dewey"]), r["id"], r["field_parent"], r["is_null"]) for r in t["kids.kids"].collect()}
    assert grand == {((0, 0), "x", "p", False), ((0, 1), None, None, True), ((0, 2), "y", None, False)}
    assert [(r["key"], list(r["parent"]), r["points"]) for r in t["kids.at"].collect()] == [("a", [0], "1,1")]


def test_every_parent_exists(spark):
    t = nested.shred(tree(spark), "key", "kids")
    above = {(r["key"], tuple(r["dewey"])) for r in t["kids"].collect()}
    assert all((r["key"], tuple(r["parent"])) in above for r in t["kids.kids"].collect())


def test_nodes_count_children_that_are_not_null(spark):
    nodes = {(r["key"], r["path"], tuple(r["dewey"])): (r["is_null"], r["n_children"]) for r in nested.node_table(tree(spark), "key", "kids").collect()}
    assert nodes["a", "", ()] == (False, 2) and nodes["d", "", ()] == (False, 0) and nodes["b", "", ()] == (False, 0)
    assert nodes["a", "kids", (0,)] == (False, 2) and nodes["a", "kids", (1,)][0] and nodes["a", "kids", (2,)] == (False, 0)
    assert nodes["a", "kids.kids", (0, 2)] == (False, None) and nodes[None, "kids", (0,)] == (False, 0)


def test_last_delivery_wins_and_repeats_go(spark):
    rows = [("a", 1, 1, None), ("a", 2, 9, []), ("a", 2, 9, []), (None, 1, 1, None), (None, 1, 2, None)]
    got = nested.latest_records(spark.createDataFrame(rows, KIND), "key")
    assert sorted((str(r["key"]), r["extra"]) for r in got.collect()) == [("None", 1), ("a", 2)]


def test_empty_table(spark):
    none = spark.createDataFrame([], KIND)
    assert all(t.count() == 0 for t in nested.shred(none, "key", "kids").values())
    assert nested.node_table(none, "key", "kids").count() == 0
