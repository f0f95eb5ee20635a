"""Every query of the core that SQL can express, against that SQL in DuckDB on the smallest tables."""

import importlib
from pathlib import Path

import pytest

import verify

SF = "/root/testdata/sf0.001"
PLANS = [importlib.import_module(f"leafwright.plans.{n}") for n in ("records", "texts", "perplexity", "paragraphs", "scores", "layouts", "files")]
SQL = {k: q for m in PLANS for k, q in m.oracle_sql().items()}
QUERIES = {k: f for m in PLANS for k, f in m.queries().items()}


@pytest.fixture(scope="module")
def con():
    return verify.views(SF)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    got, want, columns = verify.both(spark, con, QUERIES[name], SQL[name], SF)
    assert sorted(columns) == sorted(want[0]) and got == want[1]


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"rf_page_scores"}))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_near_words_are_not_met_by_their_first_letters():
    """The SQL compares all pairs, so words that differ in their first letters count on both sides."""
    assert "substr(c, 1, 4)" not in SQL["levenshtein_join"] and "ON true" in SQL["levenshtein_join"]
