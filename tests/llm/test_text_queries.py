"""Every text query that SQL can express, against that SQL in DuckDB on the smallest tables."""

from pathlib import Path

import pytest

import verify
from leafwright.llm import plans

SF = "/root/testdata/sf0.001"
SQL, QUERIES = plans.oracle_sql(), plans.queries()


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in SQL:
        got, want, columns = verify.both(spark, verify.views(SF), QUERIES[name], SQL[name], SF)
        assert sorted(columns) == sorted(want[0]) and got == want[1]
    else:
        CHECKS[name](spark, QUERIES[name](spark, SF).collect())


def _repaired(spark, rows):
    """Kinds of noise, each word once; furniture and second halves are dropped, misread words replaced."""
    assert len(rows) > 100 and len({r["word_id"] for r in rows}) == len(rows) and {r["noise"] for r in rows} == {"break", "misread", "furniture"}


def _paragraphs(spark, rows):
    """No line of the repaired text ends in a divided word any more, and most words are listed or names."""
    listed = {r["word"].lower() for r in spark.read.parquet(f"{SF}/lexicon.parquet").collect()}
    words = [w.strip(".,;:!?()").lower() for r in rows for w in r["text"].split()]
    assert len({(r["page_id"], r["region_ord"]) for r in rows}) == len(rows) and sum(w.endswith("⸗") for w in words) < 0.001 * len(words)
    assert sum(w in listed for w in words) > 0.75 * len(words)


def _percentiles(spark, rows):
    assert rows and all(r["p5"] <= r["p25"] <= r["p50"] <= r["p75"] <= r["p95"] and r["n"] > 0 for r in rows)


def _pieces(spark, rows):
    assert rows and max(len(r["text"]) for r in rows) <= 1000 and all(len(r["text"]) == r["n_chars"] for r in rows)


def _divided(spark, rows):
    from leafwright.llm import tokens

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["doc_id"] for r in rows} == {d for d, t in texts.items() if t and tokens.count_tokens(t) > 4096}


def _filled(spark, rows):
    (r,) = rows
    assert r["fullest"] <= 4096 and r["containers"] >= -(-r["tokens"] // 4096) and r["used_share"] > 0.9


def _short(spark, rows):
    assert {r["source"] for r in rows} <= {r["source"] for r in spark.read.parquet(f"{SF}/mix_targets.parquet").collect()}


def _shares(spark, rows):
    assert len(rows) >= 10 and sum(r["reached_share"] for r in rows) == pytest.approx(1.0) and all(r["tokens"] <= r["wanted"] + 1 for r in rows)


CHECKS = {"p1_found": _repaired, "p1_paragraphs": _paragraphs, "p2_percentiles": _percentiles, "p4_pieces": _pieces, "p7_found": _divided, "p7_fill": _filled, "p8_found": _short, "p8_shares": _shares, "p8_tempered": _shares}
