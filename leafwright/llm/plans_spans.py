"""Queries of problem 9: long exact spans shared between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafwright.llm import spans
from leafwright.storage import table


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_pairs(table(spark, sf_dir, "documents"))


def p9_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_share(table(spark, sf_dir, "documents"))


def p9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that an earlier document already has, at their original offsets: what removal takes out."""
    return spans.shared_spans(table(spark, sf_dir, "documents"), earlier_only=True)


def p9_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without what an earlier one already has, in pieces at their original offsets."""
    return spans.remaining(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p9_found, p9_shared, p9_repeats, p9_remaining)}


WINDOWS = """g AS (SELECT doc_id, unnest(range(1, length(text) - 198)) AS i, text FROM documents WHERE length(text) >= 200),
  h AS (SELECT doc_id, i, hash(substr(text, i, 200)) AS d FROM g),
  c AS (SELECT d FROM h GROUP BY d HAVING count(DISTINCT doc_id) > 1),
  k AS (SELECT h.* FROM h SEMI JOIN c USING (d))"""


def _covered(condition: str) -> str:
    return f"""v AS (SELECT DISTINCT k.doc_id, k.i FROM k JOIN (SELECT d, min(doc_id) AS lo, max(doc_id) AS hi FROM k GROUP BY d) m USING (d) WHERE {condition}),
  n AS (SELECT doc_id, i, CASE WHEN i - 200 > lag(i) OVER w OR lag(i) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  s AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM n),
  spans AS (SELECT doc_id, min(i) - 1 AS "start", max(i) + 199 AS "end" FROM s GROUP BY doc_id, grp)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p9_found": f"WITH {WINDOWS} SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM (SELECT DISTINCT doc_id, d FROM k) a JOIN (SELECT DISTINCT doc_id, d FROM k) b ON a.d = b.d AND a.doc_id < b.doc_id",
        "p9_shared": f"""WITH {WINDOWS}, {_covered('k.doc_id <> m.lo OR k.doc_id <> m.hi')},
            t AS (SELECT doc_id, sum("end" - "start")::BIGINT AS c, count(*) AS n FROM spans GROUP BY doc_id)
            SELECT d.doc_id, coalesce(length(d.text), 0)::BIGINT AS text_chars, coalesce(t.c, 0) AS shared_chars, coalesce(t.n, 0) AS n_spans,
            CASE WHEN length(d.text) > 0 THEN coalesce(t.c, 0)::DOUBLE / length(d.text) ELSE 0.0::DOUBLE END AS shared_share FROM documents d LEFT JOIN t USING (doc_id)""",
        "p9_repeats": f'WITH {WINDOWS}, {_covered("m.lo < k.doc_id")} SELECT doc_id, "start", "end" FROM spans',
        "p9_remaining": f"""WITH {WINDOWS}, {_covered("m.lo < k.doc_id")},
            b AS (SELECT doc_id, "start" AS s, "end" AS e FROM spans UNION ALL SELECT doc_id, length(text), length(text) FROM documents WHERE text IS NOT NULL),
            gaps AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s, e), 0) AS "start", s AS "end" FROM b)
            SELECT doc_id, "start", "end", substr(text, "start" + 1, "end" - "start") AS text FROM gaps JOIN documents USING (doc_id) WHERE "start" < "end\"""",
    }
