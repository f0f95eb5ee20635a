"""Percentiles per group over very many values, from mergeable sketches.

The sketch is the randomized compactor hierarchy (KLL) that Spark builds natively: levels of values
are sorted and every other value moves up, two sketches merge level by level, and a rank is answered
within ``rank_error(k)`` of the true one with 99 % confidence. Sketches are taken before the shuffle
in every task, so a group with a third of all values shuffles no more than any other, and sketches of
days or parts are ordinary binary values that merge later to what one pass would have given.

Null and NaN are no values; infinities are. A group without values has no sketch. Groups with at most
``k`` values are answered exactly. Repeated rows count as often as they come unless pages are made
unique first (``page_values``). An empty table gives no groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.storage import written

K = 1024


def rank_error(k: int) -> float:
    """Published 99 % bound of a single rank query on this family of sketches."""
    return 2.296 / k**0.9723


def valid(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


def sketches(values: DataFrame, by: list[str], value: str, k: int = K) -> DataFrame:
    """``by..., sketch, n``: one sketch per group of any grouping, e.g. book and day."""
    kept = values.where(valid(F.col(value)))
    return kept.groupBy(*by).agg(F.kll_sketch_agg_double(value, k).alias("sketch"), F.count("*").alias("n"))


def merged(parts: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """Sketches of coarser groups from finer ones."""
    return parts.groupBy(*by).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"), F.sum("n").alias("n"))


def quantile(q: float) -> Column:
    return F.kll_sketch_get_quantile_double("sketch", F.lit(q))


def page_values(pages: DataFrame, values: Column, kind: str) -> DataFrame:
    """``kind, book_id, page_id, day, vals``: each page once (its last delivery), its values as an array.

    Pages without id are all kept.
    """
    rows = pages.select("book_id", "page_id", "day", "loaded_at", values.alias("vals"))
    row = F.struct("book_id", "day", "vals")
    one = rows.where("page_id is not null").groupBy("page_id").agg(F.max_by(row, F.struct("loaded_at", F.xxhash64(row))).alias("r")).select("r.book_id", "page_id", "r.day", "r.vals")
    return one.unionByName(rows.where("page_id is null").select("book_id", "page_id", "day", "vals")).select(F.lit(kind).alias("kind"), "*")


def off_figures(figures: DataFrame, values: DataFrame, ranks: tuple[float, ...], slack: float = 0.02, k: int = K) -> DataFrame:
    """Figures (``book_id, kind, figure, q, x``; q one of ``ranks``) whose rank is off by more than ``slack``.

    x is off if q lies more than ``slack`` outside the interval from the share of values below x to
    the share not above x, that is, if x is above the value of rank q + slack or below that of rank
    q - slack. The sketch's values at those ranks, moved by three rank errors either way, decide all
    figures but those between the two; only books with such a figure are counted exactly.
    """
    exploded = values.select("kind", "book_id", F.explode("vals").alias("v"))
    sk = sketches(exploded, ["kind", "book_id"], "v", k)
    eps = 3 * rank_error(k)

    def at(shift: float) -> Column:
        chosen = F.lit(None).cast("double")
        for q in ranks:
            chosen = F.when(F.col("q") == q, quantile(min(1.0, max(0.0, q + shift)))).otherwise(chosen)
        return chosen

    x = F.col("x")
    asked = figures.where(valid(x)).distinct().join(sk, ["kind", "book_id"])
    surely = (x > at(slack + eps)) | (x < at(-slack - eps))
    fine = (x <= at(slack - eps)) & (x >= at(eps - slack))
    judged = written(asked.select("book_id", "kind", "figure", "q", "x", surely.alias("off"), (~surely & ~fine).alias("near")), "figures")
    clear = judged.where("off").select("book_id", "figure")
    near = judged.where("near").select("book_id", "kind", "figure", "q", "x")
    if not near.limit(1).count():
        return clear.distinct()
    return clear.unionByName(exactly_off(near, values, slack)).distinct()


def exactly_off(figures: DataFrame, values: DataFrame, slack: float) -> DataFrame:
    """The same rule by counting; per page inside the arrays, then summed per figure."""
    rows = figures.join(values, ["kind", "book_id"]).select("book_id", "figure", "q", "x", F.filter("vals", lambda v: valid(v)).alias("vals"))
    below = F.size(F.filter("vals", lambda v: v < F.col("x")))
    upto = F.size(F.filter("vals", lambda v: v <= F.col("x")))
    sums = rows.select("book_id", "figure", "q", "x", below.alias("b"), upto.alias("u"), F.size("vals").alias("n")).groupBy("book_id", "figure", "q", "x").agg(F.sum("b").alias("b"), F.sum("u").alias("u"), F.sum("n").alias("n"))
    off = (F.col("q") < F.col("b") / F.col("n") - slack) | (F.col("q") > F.col("u") / F.col("n") + slack)
    return sums.where((F.col("n") > 0) & off).select("book_id", "figure")
