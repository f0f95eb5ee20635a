"""Exact percentiles of very many values, with or without groups, without gathering them.

A sketch (KLL, combined before the shuffle) of each group gives for every percentile a band of values that should
hold it. One pass over the values counts those below each band and inside it. As long as a band holds more than
``BAND`` values, a sketch of the band alone makes it narrower, about fifty times a turn. In the last bands values are
counted, the two neighbouring ranks picked and interpolated. The sketch only steers: a band that misses its ranks
is noticed by the count and asked for again, wider, so the result is exact whatever the sketch says.

Null values do not count; a group without values has no row; without groups there is one row, of nulls for no values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwright.storage import hinted, written

#: Values that one task may hold, and size of the sketches.
BAND, SKETCH = 2_000_000, 1024
#: Rank error that the bands allow for, more than twice the published 99 % bound of a sketch of this size, and the steps
#: of rank at which a sketch is asked.
SLACK, STEPS = 0.006, 200
#: Rows of a table of bands up to which it is broadcast.
MAX_BANDS = 100_000
#: Turns of narrowing.
LIMIT = 12
#: What is known of a percentile of a group: its two ranks and the weight of the second, the values below its band and
#: inside it, the band from _lo to _hi (null: open), and the band to be counted next (null: none).
KNOWN = ("_name", "_r1", "_r2", "_part", "_below", "_in", "_lo", "_hi", "_to_lo", "_to_hi")


def percentiles(df: DataFrame, value: str, points: dict[str, float], by: list[str] | None = None, band: int = BAND) -> DataFrame:
    """``by..., <names of points>``: linearly interpolated percentiles, exact."""
    keys = by or []
    kept = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    groups = written(kept.groupBy(*keys).agg(F.count("*").alias("_n"), F.kll_sketch_agg_double("_v", SKETCH).alias("_s")).where("_n > 0"), "groups")
    most = groups.agg(F.max("_n").alias("m")).first()["m"]
    if most is None or most <= band:
        # Every group fits into one task: Spark's own aggregate, which combines before the shuffle.
        return kept.groupBy(*keys).agg(*[F.percentile("_v", F.lit(q)).alias(name) for name, q in points.items()])
    state = _first_bands(groups, keys, points)
    for turn in range(1, LIMIT + 1):
        state = written(_counted(kept, state, keys), "bands")
        wide = state.where((F.col("_in") > band) & F.coalesce(F.col("_lo") < F.col("_hi"), F.lit(True)))
        if not wide.limit(1).count():
            break
        state = _narrower(kept, wide, keys, SLACK * (turn // 4 + 1)).unionByName(_others(state, wide, keys))
    return _picked(kept, state, keys).groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col("_x"))).alias(name) for name in points])


def _first_bands(groups: DataFrame, keys: list[str], points: dict[str, float]) -> DataFrame:
    asked = groups.select(*keys, "_n", "_s", F.inline(F.array(*[F.struct(F.lit(n).alias("_name"), F.lit(float(q)).alias("_q")) for n, q in points.items()])))
    rank = F.col("_q") * (F.col("_n") - 1)
    none = F.lit(None).cast("double")
    ranked = asked.select(*keys, "_s", "_name", F.floor(rank).alias("_r1"), F.ceil(rank).alias("_r2"), (rank - F.floor(rank)).alias("_part"), F.lit(0).cast("bigint").alias("_below"), F.col("_n").alias("_in"), none.alias("_lo"), none.alias("_hi"))
    low, high = _ladder(SLACK)
    return ranked.select(*keys, *KNOWN[:-2], low.alias("_to_lo"), high.alias("_to_hi"))


def _ladder(slack: float) -> tuple[Column, Column]:
    """The values of a sketch ``_s`` between which the two ranks should lie."""
    values = F.kll_sketch_get_quantile_double("_s", F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)]))
    low = F.greatest(F.floor(((F.col("_r1") - F.col("_below")) / F.col("_in") - slack) * STEPS), F.lit(0)).cast("int")
    high = F.least(F.ceil(((F.col("_r2") - F.col("_below") + 1) / F.col("_in") + slack) * STEPS), F.lit(STEPS)).cast("int")
    return F.get(values, low), F.get(values, high)


def _with(df: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Values with the bands of their group that they lie in; the bands are broadcast while they are few."""
    side = hinted(state.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *KNOWN), MAX_BANDS)
    inside = (F.col("_lo").isNull() | (F.col("_v") >= F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_v") <= F.col("_hi")))
    on = [df[k].eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = df.join(side, on) if keys else df.crossJoin(F.broadcast(side))
    return joined.where(inside).drop(*[f"_k_{k}" for k in keys])


def _counted(df: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """The bands asked for, with their counts; where a band misses its ranks the state stays as it was."""
    asked = _with(df, state.where("_to_lo is not null"), keys)
    first = [F.first(c).alias(c) for c in KNOWN[1:]]
    less, mid = F.col("_v") < F.col("_to_lo"), (F.col("_v") >= F.col("_to_lo")) & (F.col("_v") <= F.col("_to_hi"))
    sums = asked.groupBy(*keys, "_name").agg(*first, F.sum(less.cast("bigint")).alias("_less"), F.sum(mid.cast("bigint")).alias("_mid"))
    below = F.col("_below") + F.col("_less")
    hit = (below <= F.col("_r1")) & (F.col("_r2") < below + F.col("_mid"))
    new = lambda a, b: F.when(hit, a).otherwise(F.col(b)).alias(b)
    none = F.lit(None).cast("double")
    counted = sums.select(*keys, "_name", "_r1", "_r2", "_part", new(below, "_below"), new(F.col("_mid"), "_in"), new(F.col("_to_lo"), "_lo"), new(F.col("_to_hi"), "_hi"), none.alias("_to_lo"), none.alias("_to_hi"))
    return counted.unionByName(state.where("_to_lo is null"))


def _narrower(df: DataFrame, wide: DataFrame, keys: list[str], slack: float) -> DataFrame:
    """The wide bands with a narrower one each to be counted, from a sketch of their own values."""
    sketched = _with(df, wide, keys).groupBy(*keys, "_name").agg(F.kll_sketch_agg_double("_v", SKETCH).alias("_s"), *[F.first(c).alias(c) for c in KNOWN[1:]])
    low, high = _ladder(slack)
    return sketched.withColumns({"_to_lo": low, "_to_hi": high}).select(*keys, *KNOWN)


def _others(state: DataFrame, wide: DataFrame, keys: list[str]) -> DataFrame:
    other = wide.select(*[F.col(k).alias(f"_k_{k}") for k in (*keys, "_name")])
    return state.join(other, [state[k].eqNullSafe(F.col(f"_k_{k}")) for k in (*keys, "_name")], "left_anti")


def _picked(df: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., _name, _x``: values inside the bands by how often they stand there (summed before the shuffle), then by rank."""
    rest = ("_r1", "_r2", "_part", "_below")
    held = _with(df, state, keys).groupBy(*keys, "_name", "_v").agg(F.count("*").alias("_c"), *[F.first(c).alias(c) for c in rest])
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_below")
    at = lambda r: F.min(F.when(F.col("_upto") > F.col(r), F.col("_v")))
    part = F.first("_part")
    return held.withColumn("_upto", upto).groupBy(*keys, "_name").agg(((F.lit(1.0) - part) * at("_r1") + part * at("_r2")).alias("_x"))
