"""Statistics over page scores: summaries, paired comparisons, ranks and moving averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwright.functions.numeric import correlation_p
from leafwright.operators.percentiles import percentiles
from leafwright.storage import written


def page_error_scores(words: DataFrame, pages: DataFrame, is_error: Column, overwrite: str | None = None) -> DataFrame:
    """``page_id, errors, total, score``: the overwriting value unless it is -1 or null, else errors by words, 0 without words."""
    counts = words.groupBy("page_id").agg(F.sum(is_error.cast("bigint")).alias("errors"), F.count("*").alias("total"))
    joined = pages.join(counts, "page_id", "left")
    own = F.when(F.coalesce("total", F.lit(0)) > 0, F.col("errors") / F.col("total")).otherwise(0.0)
    score = own if overwrite is None else F.coalesce(F.when(F.col(overwrite) != -1.0, F.col(overwrite)), own)
    return joined.select("page_id", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("total", F.lit(0)).alias("total"), score.alias("score"))


def book_summary(scores: DataFrame) -> DataFrame:
    """Per book over its valid scores; the page id that comes first wins ties for best and worst."""
    scores = written(scores.select("book_id", "page_id", "score"), "scores")  # the median reads it apart
    valid = F.col("score").isNotNull()
    page = F.when(valid, F.struct("score", "page_id"))
    negative = F.when(valid, F.struct((-F.col("score")).alias("score"), F.col("page_id")))
    rows = scores.groupBy("book_id").agg(F.count("score").alias("num_pages"), F.avg("score").alias("mean_score"), F.min(page).alias("b"), F.min(negative).alias("w"))
    rows = with_median(rows, scores, "score", ["book_id"], "median_score")
    return rows.select("book_id", "num_pages", "mean_score", "median_score", F.col("b.score").alias("best_score"), F.col("b.page_id").alias("best_page_id"), (-F.col("w.score")).alias("worst_score"), F.col("w.page_id").alias("worst_page_id"))


def with_median(rows: DataFrame, values: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """``rows``, one per group (or one), with the exact median of the group's values."""
    medians = percentiles(values, value, {name: 0.5}, by)
    if not by:
        return rows.crossJoin(F.broadcast(medians))
    side = medians.select(*[F.col(k).alias(f"_m_{k}") for k in by], name)
    return rows.join(side, [rows[k].eqNullSafe(F.col(f"_m_{k}")) for k in by], "left").drop(*[f"_m_{k}" for k in by])


def described(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """count, mean, median, sample deviation (0 for one value), least and greatest."""
    kept = written(df.where(F.col(value).isNotNull()).select(*(by or []), value), "described")
    rows = kept.groupBy(*(by or [])).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev"), F.min(value).alias("min"), F.max(value).alias("max"))
    return with_median(rows, kept, value, by or [], "median").select(*(by or []), "n", "mean", "median", "stdev", "min", "max")


def last_by_key(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One value per key: that of the greatest order."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def paired(a: DataFrame, b: DataFrame, key: str = "page_id", value: str = "score") -> DataFrame:
    """``key, a, b`` of the keys that both sides have a value for."""
    left = a.where(F.col(value).isNotNull()).select(key, F.col(value).alias("a"))
    return left.join(b.where(F.col(value).isNotNull()).select(key, F.col(value).alias("b")), key)


def average_rank(df: DataFrame, value: str, alias: str) -> DataFrame:
    """Ranks with ties averaged.

    Ranks come from counts per distinct value, cumulated over blocks of the value range, so no window
    holds all rows: distinct values are ranged into ordered partitions and offset by earlier ones.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    bounded = Window.partitionBy("_p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranged = written(counts.repartitionByRange(value).withColumn("_p", F.spark_partition_id()), "ranged")  # both branches need the same partitions
    inside = ranged.withColumn("_upto", F.sum("_n").over(bounded))
    totals = ranged.groupBy("_p").agg(F.sum("_n").alias("_t"))
    before = totals.withColumn("_before", F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_t")).select("_p", "_before")
    ranks = inside.join(F.broadcast(before), "_p").select(value, (F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / 2).alias(alias))
    return df.join(ranks, value)


def paired_statistics(a: DataFrame, b: DataFrame, key: str = "page_id", value: str = "score") -> DataFrame:
    """RMSE, Pearson and Spearman over common keys, means over pairs and over whole sides."""
    pairs = written(paired(a, b, key, value), "pairs")  # read by both rankings
    ranked = average_rank(average_rank(pairs, "a", "ra"), "b", "rb")
    both = ranked.agg(F.count("*").alias("n"), F.sqrt(F.avg((F.col("a") - F.col("b")) ** 2)).alias("rmse"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mae"), F.corr("a", "b").alias("pearson"), F.corr("ra", "rb").alias("spearman"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"))
    whole = a.agg(F.avg(value).alias("whole_mean_a")).crossJoin(b.agg(F.avg(value).alias("whole_mean_b")))
    return both.crossJoin(whole)


def with_p_values(stats: DataFrame) -> DataFrame:
    """Adds the p-values of both correlations to a one-row result."""
    p = F.udf(lambda r, n: correlation_p(r, n), "double")
    return stats.withColumn("pearson_p", p("pearson", "n")).withColumn("spearman_p", p("spearman", "n"))


def moving_average(df: DataFrame, keys: list[str], order: str, value: str, width: int = 15) -> DataFrame:
    """Means of full windows only; a group with fewer rows has none."""
    by = Window.partitionBy(*keys).orderBy(order)
    frame = by.rowsBetween(-(width - 1), 0)
    rows = df.select(*keys, order, F.row_number().over(by).alias("_i"), F.avg(value).over(frame).alias("moving_average"))
    return rows.where(F.col("_i") >= width).drop("_i")


def f1(tp: Column, fp: Column, actual: Column) -> Column:
    """Precision, recall and F1; misses are what is left of the actual errors, at least none."""
    fn = F.greatest(F.lit(0), actual - tp)
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return F.struct(precision.alias("precision"), recall.alias("recall"), F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"))
