"""Overlapping word windows, perplexities, islands of errors and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwright.operators.percentiles import percentiles
from leafwright.storage import written

ERROR_PERPLEXITY = 158.0
SCORE_PERPLEXITY = 100.0


def chunk_starts(n: Column, size: int, overlap: int) -> Column:
    """First places of windows: the last window is the first that reaches the end; none for no words."""
    step = max(1, size - overlap)
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / F.lit(step)) * step)
    return F.when(n > 0, F.sequence(F.lit(0).cast("int"), last.cast("int"), F.lit(step).cast("int"))).otherwise(F.array().cast("array<int>"))


def word_chunks(texts: DataFrame, keys: list[str], words: str, size: int = 20, overlap: int = 10) -> DataFrame:
    """``keys..., chunk_id, start_word_id, end_word_id, words``: the end counts as inside."""
    starts = texts.select(*keys, F.col(words).alias("_w"), F.posexplode(chunk_starts(F.size(words), size, overlap)).alias("chunk_id", "start_word_id"))
    end = F.least(F.col("start_word_id") + size, F.size("_w"))
    return starts.select(*keys, "chunk_id", "start_word_id", (end - 1).alias("end_word_id"), F.slice("_w", F.col("start_word_id") + 1, size).alias("words"))


def smoothed(pages: DataFrame, keys: list[str], logp: str, size: int = 20, overlap: int = 10) -> DataFrame:
    """``keys..., word_id, ppl``: mean perplexity over the windows that hold a word; no number counts as 0.

    ``logp`` are the log probabilities of a page's words, in order. A window's perplexity is exp of its mean negative
    log probability. All is reckoned inside the page's array: a word is in the windows from the first that
    reaches it to the last that starts before it, so no window and no word is shuffled.
    """
    step = max(1, size - overlap)
    n = F.size(logp)
    starts = chunk_starts(n, size, overlap)
    windows = pages.select(*keys, n.alias("_n"), F.transform(starts, lambda s: window_perplexity(F.slice(logp, s + 1, size))).alias("_p"))
    first = lambda i: F.greatest(F.ceil((i - (size - 1)) / F.lit(step)), F.lit(0)).cast("int")
    last = lambda i: F.least(F.floor(i / F.lit(step)), F.size("_p") - 1).cast("int")

    def mean(i):
        held = F.slice("_p", first(i) + 1, last(i) - first(i) + 1)
        m = F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / F.size(held)
        return F.when(m.isNull() | F.isnan(m) | (F.abs(m) == float("inf")), 0.0).otherwise(m)

    places = F.when(F.col("_n") > 0, F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(F.array().cast("array<int>"))
    return windows.select(*keys, F.posexplode(F.transform(places, mean)).alias("word_id", "ppl"))


def window_perplexity(logp: Column) -> Column:
    """exp of the mean negative log probability of an array."""
    return F.exp(-F.aggregate(logp, F.lit(0.0), lambda a, x: a + x) / F.size(logp))


def islands(words: DataFrame, keys: list[str], pos: str, is_error: Column, carry: dict[str, str]) -> DataFrame:
    """Longest runs of consecutive error words: ``keys..., start_idx, end_idx`` and the carried columns in order."""
    by = Window.partitionBy(*keys).orderBy(pos)
    flagged = words.select(*keys, F.col(pos).alias("_pos"), is_error.alias("_err"), *[F.col(c).alias(a) for c, a in carry.items()], F.row_number().over(by).alias("_all"))
    runs = flagged.where("_err").withColumn("_run", F.col("_all") - F.row_number().over(Window.partitionBy(*keys).orderBy("_pos")))
    items = F.array_sort(F.collect_list(F.struct("_pos", *carry.values())))
    grouped = runs.groupBy(*keys, "_run").agg(F.min("_pos").alias("start_idx"), F.max("_pos").alias("end_idx"), items.alias("_i"))
    return grouped.select(*keys, "start_idx", "end_idx", *[_field("_i", a).alias(a) for a in carry.values()])


def _field(items: str, name: str) -> Column:
    return F.transform(items, lambda x: x[name])


def quartile_bound(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """``q1, q3, bound``: linearly interpolated quartiles and the bound 1.5 quartile ranges above."""
    q = percentiles(df, value, {"q1": 0.25, "q3": 0.75}, by)
    return q.withColumn("bound", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))


def anomaly_threshold(words: DataFrame, page: str, value: str, keep_below: float = 1.5) -> DataFrame:
    """The bound, recomputed over pages whose median anomaly is below ``keep_below``."""
    words = written(words.where(F.col(value).isNotNull()).select(page, value), "values")  # read by both bounds and the medians
    q = quartile_bound(words, value)
    scored = words.crossJoin(F.broadcast(q)).withColumn("anomaly", F.greatest((F.col(value) - F.col("q3")) / (F.col("q3") - F.col("q1")), F.lit(0.0)))
    kept = scored.groupBy(page).agg(F.median("anomaly").alias("m")).where(F.col("m") < keep_below).select(page)
    return quartile_bound(written(words.join(kept, page, "left_semi").select(value), "kept"), value)
