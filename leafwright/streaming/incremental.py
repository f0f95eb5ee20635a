"""Pages scored as they arrive: a file stream, stateless per page, exactly once per file.

The stream's checkpoint remembers which files are done (the form of "skip what has an output"), and
each micro-batch is written under its own number, so a batch that is repeated replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.functions.numeric import sigmoid
from leafwright.storage import work_dir


def page_stream(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def page_scores(pages: DataFrame) -> DataFrame:
    """Share of a page's words whose perplexity the sigmoid takes for an error; needs no state."""
    ppl = F.filter("word_smoothed_ppl_page", lambda x: x.isNotNull() & ~F.isnan(x))
    bad = F.size(F.filter(ppl, lambda x: sigmoid(x) > 0.5))
    return pages.select("page_id", "book_id", F.when(F.size(ppl) > 0, bad / F.size(ppl)).otherwise(0.0).alias("score"))


def score_arrivals(spark: SparkSession, source: str, schema, target: str, checkpoint: str | None = None) -> DataFrame:
    """Scores all files that have arrived and returns everything scored so far."""

    def put(batch: DataFrame, number: int) -> None:
        page_scores(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = page_stream(spark, source, schema).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint or f"{work_dir(spark)}/stream").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(target).select("page_id", "book_id", "score")


def event_windows(events: DataFrame, minutes: int = 60, late: str = "10 minutes") -> DataFrame:
    """Tumbling windows of events by type; works on a stream (with a watermark for late rows) and on a table."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    counts = timed.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "n", "total")
