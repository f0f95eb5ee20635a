"""Page features and the regression of page error rates on them."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.functions.text import is_numeric, is_punctuation

FEATURES = (
    "n_regions", "n_lines", "n_words", "mean_word_len", "mean_lines_per_region", "var_lines_per_region", "mean_words_per_region", "var_words_per_region", "max_chars_per_line",
    "mean_chars_per_line", "var_chars_per_line", "numeric_ratio", "punct_ratio", "max_word_len", "n_empty_regions", "empty_region_share", "n_empty_lines", "empty_line_share",
)


def page_features(words: DataFrame) -> DataFrame:
    """The 18 features of a page; lines of only null or empty words are empty, regions of only such lines too."""
    word = words.select("page_id", "region_ord", "line_ord", F.when(F.coalesce("text", F.lit("")) != "", F.col("text")).alias("t"))
    line = word.groupBy("page_id", "region_ord", "line_ord").agg(
        F.count("t").alias("w"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("c"), F.sum(F.coalesce(is_numeric(F.col("t")).cast("int"), F.lit(0))).alias("num"), F.sum(F.coalesce(is_punctuation(F.col("t")).cast("int"), F.lit(0))).alias("pun"), F.coalesce(F.max(F.length("t")), F.lit(0)).alias("longest")
    )
    line = line.withColumn("chars", F.col("c") + F.greatest(F.col("w") - 1, F.lit(0)))
    sq = lambda c: F.sum(F.col(c).cast("double") * F.col(c))
    region = line.groupBy("page_id", "region_ord").agg(
        F.count("*").alias("l"), F.sum("w").alias("w"), F.sum("c").alias("c"), F.sum("num").alias("num"), F.sum("pun").alias("pun"), F.max("longest").alias("longest"), F.max("chars").alias("mx"), F.sum("chars").alias("sc"), sq("chars").alias("sc2"), F.sum((F.col("w") == 0).cast("int")).alias("el")
    )
    page = region.groupBy("page_id").agg(
        F.count("*").alias("n_regions"), F.sum("l").alias("n_lines"), F.sum("w").alias("n_words"), F.sum("c").alias("c"), F.avg("l").alias("mean_lines_per_region"), F.var_pop("l").alias("var_lines_per_region"), F.avg("w").alias("mean_words_per_region"), F.var_pop("w").alias("var_words_per_region"),
        F.max("mx").alias("max_chars_per_line"), F.sum("sc").alias("sc"), F.sum("sc2").alias("sc2"), F.sum("num").alias("num"), F.sum("pun").alias("pun"), F.max("longest").alias("max_word_len"), F.sum((F.col("w") == 0).cast("int")).alias("n_empty_regions"), F.sum("el").alias("n_empty_lines"),
    )
    per_word = lambda c: F.when(F.col("n_words") > 0, F.col(c) / F.col("n_words")).otherwise(0.0)
    mean_chars = F.col("sc") / F.col("n_lines")
    page = page.withColumns({
        "mean_word_len": per_word("c"), "numeric_ratio": per_word("num"), "punct_ratio": per_word("pun"), "mean_chars_per_line": mean_chars, "var_chars_per_line": F.col("sc2") / F.col("n_lines") - mean_chars * mean_chars,
        "empty_region_share": F.col("n_empty_regions") / F.col("n_regions"), "empty_line_share": F.col("n_empty_lines") / F.col("n_lines"),
    })
    return page.select("page_id", *[F.col(f).cast("double").alias(f) for f in FEATURES])


#: The grid of the published search: 3 x 5 x 3 x 3 points (depth 30 stands for no limit, the deepest Spark grows).
FULL_GRID = {"numTrees": [50, 100, 200], "maxDepth": [30, 5, 10, 15, 20], "minInstancesPerNode": [1, 2, 4], "featureSubsetStrategy": ["all", "sqrt", "log2"]}
#: What a query can afford: the ends of each range.
GRID = {"numTrees": [20, 50], "maxDepth": [5, 10], "minInstancesPerNode": [1, 4]}


def hashed_embedding(texts: DataFrame, text: str, size: int = 64) -> DataFrame:
    """A stand-in for a text embedder: hashed word counts of length ``size``; any other plugs in as a vector column."""
    from pyspark.ml.feature import HashingTF

    words = texts.withColumn("_t", F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"))
    return HashingTF(inputCol="_t", outputCol="embedding", numFeatures=size).transform(words).drop("_t")


def train(features: DataFrame, label: str, grid: dict[str, list] | None = None, folds: int = 3, seed: int = 42, bound: int = 100_000):
    """(model, held-out metrics): a random forest, cross-validated over ``grid``, on at most ``bound`` labelled rows.

    The inputs are the 18 features and, where there is a column ``embedding``, that of the page's text. Rows are
    chosen and split by a hash of their page, so the split is the same whatever the partitions.
    """
    rows = features.where(F.col(label).isNotNull()).withColumn("_h", F.abs(F.xxhash64("page_id", F.lit(seed))))
    sample = rows.orderBy("_h").limit(bound)
    known, held_out = sample.where(F.col("_h") % 5 != 0), sample.where(F.col("_h") % 5 == 0)
    forest = RandomForestRegressor(featuresCol="features", labelCol=label, seed=seed)
    values = grid or GRID
    builder = ParamGridBuilder()
    for name, options in values.items():
        builder = builder.addGrid(getattr(forest, name), options)
    judge = RegressionEvaluator(labelCol=label, metricName="mse")
    stages = Pipeline(stages=[VectorAssembler(inputCols=[*FEATURES, *(["embedding"] if "embedding" in features.columns else [])], outputCol="features"), CrossValidator(estimator=forest, estimatorParamMaps=builder.build(), evaluator=judge, numFolds=folds, seed=seed, parallelism=4)])
    model = stages.fit(known)
    guessed = model.transform(held_out)
    return model, {m: RegressionEvaluator(labelCol=label, metricName=m).evaluate(guessed) for m in ("mse", "rmse", "mae")}


def save_model(model, path: str) -> None:
    """Keep a trained model in a folder of the shared storage; an older one there is replaced."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def score_pages(model, features: DataFrame) -> DataFrame:
    """``page_id, score`` for all pages."""
    return model.transform(features).select("page_id", F.col("prediction").alias("score"))
