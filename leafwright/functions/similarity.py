"""Similarity of texts: Ratcliff-Obershelp ratios in Arrow batches, edit distance in the JVM."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=100_000)
def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def partial_token_ratio(a: list[str], b: list[str]) -> float:
    """The shorter token list slid over the longer; best ratio; 1.0 if the shorter is empty."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 1.0
    text = " ".join(short)
    return max(ratio(text, " ".join(long[i : i + len(short)])) for i in range(len(long) - len(short) + 1))


@F.pandas_udf(T.DoubleType())
def text_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """0.0 if either side is null or empty."""
    return pd.Series([ratio(x, y) if x and y else 0.0 for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def token_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([partial_token_ratio(list(x) if x is not None else [], list(y) if y is not None else []) for x, y in zip(a, b, strict=True)])


def edits_allowed(b: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(0.3 * F.length(b)).cast("int"))


def within_edits(a: Column, b: Column) -> Column:
    """Edit distance at most a third of b (at least one)."""
    return F.levenshtein(a, b) <= edits_allowed(b)


def near_pairs(forms: DataFrame, listed: DataFrame) -> DataFrame:
    """``form, listed, edits``: all pairs of the distinct ``form`` and ``listed`` that are ``within_edits``, each once.

    Of the k + 1 segments of a word with k edits allowed, one is untouched and stands in the form at most k
    places off; so pairs are sought by segment (of four letters at most, as k is about a third) and none is lost.
    """
    n, m, k = F.length("listed"), F.length("form"), edits_allowed(F.col("listed"))
    border = lambda i: F.floor(i * n / (k + 1)).cast("int")
    segments = F.transform(F.sequence(F.lit(0), k), lambda i: F.struct(border(i).alias("p"), F.substring("listed", border(i) + 1, border(i + 1) - border(i)).alias("segment")))
    words = listed.select("listed", n.alias("n"), k.alias("k"), F.inline(segments))
    places = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), lambda q: F.transform(F.sequence(F.lit(1), F.lit(4)), lambda size: F.struct((q - 1).alias("q"), F.substring("form", q, size).alias("segment")))))
    # A word of one letter has an empty segment.
    grams = forms.select("form", m.alias("m"), F.inline(F.array_distinct(F.concat(places, F.array(F.struct(F.lit(0).alias("q"), F.lit("").alias("segment")))))))
    met = grams.join(words, "segment").where((F.abs(F.col("p") - F.col("q")) <= F.col("k")) & (F.abs(F.col("m") - F.col("n")) <= F.col("k")))
    near = met.select("form", "listed", "k", F.levenshtein("form", "listed").alias("edits")).where("edits <= k")
    return near.select("form", "listed", "edits").distinct()


def phrase_places(words: Column, phrase: Column) -> Column:
    """All places at which the phrase stands in the words (none for an empty phrase)."""
    last = F.size(words) - F.size(phrase)
    fits = (F.size(phrase) > 0) & (last >= 0)
    places = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(words, i + 1, F.greatest(F.size(phrase), F.lit(1))) == phrase)
    return F.when(fits, places).otherwise(F.array().cast("array<int>"))
