"""Numeric functions: scores, colours, classes and the p-value of a correlation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column, midpoint: float = 100.0, steepness: float = 0.1) -> Column:
    return 1 / (1 + F.exp(-steepness * (x - midpoint)))


def coverage_penalty(coverage: Column) -> Column:
    return (1 - coverage) * 4


def anomaly(x: Column, q1: Column, q3: Column) -> Column:
    """Distance above the third quartile in quartile ranges, 0 below it."""
    return F.greatest((x - q3) / (q3 - q1), F.lit(0.0))


def ramp(score: Column) -> Column:
    """Red, green and blue of a score from 0 (green) over 0.5 (yellow) to 1 (red)."""
    s = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    red = F.when(s <= 0.5, F.floor(s * 2 * 255)).otherwise(255)
    green = F.when(s <= 0.5, 255).otherwise(F.floor((1 - (s - 0.5) * 2) * 255))
    return F.struct(red.cast("int").alias("r"), green.cast("int").alias("g"), F.lit(0).alias("b"))


def quality_sidebar(score: Column) -> Column:
    return F.when(score >= 0.9, "Good").when(score >= 0.7, "Fair").when(score >= 0.35, "Poor").otherwise("Very Problematic")


def quality_panel(score: Column) -> Column:
    return F.when(score >= 0.9, "Good").when(score >= 0.7, "Fair").when(score >= 0.5, "Poor").otherwise("Very Problematic")


def quality_dot(score: Column) -> Column:
    return F.when(score >= 0.9, "good").when(score >= 0.8, "fair").when(score >= 0.7, "poor").otherwise("bad")


def readability(ppl: Column, mean_logp: Column, low_percent: Column, n_tokens: Column) -> Column:
    base = F.when((ppl < 150) & (mean_logp > -4.5) & (low_percent < 3), "Good").when((ppl < 400) & (mean_logp > -6) & (low_percent < 7), "Fair").when((ppl < 1000) & (mean_logp > -8) & (low_percent < 15), "Poor").otherwise("Very Poor / Problematic")
    short = F.when(base.isin("Good", "Fair") & (low_percent > 10), "Poor (Short with errors)").when(n_tokens < 3, "Very Short / Unanalyzable").otherwise(base)
    return F.when(n_tokens < 10, short).otherwise(base)


def beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def regularised_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * beta_fraction(a, b, x) / a
    return 1 - front * beta_fraction(b, a, 1 - x) / b


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation r over n pairs: t distribution with n - 2 degrees of freedom."""
    if r is None or math.isnan(r) or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return regularised_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


# Colours that tell region types apart in a picture.
REGION_COLOURS = {"paragraph": "blue", "page_number": "orange", "header": "purple", "heading": "green", "marginalia": "red", "footnote": "brown", "other": "gray"}


def region_colour(region_type: Column) -> Column:
    out = F.lit(REGION_COLOURS["other"])
    for name, colour in REGION_COLOURS.items():
        out = F.when(region_type == name, colour).otherwise(out)
    return out
