"""Layout comparison of ground truth and prediction: coverage, overlap and the scores built on them.

Lines, regions and words carry ordinals; "the first wins" is always the greatest measure, then the
smallest ordinal. Boxes that do not meet never reach the polygon function.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafwright.functions import geometry as geo
from leafwright.functions import text as tx
from leafwright.functions.similarity import token_ratio

PARAGRAPH_LIKE = ("paragraph", "header", "heading", "footnote")
COVERAGE, MIN_IOU, SIMILARITY = 0.85, 0.30, 0.53


def measured(df: DataFrame, coords: str) -> DataFrame:
    """Adds ``polygon_area`` (even-odd) and ``bbox`` of a coordinate text."""
    pts = geo.points(F.col(coords))
    return df.withColumn("bbox", geo.box(pts)).withColumn("polygon_area", F.when(F.size(pts) >= 3, geo.even_odd_area(F.col(coords))).otherwise(0.0))


def overlaps(left: DataFrame, right: DataFrame, page: str = "page_id") -> DataFrame:
    """Pairs on a page whose boxes meet: ``l_*``, ``r_*`` of both sides and ``shared``.

    Both sides have ``page, ord, coords, bbox, polygon_area``.
    """
    a = left.select(F.col(page), *[F.col(c).alias(f"l_{c}") for c in left.columns if c != page])
    b = right.select(F.col(page), *[F.col(c).alias(f"r_{c}") for c in right.columns if c != page])
    near = a.join(b, page).where(geo.boxes_meet(F.col("l_bbox"), F.col("r_bbox")))
    return near.withColumn("shared", geo.shared_area(F.col("l_coords"), F.col("r_coords")))


def best_cover(lines: DataFrame, regions: DataFrame, key: list[str]) -> DataFrame:
    """For every line the region that covers most of it: ``key..., coverage, best`` (a struct of the region)."""
    pairs = overlaps(lines, regions).withColumn("coverage", F.when(F.col("l_polygon_area") > 0, F.col("shared") / F.col("l_polygon_area")).otherwise(0.0)).where("coverage > 0")
    region = F.struct(*[F.col(f"r_{c}").alias(c) for c in regions.columns if c != "page_id"])
    return pairs.groupBy("page_id", *[f"l_{k}" for k in key]).agg(F.max("coverage").alias("coverage"), F.max_by(region, F.struct("coverage", -F.col("r_ord"))).alias("best")).withColumnsRenamed({f"l_{k}": k for k in key})


def overlay_verdicts(lines: DataFrame, regions: DataFrame, truth: DataFrame, with_text: bool = False) -> DataFrame:
    """Verdict of every predicted line against the ground-truth regions: ``error_type, score``.

    ``lines``: page_id, ord, region_ord, coords, bbox, polygon_area (and ``text``); ``regions``: the
    predicted ones by region_ord with region_coords, region_area; ``truth``: page_id, ord, type, coords,
    bbox, polygon_area (and ``tokens``, ``first_line``: the coords of its first line). In order: a line without area is an error; covered below 0.85
    it is a hallucination; in a paragraph-like region it is right, with a small penalty (with texts,
    a merge if its tokens are too unlike; the last line of its region that came as far as the overlap
    of regions is put before it, unless the true region is its own first line); else the predicted region must overlap the true one by 0.30.
    """
    plain = lines.select("page_id", "ord", "region_ord", "coords", "bbox", "polygon_area", *(["text"] if with_text else []))
    cover = best_cover(plain.drop("text"), truth, ["ord", "region_ord"])
    rows = plain.join(cover, ["page_id", "ord", "region_ord"], "left").join(regions, ["page_id", "region_ord"], "left")
    shared = geo.shared_area(F.col("region_coords"), F.col("best.coords"))
    region_iou = geo.iou(shared, F.coalesce("region_area", F.lit(0.0)), F.coalesce(F.col("best.polygon_area"), F.lit(0.0)))
    covered = F.coalesce("coverage", F.lit(0.0))
    steps = F.when(F.col("polygon_area") <= 0, "error:1").when(covered < COVERAGE, "hallucination:1")
    if with_text:
        before = Window.partitionBy("page_id", "region_ord").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
        overlapped = (F.col("polygon_area") > 0) & (covered >= COVERAGE) & ~F.col("best.type").isin(*PARAGRAPH_LIKE) & (F.coalesce("region_area", F.lit(0.0)) > 0)
        text = F.coalesce("text", F.lit(""))
        previous = F.when(F.col("best.first_line") == F.col("best.coords"), "").otherwise(F.coalesce(F.last(F.when(overlapped, text), ignorenulls=True).over(before), F.lit("")))
        rows = rows.withColumn("tokens", tx.tokens(tx.normal_hybrid(F.concat(previous, text))))
        steps = steps.when(F.col("best.type").isin(*PARAGRAPH_LIKE) & (token_ratio(F.col("tokens"), F.col("best.tokens")) < SIMILARITY), "merge:1")
    steps = steps.when(F.col("best.type").isin(*PARAGRAPH_LIKE), "none:p").when(F.coalesce("region_area", F.lit(0.0)) <= 0, "error:1").when(region_iou >= MIN_IOU, "none:0").otherwise("error:1")
    judged = rows.select("page_id", "region_ord", "ord", covered.alias("coverage"), steps.alias("v"))
    score = F.when(F.split("v", ":")[1] == "p", (1 - F.col("coverage")) * 4).otherwise(F.split("v", ":")[1].try_cast("double"))
    return judged.select("page_id", "region_ord", "ord", "coverage", F.split("v", ":")[0].alias("error_type"), score.alias("score"))


def match_penalty(truth: list[tuple[str, str]], predicted: list[str]) -> float:
    """Penalties of a page: missing or badly covered paragraphs, other regions without their own match, spare predictions."""
    areas = [geo.common_area(g, g) for g in predicted]
    used, score = [False] * len(predicted), 0.0
    for kind, own in truth:
        size = geo.common_area(own, own)
        shared = [geo.common_area(own, g) for g in predicted]
        if kind == "paragraph":
            cover = [s / size if size else 0.0 for s in shared]
            best = max(range(len(cover)), key=lambda i: (cover[i], -i), default=-1)
            if best < 0 or cover[best] <= 0:
                score += 0.5
                continue
            score += 1.0 if cover[best] < 0.33 else 0.5 if cover[best] < 0.5 else 0.0
        else:
            unions = [s / (size + a - s) if size + a - s > 0 else 0.0 for s, a in zip(shared, areas, strict=True)]
            free = [i for i in range(len(predicted)) if not used[i] and unions[i] > 0]
            best = max(free, key=lambda i: (unions[i], -i), default=-1)
            if best < 0:
                score += 1.0
                continue
            twice = any(i != best and unions[i] >= 0.33 for i in free)
            score += 1.0 if twice or unions[best] < 0.33 else 0.5 if unions[best] < 0.5 else 0.0
        used[best] = True
    return min(score + used.count(False), 100.0)


def region_matching(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """``page_id, score``; both sides: page_id, ord, type, coords. A page is one group (hundreds of regions at most)."""
    both = truth.select("page_id", F.lit(True).alias("real"), "ord", "type", "coords").unionByName(predicted.select("page_id", F.lit(False).alias("real"), "ord", "type", "coords"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        real, guess = pdf[pdf["real"]], pdf[~pdf["real"]]
        score = match_penalty(list(zip(real["type"], real["coords"].fillna(""), strict=True)), list(guess["coords"].fillna("")))
        return pd.DataFrame({"page_id": [pdf["page_id"].iloc[0]], "score": [score]})

    return both.where("page_id is not null").groupBy("page_id").applyInPandas(one, "page_id string, score double")


class Scorer:
    """A named scoring method: a function from words (and what else it needs) to ``word_id, score, error_type``."""

    def __init__(self, name: str, score: Callable[..., DataFrame]) -> None:
        self.name, self.score = name, score

    def __call__(self, words: DataFrame, *more: DataFrame) -> DataFrame:
        verdicts = self.score(words, *more)
        return words.join(verdicts.select("word_id", F.col("score").alias("new_score"), F.col("error_type").alias("new_type")), "word_id", "left").withColumn("scorer", F.lit(self.name))


def naive(words: DataFrame, seed: int = 0) -> DataFrame:
    """The baseline: a number from the first 52 bits of a digest of the word's id, uniform and repeatable."""
    digest = F.md5(F.concat_ws(":", F.col("word_id").cast("string"), F.lit(str(seed))))
    u = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / float(1 << 52)
    return words.select("word_id", u.alias("score"), F.when(u > 0.5, "error").otherwise("none").alias("error_type"))


def manual(pages: DataFrame, ratios: DataFrame) -> DataFrame:
    """``page_id, score``: the annotated error ratio, 0 where there is none."""
    return pages.select("page_id").join(ratios.select("page_id", "error_ratio"), "page_id", "left").select("page_id", F.coalesce("error_ratio", F.lit(0.0)).alias("score"))
