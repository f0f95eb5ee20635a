"""Polygons given as "x,y x,y ...": areas and boxes as column expressions, intersections in Arrow batches.

Intersections decompose both polygons into horizontal slabs between all vertex and crossing heights;
in a slab the edges do not cross, so the inside intervals (even-odd) of both polygons are trapezoids
whose common parts integrate exactly. Self-intersecting rings count by the even-odd rule.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = "array<struct<x:int,y:int>>"


def points(text: Column) -> Column:
    """Points of a coordinate text; parts without a comma are skipped, unreadable numbers are null."""
    parts = F.filter(F.split(F.trim(text), r"\s+"), lambda p: F.contains(p, F.lit(",")))
    number = lambda p, i: F.split(p, ",")[i].try_cast("int")
    return F.coalesce(F.transform(parts, lambda p: F.struct(number(p, 0).alias("x"), number(p, 1).alias("y"))), F.array().cast(POINTS))


def area(polygon: Column) -> Column:
    """Shoelace area; 0 for fewer than three points."""
    follow = F.concat(F.slice(polygon, 2, F.greatest(F.size(polygon), F.lit(1))), F.slice(polygon, 1, 1))
    crossed = F.zip_with(polygon, follow, lambda p, q: p["x"].cast("double") * q["y"] - q["x"].cast("double") * p["y"])
    return F.when(F.size(polygon) >= 3, F.abs(F.aggregate(crossed, F.lit(0.0), lambda a, x: a + x)) / 2).otherwise(0.0)


def box(polygon: Column) -> Column:
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def boxes_meet(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


@lru_cache(maxsize=20_000)
def ring(text: str) -> np.ndarray:
    """Edges (x0, y0, x1, y1) of a coordinate text; horizontal edges are left out."""
    pts = np.array([[float(v) for v in p.split(",")[:2]] for p in text.split() if "," in p]).reshape(-1, 2)
    if len(pts) < 3:
        return np.empty((0, 4))
    edges = np.hstack([pts, np.roll(pts, -1, axis=0)])
    return edges[edges[:, 1] != edges[:, 3]]


def _crossings(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Heights at which edges of a cross edges of b."""
    if not len(a) or not len(b):
        return np.empty(0)
    p, r = a[:, None, :2], a[:, None, 2:] - a[:, None, :2]
    q, s = b[None, :, :2], b[None, :, 2:] - b[None, :, :2]
    cross = r[..., 0] * s[..., 1] - r[..., 1] * s[..., 0]
    d = q - p
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (d[..., 0] * s[..., 1] - d[..., 1] * s[..., 0]) / cross
        u = (d[..., 0] * r[..., 1] - d[..., 1] * r[..., 0]) / cross
    hit = (cross != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    return (p[..., 1] + t * r[..., 1])[hit]


def _spans(edges: np.ndarray, low: float, high: float) -> list[tuple[float, float, float, float]]:
    """Inside intervals of a slab: (left, right) at its lower and upper height."""
    top, bottom = np.maximum(edges[:, 1], edges[:, 3]), np.minimum(edges[:, 1], edges[:, 3])
    e = edges[(bottom <= low) & (top >= high)]
    slope = (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
    at_low, at_high = e[:, 0] + (low - e[:, 1]) * slope, e[:, 0] + (high - e[:, 1]) * slope
    order = np.argsort(at_low + at_high)
    at_low, at_high = at_low[order], at_high[order]
    return [(at_low[i], at_low[i + 1], at_high[i], at_high[i + 1]) for i in range(0, len(order) - 1, 2)]


def intersection_area(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 0.0
    heights = np.unique(np.concatenate([a[:, 1], a[:, 3], b[:, 1], b[:, 3], _crossings(a, b), _crossings(a, a), _crossings(b, b)]))
    total = 0.0
    for low, high in zip(heights[:-1], heights[1:], strict=True):
        for l0, r0, l1, r1 in _spans(a, low, high):
            for m0, s0, m1, s1 in _spans(b, low, high):
                wide0, wide1 = min(r0, s0) - max(l0, m0), min(r1, s1) - max(l1, m1)
                if wide0 > 0 or wide1 > 0:
                    total += (max(wide0, 0.0) + max(wide1, 0.0)) / 2 * (high - low)
    return float(total)


@lru_cache(maxsize=20_000)
def convex(text: str) -> tuple[tuple[float, float], ...] | None:
    """The corners of a convex polygon, turning left throughout; None for any other."""
    pts = [(float(x), float(y)) for x, y, *_ in (p.split(",") for p in text.split() if "," in p)]
    n = len(pts)
    if n < 3:
        return None
    turns = [_turn(pts[i], pts[(i + 1) % n], pts[(i + 2) % n]) for i in range(n)]
    if all(t <= 0 for t in turns):
        pts.reverse()
    elif not all(t >= 0 for t in turns):
        return None
    # A star turns one way too, but more than once around: its edges' directions wrap.
    wraps = sum(1 for i in range(n) if _angle(pts, i + 1) < _angle(pts, i) - 1e-12)
    return tuple(pts) if wraps == 1 else None


def _turn(p: tuple, q: tuple, r: tuple) -> float:
    return (q[0] - p[0]) * (r[1] - q[1]) - (q[1] - p[1]) * (r[0] - q[0])


def _angle(pts: list, i: int) -> float:
    p, q = pts[i % len(pts)], pts[(i + 1) % len(pts)]
    return math.atan2(q[1] - p[1], q[0] - p[0])


def clipped_area(a: tuple, b: tuple) -> float:
    """Common area of two convex polygons: one is cut by every side of the other."""
    out = list(a)
    for i in range(len(b)):
        p, q = b[i], b[(i + 1) % len(b)]
        sides = [_turn(p, q, r) for r in out]
        cut = []
        for k, r in enumerate(out):
            s, here, there = out[(k + 1) % len(out)], sides[k], sides[(k + 1) % len(out)]
            if here >= 0:
                cut.append(r)
            if here * there < 0:
                t = here / (here - there)
                cut.append((r[0] + t * (s[0] - r[0]), r[1] + t * (s[1] - r[1])))
        out = cut
        if len(out) < 3:
            return 0.0
    return abs(sum(out[k][0] * out[(k + 1) % len(out)][1] - out[(k + 1) % len(out)][0] * out[k][1] for k in range(len(out)))) / 2


def common_area(a: str, b: str) -> float:
    """Common area of two coordinate texts: by clipping where both are convex, else by slabs."""
    p, q = convex(a), convex(b)
    return clipped_area(p, q) if p and q else intersection_area(ring(a), ring(b))


def polygon_area(a: np.ndarray) -> float:
    return intersection_area(a, a)


@F.pandas_udf(T.DoubleType())
def shared_area(a: pd.Series, b: pd.Series) -> pd.Series:
    """Area that two coordinate texts have in common; null or short ones have none."""
    return pd.Series([common_area(x, y) if x and y else 0.0 for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def even_odd_area(a: pd.Series) -> pd.Series:
    return pd.Series([common_area(x, x) if x else 0.0 for x in a])


def iou(shared: Column, a: Column, b: Column) -> Column:
    union = a + b - shared
    return F.when(union > 0, shared / union).otherwise(0.0)
