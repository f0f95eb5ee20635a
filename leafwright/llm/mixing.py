"""Mixing sources to target weights under a cap on repeats.

Shares of sources are tempered: p_i ~ size_i ** alpha. The exponent is found by bisection so that the
tempered shares have the entropy of the target shares, or the largest entropy at which no source must
be repeated more often than allowed, whichever is lower. Where targets are given for each source (as
``mix_targets`` does) the weights are those targets; a source that cannot give its share even at its
most repeats is filled up with ``max_repeats`` and the rest keeps its targets. The weights become
token budgets; a source of n tokens and budget b gives floor(b / n) whole passes and one part pass.
The part pass is a prefix of a permutation of the source's blocks, and blocks are hash buckets of
bounded size, so no source (however large) is ever ordered as a whole. In the block that the budget ends
in, texts are taken in hash order wherever they still fit.

A null source has no target: it counts for the total and gives nothing. Sources without a row in the
targets give nothing; targets without texts are reported with 0. Null and empty texts have 0 tokens.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafwright.storage import bounded_rows

MAX_SOURCES = 100_000


def entropy(shares: list[float]) -> float:
    return -sum(p * math.log(p) for p in shares if p > 0)


def tempered(sizes: list[float], alpha: float) -> list[float]:
    """Normalised size ** alpha, computed in logarithms."""
    logs = [alpha * math.log(x) if x > 0 else -math.inf for x in sizes]
    top = max(logs, default=0.0)
    if top == -math.inf:
        return [0.0] * len(sizes)
    raw = [math.exp(x - top) for x in logs]
    return [x / sum(raw) for x in raw]


def within_caps(alpha: float, sizes: list[float], caps: list[float], budget: float) -> bool:
    """Whether no source must be repeated more often than its cap."""
    shares = tempered(sizes, alpha)
    return all(p * budget <= cap * size * (1 + 1e-9) for p, size, cap in zip(shares, sizes, caps, strict=True))


def fitted_exponent(sizes: list[float], caps: list[float], budget: float, wanted_entropy: float, steps: int = 80) -> float:
    """The smallest exponent whose shares have at most the wanted entropy and keep the repeat caps.

    Entropy falls as alpha rises, from that of equal shares at 0 to that of the largest sources alone, so it
    bisects over [0, 64]. Small sources are repeated less as alpha rises up to 1, so within [0, 1] the caps bisect
    too. Beyond 1 only the largest sources gain: caps that do not hold there hold nowhere above, and the exponent
    is returned as it is (``within_caps`` tells).
    """

    def bisect(fits, lo: float, hi: float) -> float:
        if fits(lo):
            return lo
        for _ in range(steps):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if fits(mid) else (mid, hi)
        return hi

    alpha = bisect(lambda a: entropy(tempered(sizes, a)) <= wanted_entropy, 0.0, 64.0)
    return bisect(lambda a: within_caps(a, sizes, caps, budget), alpha, 1.0) if alpha < 1 else alpha


def source_sizes(counted: DataFrame) -> DataFrame:
    """``source, n_docs, n_tokens``; partial sums are taken before the shuffle."""
    return counted.groupBy("source").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))


def reach_report(counted: DataFrame, targets: DataFrame, limit: int = MAX_SOURCES) -> DataFrame:
    """Per target: tokens it has, tokens wanted of the total, the most it can give, and whether it falls short."""
    rows = bounded_rows(source_sizes(counted), limit, "the sources")
    total = sum(r["n_tokens"] for r in rows)
    size = {r["source"]: r["n_tokens"] for r in rows}
    docs = {r["source"]: r["n_docs"] for r in rows}
    wants = bounded_rows(targets.select("source", "target_share", "max_repeats").distinct(), limit, "the targets")
    out = []
    for w in sorted(wants, key=lambda x: x["source"] or ""):
        share, cap = float(w["target_share"] or 0.0), int(w["max_repeats"] or 0)
        have, want = size.get(w["source"], 0), share * total
        out.append((w["source"], docs.get(w["source"], 0), have, want, have * cap, have * cap < want))
    return counted.sparkSession.createDataFrame(out, "source string, n_docs bigint, n_tokens bigint, wanted_tokens double, most_tokens bigint, falls_short boolean")


def mixture_plan(counted: DataFrame, targets: DataFrame | None = None, budget: float | None = None, max_repeats: int = 4, limit: int = MAX_SOURCES) -> list[dict]:
    """Budgets per source (a bounded list): ``source, n_tokens, wanted, most, budget, passes, part``, ``alpha, fits``.

    With targets their shares are the weights and their entropy the one the exponent is fitted to (it
    is reported, and it weights sources if ``targets`` is None). ``budget`` is by default all tokens; ``fits`` tells
    whether the exponent keeps the repeat caps.
    """
    rows = sorted((r for r in bounded_rows(source_sizes(counted), limit, "the sources")), key=lambda r: r["source"] or "")
    total = float(sum(r["n_tokens"] for r in rows)) if budget is None else float(budget)
    tokens_of = {r["source"]: r["n_tokens"] for r in rows if r["source"] is not None}
    want = {}
    if targets is not None:
        want = {r["source"]: r for r in bounded_rows(targets.select("source", "target_share", "max_repeats").where("source is not null").distinct(), limit, "the targets")}
    names = sorted({*tokens_of, *want})
    sizes = [float(tokens_of.get(n, 0)) for n in names]
    if targets is None:
        caps = [float(max_repeats)] * len(names)
        alpha = fitted_exponent(sizes, caps, total, math.log(len(names)) if names else 0.0)
        shares = tempered(sizes, alpha)
    else:
        shares = [float(want[n]["target_share"] or 0.0) if n in want else 0.0 for n in names]
        caps = [float(want[n]["max_repeats"] or 0) if n in want else 0.0 for n in names]
        alpha = fitted_exponent(sizes, caps, total, entropy([s / sum(shares) for s in shares]) if sum(shares) else 0.0)
    fits = within_caps(alpha, sizes, caps, total)
    plan = []
    for name, size, share, cap in zip(names, sizes, shares, caps, strict=True):
        tokens = min(share * total, cap * size)
        passes = int(tokens // size) if size else 0
        plan.append({"source": name, "n_tokens": int(size), "wanted_share": share, "wanted": share * total, "most": int(cap * size), "budget": tokens, "passes": passes, "part": tokens - passes * size, "alpha": alpha, "fits": fits})
    return plan


#: Blocks that are summed together before their order is taken, so that no window holds all blocks of a source.
SPAN = 4096


def mixed(counted: DataFrame, plan: list[dict], block_tokens: int = 1 << 20, seed: int = 11) -> DataFrame:
    """``doc_id, source, n_tokens, repeats``: how often each text is used.

    Every text is used ``passes`` times; the part pass takes blocks in hash order until the budget is
    met. In the block that it ends in, texts are taken in hash order, and those that are too long for what is left
    are passed over.
    """
    spark = counted.sparkSession
    fields = "source string, passes bigint, part double, blocks bigint"
    sources = spark.createDataFrame([(p["source"], p["passes"], float(p["part"]), max(1, -(-p["n_tokens"] // block_tokens))) for p in plan], fields)
    docs = counted.select("doc_id", "source", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")).join(F.broadcast(sources), "source")
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")))
    sums = docs.groupBy("source", "block", "part").agg(F.sum("n_tokens").alias("t")).withColumn("span", F.floor(F.col("block") / SPAN))
    spans = sums.groupBy("source", "span").agg(F.sum("t").alias("s"))
    ahead = spans.select("source", "span", (F.sum("s").over(_by("source", "span")) - F.col("s")).alias("ahead"))
    inside = sums.withColumn("inside", F.sum("t").over(_by(("source", "span"), "block")) - F.col("t"))
    before = inside.join(ahead, ["source", "span"]).withColumn("before", F.col("ahead") + F.col("inside"))
    room = before.select("source", "block", F.greatest(F.col("part") - F.col("before"), F.lit(0.0)).alias("room"), (F.col("t") + F.col("before") <= F.col("part")).alias("all_in"))
    placed = docs.join(room, ["source", "block"])
    whole = placed.where("all_in or room <= 0").withColumn("extra", F.col("all_in").cast("bigint")).select(*_DOC)
    order = F.xxhash64("doc_id", F.lit(seed + 1))
    cut = placed.where("not all_in and room > 0").select("doc_id", "source", "n_tokens", "passes", "room", order.alias("place"))
    taken = cut.groupBy("source").applyInPandas(_taken, "doc_id bigint, source string, n_tokens bigint, passes bigint, extra bigint")
    return whole.unionByName(taken).select("doc_id", "source", "n_tokens", (F.col("passes") + F.col("extra")).alias("repeats")).where("repeats > 0")


_DOC = ("doc_id", "source", "n_tokens", "passes", "extra")


def _taken(pdf: pd.DataFrame) -> pd.DataFrame:
    """The texts of one block (one a source), in hash order, wherever they fit into what is left of the budget."""
    pdf = pdf.sort_values(["place", "doc_id"], kind="stable")
    left, extra = float(pdf["room"].iloc[0]), []
    for n in pdf["n_tokens"]:
        extra.append(int(n <= left))
        left -= n if n <= left else 0
    return pdf.assign(extra=extra)[list(_DOC)]


def _by(part, *order):
    parts = (part,) if isinstance(part, str) else part
    return Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def share_report(used: DataFrame, plan: list[dict]) -> DataFrame:
    """Per source: share wanted, tokens used, share reached, the most repeats, and whether it falls short.

    A source falls short if all its texts stand in the mixture as often as they may and are still fewer tokens than
    wanted.
    """
    spark = used.sparkSession
    fields = "source string, wanted_share double, wanted double, most bigint, alpha double, fits boolean"
    wanted = spark.createDataFrame([tuple(p[k] for k in ("source", "wanted_share", "wanted", "most", "alpha", "fits")) for p in plan], fields)
    tokens = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    total = tokens.agg(F.sum("tokens").alias("all_tokens"))
    joined = wanted.join(tokens, "source", "left").crossJoin(F.broadcast(total))
    given = F.coalesce("tokens", F.lit(0))
    reached = F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0))
    short = (given >= F.col("most")) & (given < F.col("wanted"))
    return joined.select("source", "wanted_share", "wanted", given.alias("tokens"), reached.alias("reached_share"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), short.alias("falls_short"), "alpha", "fits")
