"""Long exact spans shared between records.

Units are hashed, equal digests are grouped over all records, the earliest occurrence is kept and the
rest can be removed at their original offsets. Lines alone cannot give every span of ``min_chars``
characters: texts without line ends have none, and a span may begin and end inside lines. So a unit
is the ``min_chars / 2`` characters from an anchor, and anchors are chosen from the text itself
(winnowing: in every window of as many hashes the smallest is an anchor). Any two places that agree
in ``min_chars`` characters then hold the same anchor and unit, whatever lies around them: no span is
missed. Units are compared as they stand, since spans must be verbatim.

A digest in more than one record is then checked against the text: each such place is read again
with ``min_chars / 2`` characters on both sides, equal surroundings form one class, and only
classes, not records, are compared with one another. A group of copies is one class. A digest of more than
``HOT`` classes (a formula that stands in many different texts) is not compared pair by pair: every class
gives the digests of all its windows of ``min_chars`` characters, and equal windows are grouped.

Defined cases: null and short texts, and texts without an id, have no units; of long runs of one repeated pattern one unit
a window and the last are kept (enough for any span that touches the run); spans shared only inside one record
do not count; further columns are ignored; an empty table gives empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafwright.storage import require, written

BASE = 0x9E3779B97F4A7C15
GRAM = 16
CHUNK_CHARS = 1 << 21
#: Classes of one digest up to which they are compared with one another.
HOT = 32


def _inverse(b: int) -> int:
    return pow(b, -1, 1 << 64)


def _powers(b: int, n: int) -> np.ndarray:
    out = np.full(n, b, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _slide(x: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over every window of w neighbours, by prefix and suffix scans of blocks of w."""
    if w == 1:
        return x
    n = len(x)
    pad = -n % w
    fill = np.iinfo(x.dtype).max if op is np.minimum else np.iinfo(x.dtype).min
    full = np.concatenate([x, np.full(pad, fill, dtype=x.dtype)]).reshape(-1, w)
    ahead = op.accumulate(full, axis=1).ravel()
    behind = op.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[: n - w + 1], ahead[w - 1 : n])


class Hasher:
    """Polynomial hashes modulo 2**64 of any window of a code point array, from one prefix sum."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, dtype=np.uint64)

    def prefix(self, codes: np.ndarray) -> np.ndarray:
        n = len(codes)
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 1 << 12)
            self.up, self.down = _powers(BASE, size), _powers(_inverse(BASE), size)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        return sums

    def at(self, sums: np.ndarray, starts: np.ndarray | slice, length: int) -> np.ndarray:
        if isinstance(starts, slice):
            return (sums[length:] - sums[:-length]) * self.down[: len(sums) - length]
        return (sums[starts + length] - sums[starts]) * self.down[starts]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def anchors(codes: np.ndarray, unit: int, window: int, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the units of one text and their digests."""
    n = len(codes) - unit + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sums = hasher.prefix(codes)
    order = _mix(hasher.at(sums, slice(None), min(GRAM, unit)))[:n]
    if n <= window:
        at = np.flatnonzero(order == order.min())
    else:
        low = _slide(order, window, np.minimum)
        edge = np.full(window - 1, 0, dtype=np.uint64)
        best = _slide(np.concatenate([edge, low, edge]), window, np.maximum)
        at = np.flatnonzero(best == order)
    digest = _mix(hasher.at(sums, at, unit)).view(np.int64)
    return _thin(at, digest, window)


def _thin(at: np.ndarray, digest: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal digests that follow one another within a window (a repeated pattern): one a window, and the last."""
    if len(at) < 3:
        return at, digest
    order = np.lexsort((at, digest))
    a, d = at[order], digest[order]
    fresh = np.concatenate([[True], (d[1:] != d[:-1]) | (a[1:] - a[:-1] > window)])
    chain = np.cumsum(fresh) - 1
    step = (a - a[fresh][chain]) // window
    kept = fresh.copy()
    kept[1:] |= step[1:] != step[:-1]
    kept[:-1] |= fresh[1:]
    kept[-1] = True
    return a[kept], d[kept]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _unit_batches(batches: Iterator[pa.RecordBatch], unit: int, window: int) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        ids, found = batch.column(0).to_pylist(), []
        for key, text in zip(ids, batch.column(1).to_pylist(), strict=True):
            if text is not None and key is not None and len(text) >= unit:
                at, digest = _long_anchors(_codes(text), unit, window, hasher)
                found.append((np.full(len(at), key, dtype=np.int64), at, digest))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "pos", "digest"])


def _long_anchors(codes: np.ndarray, unit: int, window: int, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Very long texts in overlapping chunks, so that memory stays bounded; same anchors or more."""
    if len(codes) <= CHUNK_CHARS:
        return anchors(codes, unit, window, hasher)
    step, ats, digests = CHUNK_CHARS - 2 * (unit + window), [], []
    for start in range(0, len(codes), step):
        at, digest = anchors(codes[start : start + CHUNK_CHARS], unit, window, hasher)
        ats.append(at + start)
        digests.append(digest)
    at, digest = np.concatenate(ats), np.concatenate(digests)
    at, first = np.unique(at, return_index=True)
    return at, digest[first]


def units(docs: DataFrame, min_chars: int = 200) -> DataFrame:
    """``doc_id, pos, digest`` of every unit of every text (about one per ``min_chars / 4`` characters)."""
    unit = max(1, min_chars // 2)
    fn = partial(_unit_batches, unit=unit, window=min_chars - unit + 1)
    return require(docs, "doc_id", "text").mapInArrow(fn, "doc_id bigint, pos bigint, digest bigint")


def _context_batches(batches: Iterator[pa.RecordBatch], unit: int, side: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for key, text, places in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            for place in places:
                pos = place["pos"]
                left = text[max(0, pos - side) : pos]
                for column, value in zip(out, (place["digest"], key, pos, len(left), left + text[pos : pos + unit + side]), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["digest", "doc_id", "pos", "before", "context"])


def places(docs: DataFrame, min_chars: int = 200) -> DataFrame:
    """Places whose unit also stands in another record, with the text around them.

    The units are made once and written, since counting and filtering both read them.
    """
    unit = max(1, min_chars // 2)
    found = written(units(docs, min_chars), "units")
    several = found.groupBy("digest").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("digest")
    hot = found.join(several, "digest", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("pos", "digest")).alias("places"))
    texts = require(docs, "doc_id", "text").join(hot, "doc_id").select("doc_id", "text", "places")
    context = texts.mapInArrow(partial(_context_batches, unit=unit, side=min_chars - unit), "digest bigint, doc_id bigint, pos bigint, before int, context string")
    return context.withColumn("kind", F.xxhash64("context", "before"))


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _compare_batches(batches: Iterator[pa.RecordBatch], unit: int, min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digest, kind_a, kind_b, before_a, before_b, text_a, text_b = (batch.column(i).to_pylist() for i in range(7))
        out: tuple[list, ...] = ([], [], [], [], [])
        for g, ka, kb, na, nb, a, b in zip(digest, kind_a, kind_b, before_a, before_b, text_a, text_b, strict=True):
            if a[na : na + unit] != b[nb : nb + unit]:
                continue
            left = common_prefix(a[:na][::-1], b[:nb][::-1])
            right = common_prefix(a[na + unit :], b[nb + unit :])
            if left + unit + right >= min_chars:
                for column, value in zip(out, (g, ka, kb, left, right), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["digest", "kind_a", "kind_b", "before", "after"])


class Classes:
    """The classes of places: ``few`` to be compared with one another, ``many`` (or None) to be grouped by windows."""

    def __init__(self, where: DataFrame, hot: int) -> None:
        kinds = where.select("digest", "kind", "before", "context").distinct()
        crowded = written(kinds.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("digest"), "crowded")
        self.few, self.many = kinds, None
        if crowded.limit(1).count():
            self.few, self.many = kinds.join(crowded, "digest", "left_anti"), kinds.join(crowded, "digest", "left_semi")


def matched_kinds(kinds: DataFrame, min_chars: int = 200) -> DataFrame:
    """Classes of places that share ``min_chars`` characters around their unit, a class with itself too.

    ``before`` and ``after`` are the characters shared on either side of the unit, at most
    ``min_chars / 2`` each; neighbouring units carry a longer span further.
    """
    unit = max(1, min_chars // 2)
    other = kinds.select("digest", *[F.col(c).alias(f"{c}_b") for c in ("kind", "before", "context")])
    pairs = kinds.join(other, "digest").where("kind <= kind_b").select("digest", "kind", "kind_b", "before", "before_b", "context", "context_b")
    return pairs.mapInArrow(partial(_compare_batches, unit=unit, min_chars=min_chars), "digest bigint, kind_a bigint, kind_b bigint, before int, after int")


def _window_batches(batches: Iterator[pa.RecordBatch], unit: int, min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for digest, kind, before, context in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            for shift in range(max(0, min_chars - (len(context) - before)), min(before, min_chars - unit) + 1):
                text = context[before - shift : before - shift + min_chars]
                window = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                for column, value in zip(out, (digest, kind, shift, window), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["digest", "kind", "before", "window"])


def windows(kinds: DataFrame, min_chars: int = 200) -> DataFrame:
    """``digest, kind, before, window``: every window of ``min_chars`` characters around the unit of a class."""
    fn = partial(_window_batches, unit=max(1, min_chars // 2), min_chars=min_chars)
    return kinds.select("digest", "kind", "before", "context").mapInArrow(fn, "digest bigint, kind bigint, before int, window binary")


def shared_pairs(docs: DataFrame, min_chars: int = 200, hot: int = HOT) -> DataFrame:
    """Pairs of records (the smaller id first) that share a verbatim span of ``min_chars`` or more."""
    where = written(places(docs, min_chars), "places")
    classes = Classes(where, hot)
    members = where.select("digest", "kind", "doc_id").distinct()
    a = members.withColumnsRenamed({"kind": "kind_a", "doc_id": "x"})
    b = members.withColumnsRenamed({"kind": "kind_b", "doc_id": "y"})
    kinds = matched_kinds(classes.few, min_chars)
    both = kinds.select("digest", "kind_a", "kind_b").join(a, ["digest", "kind_a"]).join(b, ["digest", "kind_b"]).select("x", "y")
    if classes.many is not None:
        held = written(windows(classes.many, min_chars).join(members, ["digest", "kind"]).select("window", "doc_id").distinct(), "windows")
        both = both.unionByName(held.withColumnRenamed("doc_id", "x").join(held.withColumnRenamed("doc_id", "y"), "window").where("x < y").select("x", "y"))
    return both.where("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()


def shared_spans(docs: DataFrame, min_chars: int = 200, earlier_only: bool = False, hot: int = HOT) -> DataFrame:
    """``doc_id, start, end`` of the maximal shared stretches of every record (end exclusive).

    With ``earlier_only`` just those that already stand in a record of smaller id: removing them keeps
    the earliest occurrence of everything.
    """
    unit = max(1, min_chars // 2)
    where = written(places(docs, min_chars), "places")
    classes = Classes(where, hot)
    held = where.groupBy("digest", "kind").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    kinds = matched_kinds(classes.few, min_chars)
    one = kinds.select("digest", F.col("kind_a").alias("kind"), F.col("kind_b").alias("partner"), "before", "after")
    two = kinds.where("kind_a <> kind_b").select("digest", F.col("kind_b").alias("kind"), F.col("kind_a").alias("partner"), "before", "after")
    partners = one.unionByName(two).join(held.withColumnRenamed("kind", "partner"), ["digest", "partner"]).drop("partner")
    if classes.many is not None:
        cut = written(windows(classes.many, min_chars).join(held, ["digest", "kind"]), "windows")
        shared = cut.groupBy("window").agg(F.min("first").alias("lo"), F.max("last").alias("hi")).where("lo < hi")
        grouped = cut.join(shared, "window").select("digest", "kind", "before", (F.lit(min_chars - unit) - F.col("before")).alias("after"), F.col("lo").alias("first"), F.col("hi").alias("last"))
        partners = partners.unionByName(grouped)
    near = where.select("digest", "kind", "doc_id", "pos").join(partners, ["digest", "kind"])
    near = near.where("first < doc_id") if earlier_only else near.where("first <> doc_id or last <> doc_id")
    reach = near.groupBy("doc_id", "pos").agg(F.max("before").alias("l"), F.max("after").alias("r"))
    return _joined(reach.select("doc_id", (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + unit + F.col("r")).alias("end")))


def _joined(pieces: DataFrame) -> DataFrame:
    """Intervals of a record with overlapping or touching ones made one."""
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = pieces.withColumn("fresh", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    numbered = fresh.withColumn("part", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "part").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("doc_id", "start", "end")


def remaining(docs: DataFrame, min_chars: int = 200) -> DataFrame:
    """``doc_id, start, end, text``: what is left of every record when spans that an earlier one has are taken out.

    Offsets are those of the original text; a record without text, or of repeats only, has no row.
    """
    gone = shared_spans(docs, min_chars, earlier_only=True).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("gone"))
    texts = require(docs, "doc_id", "text").where("text is not null").join(gone, "doc_id", "left")
    bounds = F.concat(F.array(F.lit(0).cast("bigint")), F.coalesce(F.transform("gone", lambda x: x["end"]), F.array().cast("array<bigint>")))
    ends = F.concat(F.coalesce(F.transform("gone", lambda x: x["start"]), F.array().cast("array<bigint>")), F.array(F.length("text").cast("bigint")))
    kept = F.filter(F.arrays_zip(bounds.alias("start"), ends.alias("end")), lambda x: x["start"] < x["end"])
    pieces = texts.select("doc_id", "text", F.explode(kept).alias("p"))
    part = F.substr("text", (F.col("p.start") + 1).cast("int"), (F.col("p.end") - F.col("p.start")).cast("int"))
    return pieces.select("doc_id", F.col("p.start").alias("start"), F.col("p.end").alias("end"), part.alias("text"))


def shared_share(docs: DataFrame, min_chars: int = 200) -> DataFrame:
    """One row per record: its length, how many characters of it stand elsewhere, and their share."""
    spans = shared_spans(docs, min_chars).groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("shared_chars"), F.count("*").alias("n_spans"))
    length = require(docs, "doc_id", "text").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n"))
    joined = length.join(spans, "doc_id", "left")
    shared = F.coalesce("shared_chars", F.lit(0))
    return joined.select("doc_id", F.col("n").alias("text_chars"), shared.alias("shared_chars"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.when(F.col("n") > 0, shared / F.col("n")).otherwise(0.0).alias("shared_share"))
