"""Cutting oversized items at natural boundaries, with an overlap between consecutive pieces.

Dynamic programming over the boundary positions of an item chooses the cuts with the least sum of cut
penalties (end of a sentence, of a clause, of a line, between words, inside a word) and squared size
imbalance, every piece at most ``max_chars`` long including the overlap it repeats from the piece
before. The overlap is the longest run of whole words within ``overlap_chars``; it is shorter only where a
word is too long to stand in a piece with it. A word longer than the limit is cut inside, at the limit.

Items are grouped by key in the JVM; only items longer than the limit meet Python. An item of more than
``giant_chars`` characters is never gathered: its words are put in order by ranges, every task runs the dynamic
programming along its stretch, and the ends of the stretches, from the last natural boundary of one to the first
of the next, are cut together in a small second step. So no key, however hot, gathers in one task, and a stretch
ends where a sentence does, if one ends near.

Null texts are left out; a word delivered twice counts once; words without a place (null ordinals)
sort first; an item without text has no piece; an empty table gives none; lengths are code points.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.storage import require, written

SENTENCE, CLAUSE, LINE, WORD, INSIDE = 0.0, 0.25, 0.5, 1.0, 4.0
#: More than any sum of other costs.
SHORTENED = 1e6
#: Characters of an item above which it is cut in stretches.
GIANT = 1 << 20
CLOSERS = "\"')]»«“”’"


def boundary_penalty(word: str, line_end: bool) -> float:
    """How unnatural a cut after this word is."""
    bare = word.rstrip(CLOSERS)
    if bare[-1:] in (".", "!", "?"):
        return SENTENCE
    if bare[-1:] in (",", ";", ":"):
        return CLAUSE
    return LINE if line_end and bare[-1:] not in ("-", "⸗", "¬", "=", "‐") else WORD


def cut_points(lengths: list[int], penalties: list[float], max_chars: int, overlap_chars: int, begin: int = 0) -> list[tuple[int, int]]:
    """Pieces as (first, end) of atom numbers, overlap included; every atom fits ``max_chars`` on its own.

    Consecutive atoms are joined by one blank. The state is the end of the last piece; a piece that ends
    at j starts with the atoms that fit the overlap before the previous end i. Every atom may be the last of
    a piece. A piece that doesn't fit with its overlap costs ``SHORTENED``, so it is made only where no other
    cuts exist; its overlap is what fits. The atoms before ``begin`` are overlap only.
    """
    n = len(lengths)
    if begin >= n:
        return []
    at = np.concatenate([[0], np.cumsum(np.asarray(lengths, dtype=np.int64) + 1)])
    inside = [False, *[x == INSIDE for x in penalties]]  # of the atom after: whether it goes on with a word
    places, back, b = at.tolist(), [0] * (n + 1), 0
    for i in range(1, n + 1):
        while b < i and (places[i] - 1 - places[b] > overlap_chars or inside[b]):
            b += 1
        back[i] = b
    if places[n] - 1 - places[back[begin]] <= max_chars:
        return [(back[begin], n)]
    whole = places[n] - 1 - places[begin]
    aim = min(max_chars, max(whole / -(-whole // max(1, max_chars - overlap_chars)) + overlap_chars, max_chars / 2))
    best, prev, low, starts = np.full(n + 1, np.inf), [0] * (n + 1), begin, at[back]
    best[begin] = 0.0
    for j in range(begin + 1, n + 1):
        while places[j] - 1 - places[low] > max_chars:
            low += 1
        size = places[j] - 1 - starts[low:j]
        short = (aim - np.minimum(size, max_chars)) / max_chars
        total = best[low:j] + 4 * short * short + SHORTENED * (size > max_chars)
        i = j - 1 - int(np.argmin(total[::-1]))
        best[j], prev[j] = total[i - low] + 1.0 + (penalties[j - 1] if j < n else 0.0), i
    pieces, j = [], n
    while j > begin:
        i = prev[j]
        start = back[i]
        while start < i and (places[j] - 1 - places[start] > max_chars or inside[start]):
            start += 1
        pieces.append((start, j))
        j = i
    return pieces[::-1]


def split_words(words: list[str], line_ends: list[bool], max_chars: int, overlap_chars: int, carried: int = 0) -> list[tuple[int, int, int, str]]:
    """(first word, end word, overlap words, text) of the pieces; ``carried`` leading words are overlap only."""
    return [(first, end, again, text) for first, end, again, _, _, text in cut_words(words, line_ends, max_chars, overlap_chars, carried)]


def cut_words(words: list[str], line_ends: list[bool], max_chars: int, overlap_chars: int, carried: int = 0) -> list[tuple[int, int, int, int, bool, str]]:
    """(first word, end word, overlap words, overlap characters, starts inside a word, text) of the pieces.

    The ``carried`` leading words are overlap only.
    """
    atoms: list[str] = []
    owner: list[int] = []
    penalties: list[float] = []
    for w, word in enumerate(words):
        parts = [word[i : i + max_chars] for i in range(0, len(word), max_chars)] or [""]
        for p, part in enumerate(parts):
            atoms.append(part)
            owner.append(w)
            penalties.append(INSIDE if p < len(parts) - 1 else boundary_penalty(word, line_ends[w]))
    first = bisect_left(owner, carried)
    found, done = [], first
    for start, end in cut_points([len(a) for a in atoms], penalties, max_chars, overlap_chars, first):
        shown = [atoms[i] if i == start or owner[i] == owner[i - 1] else f" {atoms[i]}" for i in range(start, end)]
        again, text = sum(map(len, shown[: done - start])) + (done > start and owner[done] != owner[done - 1]), "".join(shown)
        inside = 0 < done < len(owner) and owner[done] == owner[done - 1]
        found.append((owner[start], owner[end - 1] + 1, max(0, owner[done] - owner[start]), again, inside, text))
        done = end
    return found


PIECE = ("block", "piece", "first_word", "last_word", "overlap_words", "overlap_chars", "inside", "text")
PIECE_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
PIECE_SQL = "block bigint, piece int, first_word bigint, last_word bigint, overlap_words int, overlap_chars int, inside boolean, text string"
Word = tuple[int | None, str, int | None]


def pieces_of(words: list[Word], block: int, carried: int, max_chars: int, overlap_chars: int, first_piece: int = 0, next_line: int | None = -1) -> list[tuple]:
    """Rows (without their keys) of a stretch of (word_id, text, line); ``next_line`` is that of the word after it."""
    if len(words) <= carried:
        return []
    lines = [w[2] for w in words] + [next_line]
    ends = [a != b for a, b in zip(lines[:-1], lines[1:], strict=True)]
    cut = cut_words([w[1] for w in words], ends, max_chars, overlap_chars, carried)
    return [(block, k, words[first][0], words[end - 1][0], again, chars, inside, text) for k, (first, end, again, chars, inside, text) in enumerate(cut, first_piece)]


def _key_columns(keys: list[pa.Array], rows: list[int], out: list[tuple], types: tuple, names: list[str]) -> pa.RecordBatch:
    at = pa.array(rows, pa.int64())
    columns = list(zip(*out, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([*[k.take(at) for k in keys], *[pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]], names=names)


def _piece_batches(batches: Iterator[pa.RecordBatch], n_keys: int, max_chars: int, overlap_chars: int) -> Iterator[pa.RecordBatch]:
    """Items gathered whole."""
    for batch in batches:
        rows, out = [], []
        lists = batch.column(n_keys)
        bounds, items = lists.offsets.to_pylist(), lists.values
        lines, ids, texts = (items.field(i).to_pylist() for i in (0, 2, 3))
        for row in range(batch.num_rows):
            low, high = bounds[row], bounds[row + 1]
            found = pieces_of(list(zip(ids[low:high], texts[low:high], lines[low:high], strict=True)), 0, 0, max_chars, overlap_chars)
            rows += [row] * len(found)
            out += found
        yield _key_columns([batch.column(i) for i in range(n_keys)], rows, out, PIECE_TYPES, [*batch.schema.names[:n_keys], *PIECE])


def seam(words: list[Word], low: int, high: int) -> int:
    """Where to part a stretch: before the word after the most natural boundary ``low`` to ``high`` characters into it."""
    best, at, found = math.inf, 0, 0
    for k, (_, text, line) in enumerate(words[:-1]):
        at += len(text) + 1
        if at <= low:
            continue
        penalty = boundary_penalty(text, words[k + 1][2] != line)
        if penalty < best:
            best, found = penalty, k + 1
        if at >= high:
            break
    return found


def context(words: list[Word], at: int, overlap_chars: int) -> list[Word]:
    """The words before a seam that an overlap may hold."""
    first, size = at, -1
    while first > 0 and size + len(words[first - 1][1]) + 1 <= overlap_chars:
        first -= 1
        size += len(words[first][1]) + 1
    return words[first:at]


class _Stretch:
    """The words of one giant item in one task, cut as they come; what is near its ends is left to the second step."""

    def __init__(self, task: int, max_chars: int, overlap_chars: int, held_chars: int) -> None:
        self.block, self.max_chars, self.overlap = 2 * task + 1, max_chars, overlap_chars
        self.edge = max_chars + overlap_chars
        self.held_chars = max(held_chars, 6 * self.edge)
        self.words: list[Word] = []
        self.chars = self.carried = self.pieces = 0
        self.head: list[Word] | None = None
        self.out: list[tuple] = []

    def add(self, word: Word) -> None:
        self.words.append(word)
        self.chars += len(word[1]) + 1
        if self.chars > self.held_chars:
            self.cut()

    def cut(self) -> None:
        """Cut what is held up to a seam near its end."""
        if self.head is None:
            at = seam(self.words, self.overlap, self.edge)
            self.head = self.words[:at]
            before = context(self.words, at, self.overlap)
            self.words, self.carried = before + self.words[at:], len(before)
        sizes = sum(len(w[1]) + 1 for w in self.words)
        at = seam(self.words, max(sizes - self.edge, self.edge), sizes)
        if at > self.carried:
            found = pieces_of(self.words[:at], self.block, self.carried, self.max_chars, self.overlap, self.pieces, self.words[at][2])
            self.out += found
            self.pieces += len(found)
            before = context(self.words, at, self.overlap)
            self.words, self.carried = before + self.words[at:], len(before)
        self.chars = sum(len(w[1]) + 1 for w in self.words)

    def end(self) -> str:
        """What the second step needs: the whole stretch if it is short, else its head and tail."""
        if self.head is None and self.chars > 4 * self.edge:
            self.cut()
        if self.head is None:
            return json.dumps({"block": self.block, "whole": self.words})
        return json.dumps({"block": self.block, "head": self.head, "tail": self.words, "carried": self.carried})


def _stretch_batches(batches: Iterator[pa.RecordBatch], n_keys: int, max_chars: int, overlap_chars: int, held_chars: int) -> Iterator[pa.RecordBatch]:
    task, stretch, key, last = TaskContext.get().partitionId(), None, None, None
    names, types = None, (*PIECE_TYPES, pa.string())

    def made() -> pa.RecordBatch:
        rows = [(*row, None) for row in stretch.out] + ([(*[None] * len(PIECE), ends)] if ends else [])
        stretch.out = []
        return _key_columns(key_arrays, [0] * len(rows), rows, types, names)

    for batch in batches:
        names = [*batch.schema.names[:n_keys], *PIECE, "ends"]
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for row, values in enumerate(zip(*columns, strict=True)):
            if values == last:
                continue
            last = values
            if stretch is None or values[:n_keys] != key:
                if stretch is not None:
                    ends = stretch.end()
                    yield made()
                key, stretch = values[:n_keys], _Stretch(task, max_chars, overlap_chars, held_chars)
                key_arrays = [batch.column(i).slice(row, 1) for i in range(n_keys)]
            line, _, word_id, text = values[n_keys:]
            stretch.add((word_id, text, line))
        if stretch is not None and stretch.out:
            ends = None
            yield made()
    if stretch is not None:
        ends = stretch.end()
        yield made()


def _ends_batches(batches: Iterator[pa.RecordBatch], n_keys: int, max_chars: int, overlap_chars: int) -> Iterator[pa.RecordBatch]:
    """The ends of neighbouring stretches of an item, cut together."""
    for batch in batches:
        rows, out = [], []
        for row, texts in enumerate(batch.column(n_keys).to_pylist()):
            words, carried, block = [], 0, 0
            for part in sorted((json.loads(t) for t in texts), key=lambda x: x["block"]):
                if "whole" in part:
                    words += part["whole"]
                    continue
                words += part["head"]
                found = pieces_of(words, block, carried, max_chars, overlap_chars)
                rows += [row] * len(found)
                out += found
                words, carried, block = part["tail"], part["carried"], part["block"] + 1
            found = pieces_of(words, block, carried, max_chars, overlap_chars)
            rows += [row] * len(found)
            out += found
        yield _key_columns([batch.column(i) for i in range(n_keys)], rows, out, PIECE_TYPES, [*batch.schema.names[:n_keys], *PIECE])


def long_keys(words: DataFrame, keys: list[str], max_chars: int) -> DataFrame:
    """Keys of items that may be too long, and ``most``: their texts and the blanks between, repeats not taken out.

    The sums are taken before the shuffle, which carries one row per item and task.
    """
    rows = require(words, *keys, "text").where("text is not null")
    return rows.groupBy(*keys).agg((F.sum(F.length("text")) + F.count("*") - 1).alias("most")).where(F.col("most") > max_chars)


def _named(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_long_{k}") for k in keys])


def _on(words: DataFrame, keys: list[str]):
    return [words[k].eqNullSafe(F.col(f"_long_{k}")) for k in keys]


def _gathered(words: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., items``: the words of every item in order, each once."""
    rows = require(words, *keys, "line_ord", "word_ord", "word_id", "text").where("text is not null")
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("line_ord", "word_ord", "word_id", "text"))).alias("items"))


def _cut(words: DataFrame, long: DataFrame, keys: list[str], max_chars: int, overlap_chars: int, giant_chars: int) -> DataFrame:
    words = require(words, *keys, "line_ord", "word_ord", "word_id", "text").where("text is not null")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema.fields[: len(keys)])
    how = {"n_keys": len(keys), "max_chars": max_chars, "overlap_chars": overlap_chars}
    usual = _gathered(words.join(_named(long.where(F.col("most") <= giant_chars), keys), _on(words, keys), "left_semi"), keys)
    pieces = usual.mapInArrow(partial(_piece_batches, **how), f"{schema}, {PIECE_SQL}")
    giants = long.where(F.col("most") > giant_chars)
    if not giants.limit(1).count():
        return pieces
    order = (*keys, "line_ord", "word_ord", "word_id", "text")
    placed = words.join(_named(giants, keys), _on(words, keys), "left_semi").repartitionByRange(*order).sortWithinPartitions(*order)
    cut = written(placed.mapInArrow(partial(_stretch_batches, **how, held_chars=giant_chars), f"{schema}, {PIECE_SQL}, ends string"), "stretches")
    ends = cut.where("ends is not null").groupBy(*keys).agg(F.collect_list("ends").alias("ends")).mapInArrow(partial(_ends_batches, **how), f"{schema}, {PIECE_SQL}")
    return pieces.unionByName(cut.where("ends is null").drop("ends")).unionByName(ends)


def cut_items(words: DataFrame, keys: list[str], max_chars: int = 1000, overlap_chars: int = 100, giant_chars: int = GIANT) -> DataFrame:
    """The pieces of the items that ``long_keys`` names; their words are shuffled once, by key."""
    return _cut(words, written(long_keys(words, keys, max_chars), "long"), keys, max_chars, overlap_chars, giant_chars)


def split_items(words: DataFrame, keys: list[str], max_chars: int = 1000, overlap_chars: int = 100, giant_chars: int = GIANT) -> DataFrame:
    """``keys..., block, piece, first_word, last_word, overlap_words, overlap_chars, inside, text`` of all items.

    (block, piece) is the order of the pieces. Without its first ``overlap_chars`` characters a piece goes on where the
    one before ended, after a blank unless it starts ``inside`` a word. An item within the limit is one piece and never
    leaves the JVM.
    """
    long = written(long_keys(words, keys, max_chars), "long")
    whole = _gathered(words.join(_named(long, keys), _on(words, keys), "left_anti"), keys)
    texts = F.array_join(F.transform("items", lambda x: x["text"]), " ")
    small = whole.select(*keys, F.lit(0).cast("bigint").alias("block"), F.lit(0).alias("piece"), F.col("items")[0]["word_id"].alias("first_word"), F.element_at("items", -1)["word_id"].alias("last_word"), F.lit(0).alias("overlap_words"), F.lit(0).alias("overlap_chars"), F.lit(False).alias("inside"), texts.alias("text"))
    return small.unionByName(_cut(words, long, keys, max_chars, overlap_chars, giant_chars))


def rejoined(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., text, longest``: every item put together again from its pieces, and the length of its longest piece."""
    new = F.substr("text", F.col("overlap_chars") + 1, F.greatest(F.length("text") - F.col("overlap_chars"), F.lit(0)))
    one = F.struct("block", "piece", F.when(F.col("inside"), new).otherwise(F.concat(F.lit(" "), new)).alias("t"))
    all_of = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("p"), F.max(F.length("text")).alias("longest"))
    text = F.array_join(F.transform("p", lambda x: x["t"]), "")
    return all_of.select(*keys, F.substr(text, F.lit(2), F.length(text)).alias("text"), "longest")


def oversized_items(words: DataFrame, keys: list[str], max_chars: int = 1000, overlap_chars: int = 100) -> DataFrame:
    """Keys of the items that had to be cut: those that came out in more than one piece."""
    pieces = cut_items(words, keys, max_chars, overlap_chars)
    return pieces.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
