"""Noise in recognised pages: furniture out, divided words joined, misread words corrected.

1. Words are put in order by ranges of lines (one shuffle), so a task holds whole pages but for the first and
   the last. One pass finds words divided at line ends, keeps what the page's edge says about furniture, sets
   aside runs of unlisted words with their neighbours, and counts word bigrams and the evidence for character
   confusions. Of pages that go on in another task the parts' edges are put together in a small second step.
2. The confusion counts of all pages make the channel. Unlisted words get the listed words that the
   channel may have turned into them (``MAX_ERRORS`` confusions, more in long words, and any stray signs).
3. Each run is decoded by Viterbi: channel probability times bigram likelihood, with the unlisted word
   itself (a name, a foreign word) as one more candidate. Words with one reading only cut a line into
   runs, so decoding a run between its neighbours is decoding the line.
4. Headers and page numbers are told by what the pages nearby have in common, and a word divided at a
   page end is joined with the first word of the next page's text. Pages meet in blocks of their order
   with the pages around a block, so no book, however long, comes into one task.

Defined cases: null texts are skipped, and words without an id, which no repair could name (paragraphs keep
them as they are); a word delivered twice on a page counts once; words without page or ordinals are read alone;
pages without number have no neighbours, so only stated types and dressed numbers tell their furniture; a page
of only furniture gives only furniture; a line of more than ``MAX_HELD`` words is read in parts; further columns
are ignored; an empty table gives nothing.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.llm.channel import DIVIDERS, JOINERS, Form, Forms, WordList, plain, shared_list
from leafwright.llm.furniture import EDGE_LINES, HALO, Neighbours, furniture_lines, read_line
from leafwright.storage import bounded_rows, require, written

MAX_LISTED = 2_000_000
MAX_CONFUSIONS = 5_000
#: Confusions that a word may have; a long one as many as a third of its letters.
MAX_ERRORS = 3
#: Share of words that the channel changes, and of words that are not listed: the priors of decoding.
P_MISREAD, P_UNLISTED = 0.02, 0.03
LETTER = math.log(1 / 30)
#: Weight of the bigrams against the word alone.
BIGRAMS = 0.7
PAGE, RUN, GRAM, REPAIR, PART = range(5)
#: Rows of one page that a task holds at once, and pages of a block of neighbours.
MAX_HELD, BLOCK_PAGES = 131_072, 256
STEP = "kind int, page_id string, book_id string, a bigint, b bigint, text string"

#: Confusions known of blackletter print (true>seen), each worth as much as one observation.
KNOWN = "e>c c>e n>u u>n r>t t>r s>f f>s h>b b>h h>k k>h g>q a>o o>a d>cl m>in m>rn rn>m in>m k>t k>r r>k ü>u ä>a ö>o s>g g>s w>vv w>m li>h ie>w b>v v>b ß>tz d>t nn>im tt>u l>i i>l"

_STRAYS = re.compile(r"[^\w\-⸗‐‑¬=]|_")


def sequence_of(page_id: str | None) -> tuple[str, int] | None:
    """(prefix, number) of a page id that ends in a number."""
    found = re.search(r"(\d{1,15})$", page_id or "")
    return (page_id[: found.start()], int(found.group(1))) if found else None


class Reader:
    """Step 1 for the pages of one partition, a batch of whole pages at a time."""

    def __init__(self, words: WordList, forms: Forms) -> None:
        self.words, self.forms = words, forms
        self.out: tuple[list, ...] = ([], [], [], [], [], [])
        self.grams: list[np.ndarray] = []
        self.n_grams = 0

    def put(self, kind: int, page: str | None = None, book: str | None = None, a: int | None = None, b: int | None = None, text: str | None = None) -> None:
        for column, value in zip(self.out, (kind, page, book, a, b, text), strict=True):
            column.append(value)

    def batches(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """What has come together so far; bigrams once there are many or at the end."""
        if last or len(self.out[0]) > 20_000:
            yield _step_batch(*[pa.array(v, t) for v, t in zip(self.out, STEP_TYPES, strict=True)])
            self.out = ([], [], [], [], [], [])
        if self.grams and (last or self.n_grams > 1_000_000):
            size = len(self.words.words) + 1
            codes, n = np.unique(np.concatenate(self.grams), return_counts=True)
            first, back = np.unique(codes // size, return_inverse=True)
            codes = np.concatenate([codes, first * size + size - 1])
            n = np.concatenate([n, np.bincount(back, weights=n).astype(np.int64)])
            self.grams, self.n_grams = [], 0
            none = pa.nulls(len(codes), pa.string())
            yield _step_batch(pa.array(np.full(len(codes), GRAM, dtype=np.int32)), none, none, pa.array(codes), pa.array(n), none)

    def read(self, batch: pa.RecordBatch, first_open: bool = False, last_open: bool = False) -> None:
        """Whole pages, rows in order; the first or last page is open if it may go on outside the batch."""
        ids = batch.column("word_id").to_numpy()
        if len(ids) > 1 and (ids[1:] == ids[:-1]).any():
            batch = batch.filter(pa.array(np.concatenate([[True], ids[1:] != ids[:-1]])))
            ids = batch.column("word_id").to_numpy()
        if not len(ids):
            return
        text = batch.column("text")
        texts = text.to_pylist()
        fresh = _changes(batch.column("page_id"))
        region, line = (batch.column(c).fill_null(-1).to_numpy() for c in ("region_ord", "line_ord"))
        begins = fresh | (region < 0) | (line < 0)
        begins[1:] |= (region[1:] != region[:-1]) | (line[1:] != line[:-1])
        held, form = self.forms.held, self.forms
        forms = [held.get(t) or form(t) for t in texts]
        listed = np.array([f.listed for f in forms], dtype=np.int64)
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(ids))
        at = _Pages(batch, ids.tolist(), texts, forms, region.tolist(), fresh, begins.tolist(), starts.tolist(), ends.tolist())
        taken = self._divided(at, listed)
        self._runs(at, listed, taken)
        pairs = np.flatnonzero(~begins[1:] & (listed[1:] >= 0) & (listed[:-1] >= 0)) + 1
        self.grams.append(listed[pairs - 1] * (len(self.words.words) + 1) + listed[pairs])
        self.n_grams += len(pairs)
        chars = np.append(0, np.cumsum(pc.utf8_length(text).fill_null(0).to_numpy() + 1))
        widths = (chars[ends] - chars[starts]).tolist()
        firsts = np.flatnonzero(fresh[starts]).tolist()
        for first, end in zip(firsts, [*firsts[1:], len(starts)], strict=True):
            is_open = (first_open and first == 0) or (last_open and end == len(starts))
            self._page(at, first, end, widths, taken, is_open)

    def _divided(self, at: _Pages, listed: np.ndarray) -> set[int]:
        """Words divided between two lines of the page; returns their positions.

        A joined word that is not listed may be misread as well: it is set aside as a run of its own.
        """
        taken: set[int] = set()
        for end, start in zip(at.ends[:-1], at.starts[1:], strict=True):
            if at.fresh[start] or not may_join(at.forms[end - 1], at.forms[start]):
                continue
            if joins_here(at.forms[end - 1], at.forms[start], at.region[end - 1] == at.region[start], self.words):
                taken |= {end - 1, start}
                page, region = at.page(end - 1), at.region[end - 1]
                self.put(REPAIR, page, a=at.ids[end - 1], b=region, text=joined(at.texts[end - 1], at.texts[start]))
                self.put(REPAIR, at.page(start), a=at.ids[start], b=at.region[start])
                core = Form(joined(at.texts[end - 1], at.texts[start]), self.words)
                if core.alphabetic:
                    before = int(listed[end - 2]) if not at.begins[end - 1] and end - 2 not in taken else -1
                    after = int(listed[start + 1]) if start + 1 < len(listed) and not at.begins[start + 1] else -1
                    self._run(at.ids[end - 1], before, after, [[at.ids[end - 1], core.core]], page, region)
        return taken

    def _run(self, run: int, before: int, after: int, items: list, page: str | None, region: int) -> None:
        self.put(RUN, a=run, text=json.dumps([before, after, items, page, region], ensure_ascii=False))

    def _runs(self, at: _Pages, listed: np.ndarray, taken: set[int]) -> None:
        """Runs of unlisted words of a line with the listed words (or -1) on either side."""
        forms, ids, at_start, n = at.forms, at.ids, at.begins, len(listed)
        odd = [i for i in np.flatnonzero(listed < 0).tolist() if forms[i].alphabetic and i not in taken and (not forms[i].divided or forms[i].dividers == "~")]
        k = 0
        while k < len(odd):
            run = [odd[k]]
            while k + 1 < len(odd) and odd[k + 1] == run[-1] + 1 and not at_start[odd[k + 1]]:
                k += 1
                run.append(odd[k])
            k += 1
            left, right = run[0] - 1, run[-1] + 1
            before = int(listed[left]) if not at_start[run[0]] and left not in taken else -1
            after = int(listed[right]) if right < n and not at_start[right] and right not in taken else -1
            self._run(ids[run[0]], before, after, [[ids[i], forms[i].core] for i in run], at.page(run[0]), at.region[run[0]])

    def _page(self, at: _Pages, first: int, end: int, widths: list[int], taken: set[int], is_open: bool) -> None:
        """The edge lines, and the words at line ends and starts that a neighbouring page may continue."""
        row = at.starts[first]
        page_id = at.page(row)
        if page_id is None:
            return
        book_id, types = at.batch.column("book_id")[row].as_py(), at.batch.column("region_type")
        starts, ends = at.starts[first:end], at.ends[first:end]
        regions, n = [at.region[s] for s in starts], len(starts)
        sizes, lines = Counter(regions), []
        for k in sorted({*range(min(EDGE_LINES, n)), *range(max(0, n - EDGE_LINES), n)}):
            shown = [plain(t) for t in at.texts[starts[k] : ends[k]] if t is not None]
            kind = (types[starts[k]].as_py() or "").lower()
            lines.append(read_line([w for w in shown if w]) | {"k_no": k, "region": regions[k], "width": widths[first + k], "type": kind, "ids": at.ids[starts[k] : ends[k]]})
        tails = [[k, at.ids[ends[k] - 1], at.texts[ends[k] - 1], regions[k]] for k in range(n) if (k == n - 1 or regions[k + 1] != regions[k]) and _open(at.forms[ends[k] - 1], ends[k] - 1 in taken)]
        heads = [[k, at.ids[starts[k]], at.texts[starts[k]], regions[k]] for k in range(n) if (k == 0 or regions[k - 1] != regions[k]) and at.forms[starts[k]].lower and starts[k] not in taken]
        part = {"n": n, "longest": max(widths[first:end]), "sizes": [[r, sizes[r]] for r in {x["region"] for x in lines}], "lines": lines, "tails": tails, "heads": heads}
        if not is_open:
            self.put(PAGE, page_id, book_id, text=json.dumps(whole_page([part]), ensure_ascii=False))
            return
        last = ends[-1] - 1
        part |= {"order": [regions[0], int(at.batch.column("line_ord")[row].as_py() or 0), int(at.batch.column("word_ord")[row].as_py() or 0)], "ends": [[at.ids[i], at.texts[i], at.region[i], i in taken] for i in (row, last)]}
        self.put(PART, page_id, book_id, text=json.dumps(part, ensure_ascii=False))


def whole_page(parts: list[dict]) -> dict:
    """The edges of a page from those of its parts, in order: edge lines, region ends and region starts."""
    sizes, lines, tails, heads, n = Counter(), [], [], [], 0
    for part in parts:
        sizes.update(dict((r, size) for r, size in part["sizes"]))
        lines += [x | {"k_no": x["k_no"] + n} for x in part["lines"]]
        tails += [[t[0] + n, *t[1:]] for t in part["tails"]]
        heads += [[h[0] + n, *h[1:]] for h in part["heads"]]
        n += part["n"]
    longest = max(part["longest"] for part in parts)
    lines = [x for x in lines if x["k_no"] < EDGE_LINES or x["k_no"] >= n - EDGE_LINES]
    top_regions = sorted({x["region"] for x in lines if x["k_no"] < EDGE_LINES})[:2]
    numbered = {x["k_no"]: x["region"] for x in lines if x["n"] is not None}
    out = []
    for line in lines:
        k, region, size = line["k_no"], line["region"], sizes[line["region"]]
        number_by = size == 2 and any(numbered.get(j) == region for j in (k - 1, k + 1))
        single = size == 1 or number_by
        seen = {"top": k < EDGE_LINES and region in top_regions, "single": single, "small": size <= 2, "alone": single and (k == 0 or (k == 1 and number_by)), "long": line["width"] > 0.9 * longest}
        number = None if line["k"] and not single else line["n"]
        out.append({"k_no": k, "region": region, "n": number, "s": line["s"], "k": line["k"], "type": line["type"], "ids": line["ids"], **seen})
    return {"lines": out, "tails": tails, "heads": heads}


class _Pages:
    """The rows of some pages and where their lines start."""

    def __init__(self, batch: pa.RecordBatch, ids: list, texts: list, forms: list, region: list, fresh: np.ndarray, begins: list, starts: list, ends: list) -> None:
        self.batch, self.ids, self.texts, self.forms, self.region = batch, ids, texts, forms, region
        self.fresh, self.begins, self.starts, self.ends = fresh, begins, starts, ends
        self.pages = batch.column("page_id")

    def page(self, row: int) -> str | None:
        return self.pages[row].as_py()


STEP_TYPES = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())


def _step_batch(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=["kind", "page_id", "book_id", "a", "b", "text"])


def _changes(column: pa.Array) -> np.ndarray:
    """Where a column differs from the row before; a null row differs from any."""
    if not len(column):
        return np.zeros(0, dtype=bool)
    differs = pc.fill_null(pc.not_equal(column[1:], column[:-1]), True)
    return np.concatenate([[True], np.asarray(differs)])


def _open(form: Form, taken: bool) -> bool:
    """Whether a word at the end of a page may go on overleaf."""
    return not taken and bool(form.stem) and (form.divided or form.listed < 0)


def may_join(left: Form, right: Form) -> bool:
    """Whether two words at a line end and the next line's start may be halves, by their looks alone."""
    return right.lower and bool(left.stem) and (left.divided or (left.listed < 0 and right.listed < 0))


def joins_here(left: Form, right: Form, same_region: bool, words: WordList) -> bool:
    """Between regions only a listed word joins: a page number or a note may follow the text instead."""
    return joins(left, right, words) and (same_region or left.stem + right.core in words.ids)


def joins(left: Form | None, right: Form | None, words: WordList) -> bool:
    """Whether two words that meet at a line or page end are the halves of one."""
    if not left.stem or not right.core or not right.lower:
        return False
    known = left.stem + right.core in words.ids
    if not left.divided:
        return known and left.listed < 0 and right.listed < 0
    if known:
        return True
    if right.core in JOINERS or not right.core[0].isalpha():
        return False
    if left.dividers == "~" and left.stem in words.ids and right.listed >= 0:
        return False
    return right.core.isalpha()


def joined(left: str, right: str) -> str:
    return plain(left).rstrip(DIVIDERS) + plain(right)


def _read_batches(batches: Iterator[pa.RecordBatch], listed, max_held: int) -> Iterator[pa.RecordBatch]:
    """Pages as they come; the first and last page of a task, and what is cut off of a huge one, stay open."""
    reader, rest, first_open = Reader(*shared_list(listed.value)), None, True
    for batch in batches:
        held = batch if rest is None or not rest.num_rows else pa.concat_batches([rest, batch])
        cuts = np.flatnonzero(_changes(held.column("page_id")))
        cut = int(cuts[-1]) if len(cuts) else 0
        if cut:
            reader.read(held.slice(0, cut), first_open)
            held, first_open = held.slice(cut), False
        if held.num_rows > max_held:
            lines = np.flatnonzero(_changes(held.column("region_ord")) | _changes(held.column("line_ord")))
            at = int(lines[-1]) or held.num_rows
            reader.read(held.slice(0, at), first_open=True, last_open=True)
            held, first_open = held.slice(at), True
        rest = held
        yield from reader.batches()
    if rest is not None and rest.num_rows:
        reader.read(rest, first_open, last_open=True)
    yield from reader.batches(last=True)


def _part_batches(batches: Iterator[pa.RecordBatch], listed) -> Iterator[pa.RecordBatch]:
    """Pages put together from their parts, and words divided between two parts."""
    words, forms = shared_list(listed.value)
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for page_id, book_id, texts in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            parts = sorted((json.loads(t) for t in texts), key=lambda x: (x["order"], x["ends"][0][0]))
            page, gone = whole_page(parts), set()
            rows = []
            for one, two in zip(parts[:-1], parts[1:], strict=True):
                (a, left, region_a, taken_a), (b, right, region_b, taken_b) = one["ends"][1], two["ends"][0]
                if region_a == region_b:  # the region goes on: neither its end nor its start
                    gone |= {("tail", a), ("head", b)}
                if taken_a or taken_b or not may_join(forms(left), forms(right)):
                    continue
                if joins_here(forms(left), forms(right), region_a == region_b, words):
                    gone |= {("tail", a), ("head", b)}
                    rows += [(REPAIR, page_id, None, a, region_a, joined(left, right)), (REPAIR, page_id, None, b, region_b, None)]
            page["tails"] = [t for t in page["tails"] if ("tail", t[1]) not in gone]
            page["heads"] = [h for h in page["heads"] if ("head", h[1]) not in gone]
            for row in [*rows, (PAGE, page_id, book_id, None, None, json.dumps(page, ensure_ascii=False))]:
                for column, value in zip(out, row, strict=True):
                    column.append(value)
        yield _step_batch(*[pa.array(v, t) for v, t in zip(out, STEP_TYPES, strict=True)])


def read_pages(words: DataFrame, listed, max_held: int = MAX_HELD) -> DataFrame:
    """Step 1 over all words; written once, by kind of row. Lines are never divided between tasks."""
    rows = require(words, "page_id", "book_id", "region_ord", "region_type", "line_ord", "word_ord", "word_id", "text").where("word_id is not null")
    alone = F.when(F.col("page_id").isNull() | F.col("region_ord").isNull() | F.col("line_ord").isNull(), F.col("word_id"))
    placed = rows.withColumn("alone", alone).repartitionByRange("page_id", "region_ord", "line_ord", "alone").sortWithinPartitions("page_id", "region_ord", "line_ord", "word_ord", "word_id")
    steps = written(placed.drop("alone").mapInArrow(partial(_read_batches, listed=listed, max_held=max_held), STEP), "pages", "kind")
    parts = steps.where(F.col("kind") == PART).groupBy("page_id").agg(F.max("book_id").alias("book_id"), F.collect_list("text").alias("parts"))
    return steps.where(F.col("kind") != PART).unionByName(written(parts.mapInArrow(partial(_part_batches, listed=listed), STEP), "parts", "kind"))


def _evidence_batches(batches: Iterator[pa.RecordBatch], listed) -> Iterator[pa.RecordBatch]:
    words, _ = shared_list(listed.value)
    for batch in batches:
        shown = []
        for form in batch.column(0).to_pylist():
            found = words.one_edit(form) if form.isalpha() else []
            if found and len({c[0] for c in found}) == 1:
                shown += {c[1] for c in found}
        yield pa.RecordBatch.from_arrays([pa.array(shown, pa.string())], names=["confusion"])


def channel_table(steps: DataFrame, listed, limit: int = MAX_CONFUSIONS) -> dict[str, float]:
    """Log probability of every confusion that enough different forms show, or that is known of print.

    Evidence are the distinct unlisted forms of five letters or more that one single confusion turns
    into one single listed word.
    """
    known = KNOWN.split()
    runs = steps.where(F.col("kind") == RUN).select(F.explode(F.regexp_extract_all("text", F.lit(r'\[-?[0-9]+, "([^"\\\\]{5,})"\]'), F.lit(1))).alias("form"))
    seen = runs.distinct().mapInArrow(partial(_evidence_batches, listed=listed), "confusion string").groupBy("confusion").agg(F.count("*").alias("n")).where("n >= 2")
    counts = {r["confusion"]: r["n"] for r in bounded_rows(seen, limit, "the confusions")}
    total = sum(counts.values()) + len(known)
    counts = {c: n for c, n in counts.items() if n >= max(3, 0.0012 * total) or c in known}
    for c in known:
        counts[c] = counts.get(c, 0) + 1
    return {c: math.log(n / total) for c, n in counts.items()}


class Decoder:
    """Steps 2 and 3 for the runs of one partition."""

    def __init__(self, words: WordList, channel: dict[str, float]) -> None:
        self.words = words
        self.back: dict[str, list[tuple[str, float]]] = {}
        for c, p in channel.items():
            true, seen = c.split(">")
            self.back.setdefault(seen, []).append((true, p))
        self.longest = max((len(s) for s in self.back), default=1)
        self.stray = math.log(0.1)
        self.unseen = math.log(1 - BIGRAMS)
        self.rarest = min(words.logp, default=0.0)

    @lru_cache(maxsize=100_000)  # noqa: B019 (one decoder per task)
    def readings(self, form: str) -> tuple[tuple[int, float], ...]:
        """Listed words and the log probability that the channel made ``form`` of them.

        Only words that cannot win are left out: those less likely than another one even if all their
        bigrams are certain and none of the other's has been seen.
        """
        bare = _STRAYS.sub("", form)
        start = (len(form) - len(bare)) * self.stray
        if bare in self.words.ids:
            return ((self.words.ids[bare], start),) if bare != form else ()
        if not bare.isalpha() or len(bare) < 2:
            return ()
        found: dict[int, float] = {}
        limit = max(MAX_ERRORS, len(bare) // 3)
        for allowed in range(1, limit + 1):
            self._walk(self.words.trie(), bare, 0, allowed, start, found)
            if found:
                break
        if found:
            sure = lambda: max(p + self.unseen + self.words.logp[i] for i, p in found.items()) + self.unseen + self.rarest
            self._walk(self.words.trie(), bare, 0, limit, start, found, sure())
            least = sure()
            found = {i: p for i, p in found.items() if p >= least}
        return tuple(sorted(found.items(), key=lambda x: (-x[1], x[0])))

    def _walk(self, node: dict, form: str, at: int, errors: int, p: float, found: dict[int, float], least: float = -math.inf) -> None:
        """Follow the word tree along ``form``, undoing at most ``errors`` confusions; no further where p is below ``least``."""
        if at == len(form):
            hit = node.get("")
            if hit is not None and found.get(hit, -math.inf) < p:
                found[hit] = p
            return
        same = node.get(form[at])
        if same is not None:
            self._walk(same, form, at + 1, errors, p, found, least)
        if not errors:
            return
        for n in range(1, min(self.longest, len(form) - at) + 1):
            for true, q in self.back.get(form[at : at + n], ()):
                if p + q < least:
                    continue
                below = node
                for c in true:
                    below = below.get(c)
                    if below is None:
                        break
                else:
                    self._walk(below, form, at + n, errors - 1, p + q, found, least)


def _candidate_batches(batches: Iterator[pa.RecordBatch], listed, channel) -> Iterator[pa.RecordBatch]:
    words, _ = shared_list(listed.value)
    decoder, size = Decoder(words, channel.value), len(words.words) + 1
    for batch in batches:
        ids, texts, pairs = [], [], []
        for run, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            left, right, items, page, region = json.loads(text)
            options = [decoder.readings(core) for _, core in items]
            if not any(options):
                continue
            asked = set()
            before = [left]
            for option in options:
                now = [i for i, _ in option]
                asked |= {a * size + b for a in before if a >= 0 for b in (*now, size - 1)}
                before = now
            asked |= {a * size + b for a in before for b in (right, size - 1) if right >= 0}
            ids.append(run)
            pairs.append(sorted(asked))
            texts.append(json.dumps([left, right, [[w, core, o] for (w, core), o in zip(items, options, strict=True)], page, region], ensure_ascii=False))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(pairs, pa.list_(pa.int64()))], names=["run", "text", "pairs"])


def viterbi(left: int, right: int, items: list, counts: dict[int, int], words: WordList) -> list[int]:
    """The listed word behind every item of a run, or -1 where it stands as it is."""
    size = len(words.words) + 1
    weight = BIGRAMS

    def follows(a: int, b: int) -> float:
        if b < 0:
            return 0.0
        alone = math.exp(words.logp[b])
        total = counts.get(a * size + size - 1, 0) if a >= 0 else 0
        return math.log(weight * counts.get(a * size + b, 0) / total + (1 - weight) * alone) if total else words.logp[b]

    states = {left: (0.0, [])}
    for _, core, options in items:
        own = math.log(P_UNLISTED) + LETTER * len(core)
        choices = [(-1, own), *[(i, math.log(P_MISREAD) + p) for i, p in options]]
        states = {i: max(((score + p + follows(a, i), [*path, i]) for a, (score, path) in states.items()), key=lambda x: x[0]) for i, p in choices}
    return max(((score + follows(a, right), path) for a, (score, path) in states.items()), key=lambda x: x[0])[1]


def _decode_batches(batches: Iterator[pa.RecordBatch], listed) -> Iterator[pa.RecordBatch]:
    words, _ = shared_list(listed.value)
    for batch in batches:
        pages, regions, ids, corrected = [], [], [], []
        for text, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            left, right, items, page, region = json.loads(text)
            for (word_id, _, _), i in zip(items, viterbi(left, right, items, dict(counts or ()), words), strict=True):
                if i >= 0:
                    pages.append(page)
                    regions.append(region)
                    ids.append(word_id)
                    corrected.append(words.words[i])
        yield pa.RecordBatch.from_arrays([pa.array(pages, pa.string()), pa.array(regions, pa.int32()), pa.array(ids, pa.int64()), pa.array(corrected, pa.string())], names=["page_id", "region_ord", "word_id", "word"])


def misread_words(steps: DataFrame, listed) -> DataFrame:
    """``page_id, region_ord, word_id, word``: misread words and the listed word each was."""
    spark = steps.sparkSession
    channel = spark.sparkContext.broadcast(channel_table(steps, listed))
    runs = steps.where(F.col("kind") == RUN).select("a", "text")
    fn = partial(_candidate_batches, listed=listed, channel=channel)
    open_runs = written(runs.mapInArrow(fn, "run bigint, text string, pairs array<bigint>"), "runs")
    grams = steps.where(F.col("kind") == GRAM).groupBy(F.col("a").alias("pair")).agg(F.sum("b").alias("n"))
    asked = open_runs.select("run", F.explode("pairs").alias("pair")).join(grams, "pair")
    known = asked.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("pair", "n"))).alias("counts"))
    lattice = open_runs.select("run", "text").join(known, "run", "left").select("text", "counts")
    return lattice.mapInArrow(partial(_decode_batches, listed=listed), "page_id string, region_ord int, word_id bigint, word string")


FIX = "page_id string, region_ord int, word_id bigint, noise string, repaired string"


class Edges:
    """Step 4 for blocks of neighbouring pages."""

    def __init__(self, words: WordList, forms: Forms) -> None:
        self.words, self.forms = words, forms
        self.out: tuple[list, ...] = ([], [], [], [], [])

    def put(self, *row) -> None:
        for column, value in zip(self.out, row, strict=True):
            column.append(value)

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string())
        made = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(self.out, kinds, strict=True)], names=["page_id", "region_ord", "word_id", "noise", "repaired"])
        self.out = ([], [], [], [], [])
        return made

    def block(self, rows: list[tuple]) -> None:
        """``rows``: (page_id, book_id, number, whether the block is the page's own, edges)."""
        pages = [(i, book, seq, own, json.loads(text)) for i, book, seq, own, text in rows]
        around = Neighbours([(seq, book, page["lines"]) for _, book, seq, _, page in pages if seq is not None])
        by_number: dict[int, list[int]] = {}
        for k, page in enumerate(pages):
            if page[2] is not None:
                by_number.setdefault(page[2], []).append(k)
        dropped: dict[int, list[dict]] = {}

        def furniture(k: int) -> list[dict]:
            if k not in dropped:
                _, book, seq, _, page = pages[k]
                dropped[k] = furniture_lines(page["lines"], seq, book, around)
            return dropped[k]

        for k, (page_id, book, seq, own, page) in enumerate(pages):
            if not own:
                continue
            for line in furniture(k):
                for word_id in line["ids"]:
                    self.put(page_id, line["region"], word_id, "furniture", None)
            after = by_number.get(seq + 1, []) if seq is not None else []
            for n in after:
                next_id, next_book = pages[n][:2]
                if next_book is None or next_book == book:
                    tails, heads = _kept(page["tails"], furniture(k)), _kept(pages[n][4]["heads"], furniture(n))
                    made = _across(tails, heads, self.forms, self.words)
                    if made:
                        (_, a, left, region), (_, b, right, next_region) = made
                        self.put(page_id, region, a, "break", joined(left, right))
                        self.put(next_id, next_region, b, "break", None)


def _kept(places: list, dropped: list[dict]) -> list:
    gone = {x["k_no"] for x in dropped}
    return [p for p in places if p[0] not in gone]


def _edge_batches(batches: Iterator[pa.RecordBatch], listed) -> Iterator[pa.RecordBatch]:
    edges, held, key = Edges(*shared_list(listed.value)), [], None
    for batch in batches:
        for prefix, block, seq, own, page_id, book_id, text in zip(*[batch.column(i).to_pylist() for i in range(7)], strict=True):
            if (prefix, block) != key or block is None:
                edges.block(held)
                held, key = [], (prefix, block)
            held.append((page_id, book_id, seq, own, text))
        if edges.out[0]:
            yield edges.batch()
    edges.block(held)
    yield edges.batch()


def _across(tails: list, heads: list, forms: Forms, words: WordList) -> tuple | None:
    """The halves of a word divided between two pages: a listed word first, else the likeliest places."""
    likely = None
    for t in reversed(tails):
        for h in heads:
            if joins(forms(t[2]), forms(h[2]), words):
                if forms(t[2]).stem + forms(h[2]).core in words.ids:
                    return t, h
                likely = likely or (t, h)
    return likely


def page_edges(steps: DataFrame, listed) -> DataFrame:
    """``page_id, region_ord, word_id, noise, repaired`` of furniture and of words divided between pages.

    A page goes to its block of ``BLOCK_PAGES`` pages, and to the next one too where it is within ``HALO`` of it.
    """
    number = F.regexp_extract("page_id", r"(\d{1,15})$", 1)
    seq = F.when(number != "", number.cast("bigint"))
    pages = steps.where(F.col("kind") == PAGE).select("page_id", "book_id", "text", F.when(number != "", F.regexp_replace("page_id", r"\d{1,15}$", "")).alias("prefix"), seq.alias("seq"))
    home = F.floor(F.col("seq") / BLOCK_PAGES)
    blocks = F.array_distinct(F.array(home, F.floor((F.col("seq") - HALO) / BLOCK_PAGES), F.floor((F.col("seq") + HALO) / BLOCK_PAGES)))
    spread = F.when(F.col("seq").isNull(), F.col("page_id"))
    placed = pages.withColumn("home", home).select("prefix", F.explode(blocks).alias("block"), "seq", "home", "page_id", "book_id", "text", spread.alias("spread"))
    rows = placed.repartition("prefix", "block", "spread").sortWithinPartitions("prefix", "block", "seq", "page_id")
    own = F.coalesce(F.col("block") == F.col("home"), F.lit(True))
    return rows.select("prefix", "block", "seq", own.alias("own"), "page_id", "book_id", "text").mapInArrow(partial(_edge_batches, listed=listed), FIX)


def repairs(words: DataFrame, lexicon: DataFrame, limit: int = MAX_LISTED) -> DataFrame:
    """``word_id, noise, repaired`` of every word that repair changes (``repaired``) or drops (null).

    Furniture is only furniture, and the halves of a divided word are not misread on their own.
    """
    return placed_repairs(words, lexicon, limit).select("word_id", "noise", "repaired")


def placed_repairs(words: DataFrame, lexicon: DataFrame, limit: int = MAX_LISTED, max_held: int = MAX_HELD) -> DataFrame:
    """``page_id, region_ord, word_id, noise, repaired``: the repairs and where their words stand (-1: no region)."""
    spark = words.sparkSession
    rows = bounded_rows(lexicon.select("word", "n_seen").where("word is not null").distinct().orderBy("word", "n_seen"), limit, "the word list")
    listed = spark.sparkContext.broadcast([(r["word"], r["n_seen"]) for r in rows])
    steps = read_pages(words, listed, max_held)
    place = ("page_id", F.col("b").cast("int").alias("region_ord"), F.col("a").alias("word_id"))
    divided = steps.where(F.col("kind") == REPAIR).select(*place, F.lit("break").alias("noise"), F.col("text").alias("repaired"))
    misread = misread_words(steps, listed).select("page_id", "region_ord", "word_id", F.lit("misread").alias("noise"), F.col("word").alias("repaired"))
    every = page_edges(steps, listed).unionByName(divided).unionByName(misread)
    # Of one word: furniture before break before misread; a divided word that is misread too takes the corrected form.
    kinds = every.groupBy("word_id").agg(F.min(F.struct(_rank("noise").alias("rank"), "noise", "page_id", "region_ord", "repaired")).alias("r"), F.max(F.when(F.col("noise") == "misread", F.col("repaired"))).alias("word"))
    repaired = F.when((F.col("r.noise") == "break") & F.col("r.repaired").isNotNull() & F.col("word").isNotNull(), like_text(F.col("r.repaired"), F.col("word"))).otherwise(F.col("r.repaired"))
    return kinds.select("r.page_id", "r.region_ord", "word_id", "r.noise", repaired.alias("repaired"))


def _rank(noise: str):
    return F.when(F.col(noise) == "furniture", 0).when(F.col(noise) == "break", 1).otherwise(2)


def like_text(text, word):
    """``word`` with the marks at either end of ``text`` and its capitals."""
    lead, trail = F.regexp_extract(text, r"^([.,;:!?()]*)", 1), F.regexp_extract(text, r"([.,;:!?()]*)$", 1)
    core = F.substr(text, F.length(lead) + 1, F.greatest(F.length(text) - F.length(lead) - F.length(trail), F.lit(0)))
    first = F.substring(core, 1, 1)
    capital = F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2), F.length(word)))
    cased = F.when((F.length(core) > 1) & (core == F.upper(core)) & (core != F.lower(core)), F.upper(word)).when(first != F.lower(first), capital).otherwise(word)
    return F.concat(lead, cased, trail)


def repaired_paragraphs(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``page_id, region_ord, text``: every region as one paragraph of whole words, in order.

    Words and their repairs meet where they stand: one shuffle by region, in which a word's repair sorts right
    before it. Words without an id stand as they are; a word delivered twice stands once.
    """
    fixed = placed_repairs(words, lexicon)
    rows = require(words, "page_id", "region_ord", "line_ord", "word_ord", "word_id", "text")
    none = F.lit(None)
    shown = rows.select("page_id", "region_ord", F.struct("word_id", F.lit(True).alias("is_word"), "line_ord", "word_ord", "text", none.cast("string").alias("noise")).alias("w"))
    fix = F.struct("word_id", F.lit(False).alias("is_word"), none.cast("int").alias("line_ord"), none.cast("int").alias("word_ord"), F.col("repaired").alias("text"), "noise")
    fixes = fixed.select("page_id", F.when(F.col("region_ord") >= 0, F.col("region_ord")).alias("region_ord"), fix.alias("w"))
    together = shown.unionByName(fixes).groupBy("page_id", "region_ord").agg(F.array_sort(F.collect_set("w")).alias("w"))

    def repaired(x, i):
        before = F.when(i > 0, F.get(F.col("w"), i - 1))
        same = F.coalesce(before["word_id"] == x["word_id"], F.lit(False))
        fixed_text = F.when(before["noise"] == "misread", like_text(x["text"], before["text"])).otherwise(before["text"])
        text = F.when(same & ~before["is_word"], fixed_text).otherwise(x["text"])
        shown = F.when(x["is_word"] & ~(same & before["is_word"]), text)
        return F.struct(x["line_ord"].alias("line_ord"), x["word_ord"].alias("word_ord"), x["word_id"].alias("word_id"), shown.alias("shown"))

    kept = F.array_sort(F.filter(F.transform("w", repaired), lambda x: x["shown"].isNotNull()))
    return together.select("page_id", "region_ord", kept.alias("w")).where(F.size("w") > 0).select("page_id", "region_ord", F.array_join(F.transform("w", lambda x: x["shown"]), " ").alias("text"))
