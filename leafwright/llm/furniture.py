"""Page furniture: running headers and page numbers, told from the pages around a page.

A page number is a number alone on a line (or at either end of a running header) at the top or foot
of a page whose distance from the page's place in the book is the same on pages nearby. A
running header is a line at the top of a page that stands at the top of pages nearby too, give or
take a few misread letters. Nearby is within ``REACH`` pages of the same book, so a book of any
length, with any number of headers and numberings, is judged alike. The stated type of a region
counts only where it names furniture; the first page of a book carries its title as a heading, which
is none.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

#: Lines that count as the top or the foot of a page.
EDGE_LINES = 3
#: Pages on either side that tell a page's furniture; a header on a page this near needs no third page.
REACH, CLOSE = 16, 4
#: Pages on either side that furniture of the next page depends on: its neighbours, theirs, and itself.
HALO = 2 * REACH + 2
DECORATED = ("—9—", "-9-", "(9)", "S.9", "[9]", "–9–")
NUMBER_TYPES = ("page-number", "page_number", "pagenumber")
FIXED_TYPES = ("marginalia", "footnote", "heading")

_ROMAN = re.compile(r"^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")
_DECOR = re.compile(r"^([\(\[—–\-]*|s\.|seite|p\.|pag\.|bl\.)([0-9a-zäöü|]+)([\)\]—–\-]*|\.)$")
_DIGITS = str.maketrans("ilo|szbq", "11015269")


def roman_value(text: str) -> int | None:
    """The value of a lower-case Roman numeral, or None."""
    if not text or not _ROMAN.match(text):
        return None
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    total = 0
    for a, b in zip(text, [*text[1:], ""], strict=True):
        total += -values[a] if b and values[a] < values[b] else values[a]
    return total


def number_of(text: str) -> tuple[int, str] | None:
    """(value, style) of a line or word that is nothing but a page number, misread digits allowed."""
    squeezed = "".join(c for c in text.lower() if not c.isspace() and c not in "*~_\\·•^'")
    found = _DECOR.match(squeezed)
    if not found:
        return None
    before, body, after = found.groups()
    style = f"{before.upper() if before[:1] == 's' else before}9{after}"
    roman = roman_value(body)
    if roman is not None and body not in ("l", "d", "c", "m"):
        return roman, style
    if not any(c.isdigit() for c in body):
        return None
    digits = body.translate(_DIGITS)
    return (int(digits), style) if digits.isdigit() and len(digits) <= 5 else None


def letters_of(words: list[str]) -> str:
    """What a header is compared by: its letters, without marks, digits and case."""
    return "".join(c for w in words for c in w.lower() if c.isalpha())


def read_line(words: list[str]) -> dict:
    """Number, style and letter key of a line; a number at either end of a text counts as its page number."""
    whole = number_of(" ".join(words))
    if whole:
        return {"n": whole[0], "s": whole[1], "k": ""}
    if 2 <= len(words) <= 12:
        for at in (-1, 0):
            rest = words[:-1] if at else words[1:]
            end = number_of(words[at])
            if end and any(c.isdigit() for c in words[at]) and not any(number_of(w) for w in rest):
                return {"n": end[0], "s": "", "k": letters_of(rest)}
    return {"n": None, "s": "", "k": letters_of(words)}


def alike(a: str, b: str) -> bool:
    """Equal but for a misread letter in about every six."""
    if a == b:
        return True
    limit = max(1, max(len(a), len(b)) // 6)
    if not a or not b or abs(len(a) - len(b)) > limit:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0], low = row[0], i, i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
            low = min(low, row[j])
        if low > limit:
            return False
    return row[-1] <= limit


class Neighbours:
    """What stands at the edges of consecutive pages.

    ``pages`` are (number in the book, book, edge lines); all questions are about pages of the same
    book within ``REACH`` of the one asked for.
    """

    def __init__(self, pages: list[tuple[int, str | None, list[dict]]]) -> None:
        offsets, styles, keys = defaultdict(set), defaultdict(set), defaultdict(set)
        for seq, book, lines in pages:
            for line in lines:
                if line["n"] is not None:
                    offsets[book, line["n"] - seq].add(seq)
                    if line["s"]:
                        styles[book].add((seq, line["s"]))
                if line["top"] and line["k"] and line["single"] and (seq == 1 or line["type"] not in FIXED_TYPES):
                    keys[book].add((seq, line["k"]))
        self._offsets = {k: sorted(v) for k, v in offsets.items()}
        self._styles = {k: sorted(v) for k, v in styles.items()}
        self._keys = {k: sorted(v) for k, v in keys.items()}
        self._headed: dict[str | None, list[int]] = {}
        headed = defaultdict(set)
        for seq, book, lines in pages:
            if any(self.is_header(x, seq, book) for x in lines):
                headed[book].add(seq)
        self._headed = {k: sorted(v) for k, v in headed.items()}

    @staticmethod
    def _near(found: list, first, last) -> list:
        return found[bisect_left(found, first) : bisect_right(found, last)]

    def same_offset(self, offset: int, seq: int, book: str | None) -> bool:
        """Whether a page ``CLOSE`` by, or two pages nearby, have the same distance between number and place."""
        near = [s for s in self._near(self._offsets.get((book, offset), []), seq - REACH, seq + REACH) if s != seq]
        return len(near) > 1 or any(abs(s - seq) <= CLOSE for s in near)

    def style(self, seq: int, book: str | None) -> str | None:
        """How pages nearby dress their numbers, if two agree."""
        near = self._near(self._styles.get(book, []), (seq - REACH, ""), (seq + REACH, "\U0010ffff"))
        counts = Counter(style for _, style in near)
        best = max(counts, key=lambda x: (counts[x], x), default=None)
        return best if best is not None and counts[best] >= 2 else None

    def same_header(self, key: str, seq: int, book: str | None) -> bool:
        """Whether the line stands at the top of a page ``CLOSE`` by, or of two nearby, or is the title of the book."""
        near = self._near(self._keys.get(book, []), (seq - REACH, ""), (seq + REACH, "\U0010ffff"))
        others, known = set(), {}
        for s, other in near:
            if s == seq or s in others:
                continue
            if other not in known:
                known[other] = alike(key, other)
            if known[other]:
                if abs(s - seq) <= CLOSE or others or s == 1:
                    return True
                others.add(s)
        return False

    def has_headers(self, seq: int, book: str | None) -> bool:
        """Whether two other pages nearby have running headers."""
        near = self._near(self._headed.get(book, []), seq - REACH, seq + REACH)
        return sum(s != seq for s in near) >= 2

    def is_number(self, line: dict, seq: int | None, book: str | None) -> bool:
        if line["n"] is None:
            return False
        kind = line["type"]
        if kind in NUMBER_TYPES or (kind == "header" and not line["k"]):
            return True
        if seq is not None and kind not in ("footnote", "heading") and self.same_offset(line["n"] - seq, seq, book):
            return True
        if kind in FIXED_TYPES or line["k"] or line["s"] not in DECORATED:
            return False
        style = self.style(seq, book) if seq is not None else None
        return line["s"] == (style or line["s"])

    def is_header(self, line: dict, seq: int | None, book: str | None) -> bool:
        if not line["top"] or not line["k"] or line["type"] in FIXED_TYPES:
            return False
        if line["type"] == "header" and line["small"]:
            return True
        return line["single"] and seq is not None and self.same_header(line["k"], seq, book)


def furniture_lines(lines: list[dict], seq: int | None, book: str | None, around: Neighbours) -> list[dict]:
    """Which of a page's edge lines are furniture."""
    numbers = [x for x in lines if around.is_number(x, seq, book)]
    if seq == 1:
        return [x for x in numbers if not x["k"]]
    found = [x for x in lines if x in numbers or around.is_header(x, seq, book)]
    if seq is not None and not any(x["k"] for x in found) and around.has_headers(seq, book):
        # Pages around have running headers, but this page's stands there once only: a lone short first line.
        tops = [x for x in lines if x["top"] and x["k"] and x["alone"] and x["type"] not in FIXED_TYPES]
        if tops and tops[0] not in found and not tops[0]["long"]:
            found.append(tops[0])
    return found
