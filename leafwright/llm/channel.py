"""The noisy channel of recognised words: plain forms, word list, candidates and their probabilities.

A recognised word is a listed word whose characters went through a channel that confuses one or two
characters with one or two others and adds stray signs. Which confusions the channel makes, and how
often, is counted over all pages (``confusion`` keys): a confusion that many different words show is
likely, one that a single name shows is not. Only the confusions known of blackletter print are given (``repair.KNOWN``),
each worth one observation, so that a small table of pages has a channel too.
"""

from __future__ import annotations

import math
import unicodedata
from collections import defaultdict

from leafwright.llm.looks import MARKS, letter_map, long_forms

#: Signs that divide a word at a line end, as printed or as recognised.
DIVIDERS = "-⸗‐‑¬=~"
#: Words before which a shortened compound keeps its hyphen.
JOINERS = frozenset(("und", "oder", "u", "od", "bzw", "sowie", "bis", "noch", "als", "wie", "auch"))


def _plain_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {ord(a): b for a, b in letter_map().items()}
    table |= {ord(a): b for a, b in long_forms().items()}
    for code in (*range(0x11000), *range(0xE0000, 0xE1000)):
        if unicodedata.category(chr(code)) in ("Cf", "Cc", "Zs", "Zl", "Zp"):
            table[code] = None
    table |= dict.fromkeys((0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x2800, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10)))
    return table


_TABLE: dict[int, str | None] = {}


def plain(text: str) -> str:
    """The spelling of ``looks.plain_sql``, for single words."""
    if text.isascii() and text.isalnum():
        return text
    if not _TABLE:
        _TABLE.update(_plain_table())
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).translate(_TABLE))


class WordList:
    """Listed words by lower-case form, their probabilities, and an index of all forms one edit away."""

    def __init__(self, rows: list[tuple[str, int | None]]) -> None:
        seen: dict[str, int] = {}
        for word, n in rows:
            low = word.lower()
            seen[low] = seen.get(low, 0) + (n or 0)
        self.words = list(seen)
        self.ids = {w: i for i, w in enumerate(self.words)}
        total = sum(seen.values()) + len(seen)
        self.logp = [math.log((n + 1) / max(1, total)) for n in seen.values()]
        self._holes: dict[str, list[tuple[int, str]]] = {}
        self._trie: dict = {}

    def holes(self) -> dict[str, list[tuple[int, str]]]:
        """Word with one or two neighbouring characters left out -> (id, what is left out)."""
        if not self._holes:
            found = defaultdict(list)
            for i, w in enumerate(self.words):
                for n in (1, 2):
                    for at in range(len(w) - n + 1):
                        found[f"{w[:at]}\0{w[at + n:]}"].append((i, w[at : at + n]))
            self._holes = dict(found)
        return self._holes

    def trie(self) -> dict:
        """The words as a tree of letters; the id of a word stands under the empty string."""
        if not self._trie:
            for i, w in enumerate(self.words):
                node = self._trie
                for c in w:
                    node = node.setdefault(c, {})
                node[""] = i
        return self._trie

    def one_edit(self, form: str) -> list[tuple[int, str, int]]:
        """(id, confusion ``true>seen``, place) of the listed words one confusion away from ``form``."""
        holes, out, best = self.holes(), [], {}
        for n in (1, 2):
            for at in range(len(form) - n + 1):
                seen = form[at : at + n]
                for i, true in holes.get(f"{form[:at]}\0{form[at + n:]}", ()):
                    if len(true) == n == 2 and (true[0] == seen[0] or true[1] == seen[1]):
                        continue
                    if len(true) != n and (true[0] == seen[0] or true[-1] == seen[-1]):
                        continue
                    key = (i, true, seen)
                    if key not in best:
                        best[key] = at
                        out.append((i, f"{true}>{seen}", at))
        return out

class Form:
    """What the repair needs to know of one spelling; a null text is a form of nothing."""

    __slots__ = ("alphabetic", "core", "divided", "dividers", "listed", "lower", "stem")

    def __init__(self, text: str | None, words: WordList) -> None:
        shown = plain(text or "")
        self.core = shown.strip(MARKS).lower()
        self.listed = words.ids.get(self.core, -1)
        self.lower = shown[:1].islower()
        self.alphabetic = self.listed < 0 and any(c.isalpha() for c in self.core)
        bare = shown.rstrip(DIVIDERS)
        self.divided = 0 < len(bare) < len(shown) and bare[-1].isalpha()
        self.dividers = shown[len(bare) :]
        #: What a second half would be joined to: nothing, if marks follow the word.
        self.stem = bare.lower().lstrip(MARKS) if bare[-1:].isalpha() else ""


class Forms:
    """Forms by spelling; forgets all when ``limit`` spellings are held, so memory stays bounded."""

    def __init__(self, words: WordList, limit: int = 200_000) -> None:
        self.words, self.limit, self.held = words, limit, {}

    def __call__(self, text: str | None) -> Form:
        got = self.held.get(text)
        if got is None:
            if len(self.held) >= self.limit:
                self.held.clear()
            got = self.held[text] = Form(text, self.words)
        return got


_lists: dict[int, tuple[WordList, Forms]] = {}


def shared_list(rows: list[tuple[str, int | None]]) -> tuple[WordList, Forms]:
    """One word list and form cache per worker process and word list."""
    key = hash(tuple(rows))
    if key not in _lists:
        _lists.clear()
        words = WordList(rows)
        _lists[key] = (words, Forms(words))
    return _lists[key]
