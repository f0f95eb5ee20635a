"""Text functions as column expressions (Python only where Unicode composition needs it)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINE_MARK, NBSP = "⸗", "\u00a0"
WORD = r"[\p{L}\p{N}_]+"
SPACE = r"[\s\p{Z}]+"

# Abbreviations of German texts whose dot ends no sentence.
ABBREVIATIONS = (
    "z.B.", "u.a.", "u.U.", "d.h.", "ggf.", "bzw.", "etc.", "sog.", "ca.", "Nr.", "Dr.", "Prof.", "bspw.", "vgl.", "Fig.", "Abb.", "Hr.", "Fr.", "evtl.", "bsp.", "i.d.R.",
    "Jan.", "Feb.", "Mrz.", "Apr.", "Mai.", "Jun.", "Jul.", "Aug.", "Sep.", "Okt.", "Nov.", "Dez.", "Jh.", "St.", "Abs.", "S.", "Tab.", "Bd.", "Hrsg.", "Kap.", "Lit.", "s.",
    "Anm.", "dgl.", "u.Ä.", "usw.", "z.T.", "z.Z.", "zzgl.",
)
# The line of a page number, with or without a dash on either side.
PAGE_NUMBER = r"^(?:[—\-]\s*)?\p{Nd}+(?:\s*[—\-])?$"
# Replacements of single historical characters.
CHARACTERS = {"ʒ": "z", "Ʒ": "Z", "ƕ": "hv", "ß": "ss", "ẞ": "SS", "ſ": "s", "ﬂ": "fl", "ﬁ": "fi", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "æ": "ae", "Æ": "Ae", "œ": "oe", "Œ": "Oe", "⸗": "-", "ꝰ": "-", "‟": "-"}
_HIDDEN_DOT, _ELLIPSIS, _CUT = "\ue001", "\ue000", "\ue002"


def squeeze(text: Column) -> Column:
    """Runs of blanks of any kind as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def words_of(text: Column) -> Column:
    return F.filter(F.split(squeeze(text), " "), lambda x: x != "")


def merge_marked(text: Column) -> Column:
    """Words divided by the double hyphen joined, line ends to blanks."""
    return F.regexp_replace(F.regexp_replace(text, f"{LINE_MARK}\n*", ""), "\n+", " ")


@F.pandas_udf(T.StringType())
def composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def historical(text: Column) -> Column:
    """Composed accents and modern letters for long s and z with tail."""
    nfc = F.when(text.rlike(r"[\p{M}\x{1100}-\x{11ff}]"), composed(text)).otherwise(text)
    return F.translate(nfc, "ſʒƷƶ", "szZz")


def join_hyphens(text: Column) -> Column:
    """Line-break hyphens before a small letter taken out, to the fixed point in one pass."""
    return F.regexp_replace(text, rf"(?<=[\p{{L}}\p{{N}}_])[-{LINE_MARK}]\s+(?=[a-zäöüß])", "")


def sentences(text: Column) -> Column:
    """Sentences by rule: an end mark, blanks and a letter; abbreviations with a second dot and ellipses stay whole."""
    core = "|".join(a.removesuffix(".").replace(".", "\\.") for a in ABBREVIATIONS)
    ready = join_hyphens(historical(text))
    ready = F.regexp_replace(ready, rf"(?i)(^|[^\p{{L}}\p{{N}}_])({core})\.(\s*[0-9]+(?:\.[0-9]+)*)?\.", f"$1$2{_HIDDEN_DOT}$3{_HIDDEN_DOT}")
    ready = F.replace(ready, F.lit("..."), F.lit(_ELLIPSIS))
    ready = F.regexp_replace(ready, r"([.!?][\"')\]”’»›]?)(\s+)([A-ZÄÖÜa-zäöüß])", f"$1{_CUT}$3")
    parts = F.transform(F.split(ready, _CUT), lambda s: F.trim(F.replace(F.replace(s, F.lit(_HIDDEN_DOT), F.lit(".")), F.lit(_ELLIPSIS), F.lit("..."))))
    return F.filter(parts, lambda s: s != "")


def normal_chunk(text: Column) -> Column:
    return F.translate(F.lower(text), "ſʒƶ-", "szz")


def normal_supervised(text: Column) -> Column:
    """Umlauts to base letters (ß stays), case and blanks evened out."""
    return F.trim(F.regexp_replace(F.lower(F.translate(text, f"äöüÄÖÜ{NBSP}", "aouAOU ")), SPACE, " "))


def normal_hybrid(text: Column) -> Column:
    return F.replace(normal_supervised(text), F.lit("ß"), F.lit("ss"))


def normal_gold(text: Column) -> Column:
    return squeeze(F.translate(text, f"⸗–—{NBSP}", "--- "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, "⸗-", "  "), F.lit(WORD), F.lit(0))


def is_page_number(text: Column) -> Column:
    return F.trim(text).rlike(PAGE_NUMBER)


def mapped_characters(text: Column, table: dict[str, str] | None = None) -> Column:
    """``struct<text, places>``: characters replaced, and for each new character the place it came from."""
    pairs = F.create_map(*[F.lit(x) for kv in (table or CHARACTERS).items() for x in kv])
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    new = F.transform(chars, lambda c: F.coalesce(F.try_element_at(pairs, c), c))
    places = F.flatten(F.transform(new, lambda c, i: F.array_repeat(i, F.length(c))))
    return F.struct(F.array_join(new, "").alias("text"), places.alias("places"))


def escaped(text: Column) -> Column:
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(name))
    return text


def coloured_span(word: Column, logp: Column) -> Column:
    return F.concat(F.lit('<span style="color:'), word_colour(logp), F.lit(';font-weight:bold;" title="logp='), F.format_string("%.2f", logp), F.lit('">'), escaped(word), F.lit("</span>"))


def word_colour(logp: Column) -> Column:
    """Colour of a word by its log probability."""
    return F.when(logp < -10, "darkred").when(logp < -5.5, "red").when(logp < -3.5, "orange").otherwise("lightgreen")


def token_colour(logp: Column) -> Column:
    return F.when(logp.isNull(), "white").when(logp < -5.5, "red").when(logp < -3.5, "yellow").otherwise("green")


def is_numeric(word: Column) -> Column:
    return word.rlike(r"^\p{N}+$")


def is_punctuation(word: Column) -> Column:
    return word.rlike(r"^[.,;:!?\-]*$")


def without_line_mark(word: Column) -> Column:
    return F.regexp_replace(word, f"{LINE_MARK}+$", "")


def file_stem(path: Column) -> Column:
    """File name without folder (either slash) and last suffix."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"\.[^.]*$", "")


def base_name(path: Column) -> Column:
    """File name up to its first dot."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"\..*$", "")


def readable_size(size: Column) -> Column:
    units = ("B", "KB", "MB", "GB", "TB")
    out = F.lit(None).cast("string")
    for k in range(len(units)):
        out = F.when(size >= 1024**k, F.concat(F.format_string("%.1f", size / float(1024**k)), F.lit(f" {units[k]}"))).otherwise(out)
    return F.coalesce(out, F.when(size.isNotNull(), F.lit("0 B")))


def fitted(values: Column, n: Column, fill: str = "unknown") -> Column:
    """An array cut or filled up to a length."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(fill), F.greatest(n - F.size(values), F.lit(0)).cast("int"))), 1, F.greatest(n, F.lit(0)))


def at_or_last(values: Column, i: Column) -> Column:
    """The element at a place from 0, the last one beyond the end, null of an empty array."""
    return F.when(F.size(values) > 0, F.element_at(values, F.least(i + 1, F.size(values)).cast("int")))
