"""One consistent spelling for text that looks the same but has other characters.

DuckDB runs inside the Arrow partitions. Its SQL removes invisible characters and blanks of any kind,
maps compatibility forms (full-width, styled and Roman-numeral letters), ligatures, old letters and
look-alikes of other scripts to plain letters and composes accents (``nfc_normalize``). Case is left
as it is, except where ``fold`` is asked for. Blanks of any kind vanish from single words; in running
text (``blank`` given) a run of them becomes one blank, or one line end where it holds one.
Texts of plain letters only are their own spelling and never leave the JVM.

Null stays null; a text of invisible characters only becomes empty; look-alikes are mapped wherever
they stand, so words of another script come out mixed (nothing but comparison uses this form).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that look like a Latin letter.
GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX αa βß εe ιi κk νv οo ρp τt υu χx γy ωw ϲc ϳj"
CYRILLIC = "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS ԌG ԚQ ԜW Үү аa еe оo рp сc уy хx іi јj ѕs һh ԁd ԛq ԝw кk тt ѵv ԍg ӏl ԏt"
LATIN = "ſs ʒz ɡg ɑa ıi ƶz Ʒ3 ℓl ẞß"
ARMENIAN = "օo սu հh ոn ցg ՏS ՕO"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: Ranges whose compatibility forms of one character are mapped by rule.
COMPATIBLE = ((0x00AA, 0x00BA), (0x1D400, 0x1D7FF), (0x2100, 0x217F), (0x2460, 0x24FF), (0xFF01, 0xFF5E))
#: Characters of plain texts: these are their own consistent spelling, so long as no blanks follow one another.
PLAIN = "A-Za-zÄÖÜäöüß0-9.,;:!?()'\"/&%*+=_-"
#: Blanks of every kind, and the line ends among the control characters.
BLANKS, LINE_ENDS = r"\p{Z}\t\n\x0B\f\r\x{0085}", r"\n\x0B\f\r\x{0085}\x{2028}\x{2029}"
#: Format and control characters, blanks of every kind, joiners, fillers and variation selectors.
INVISIBLE = r"[\p{Cf}\p{Cc}\p{Z}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}]+"
MARKS = ".,;:!?()"


@lru_cache(maxsize=1)
def letter_map() -> dict[str, str]:
    """Every mapped character and what it looks like, one character each."""
    pairs = {p[0]: p[1] for block in (GREEK, CYRILLIC, LATIN, ARMENIAN) for p in block.split() if len(p) == 2 and p[1].isascii() or p[1:] == "ß"}
    pairs["Ʒ"] = "Z"
    for first, last in COMPATIBLE:
        for code in range(first, last + 1):
            plain = unicodedata.normalize("NFKC", chr(code))
            if len(plain) == 1 and plain != chr(code) and unicodedata.category(chr(code)) != "Cn":
                pairs.setdefault(chr(code), pairs.get(plain, plain))
    return pairs


@lru_cache(maxsize=1)
def long_forms() -> dict[str, str]:
    """Ligatures and the compatibility forms that look like several characters (Roman numerals, numbers in brackets)."""
    pairs = dict(LIGATURES)
    for first, last in COMPATIBLE:
        for code in range(first, last + 1):
            plain = unicodedata.normalize("NFKC", chr(code))
            if len(plain) > 1 and plain.isprintable() and not plain.startswith(" "):
                pairs.setdefault(chr(code), "".join(letter_map().get(c, c) for c in plain))
    return pairs


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _class(characters) -> str:
    """A character class of single characters, runs of them as ranges."""
    runs: list[list[int]] = []
    for code in sorted(map(ord, characters)):
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]"


def plain_sql(column: str, blank: bool = False) -> str:
    """The SQL expression of the consistent spelling of a text column; ``blank`` keeps running text apart.

    The tables are asked only for the texts that hold one of their characters.
    """
    pairs, forms = letter_map(), long_forms()
    sql = column
    if blank:
        sql = f"regexp_replace({sql}, '[{BLANKS}]*[{LINE_ENDS}][{BLANKS}]*', chr(10), 'g')"
        sql = f"regexp_replace({sql}, '[\\p{{Z}}\\t]+', ' ', 'g')"
        hidden = INVISIBLE.replace("\\p{Cc}\\p{Z}", "\\x{00}-\\x{09}\\x{0B}-\\x{1F}\\x{7F}-\\x{9F}")
        sql = f"regexp_replace({sql}, {_quoted(hidden)}, '', 'g')"
    else:
        sql = f"regexp_replace({sql}, {_quoted(INVISIBLE)}, '', 'g')"
    sql = f"nfc_normalize({sql})"
    replaced = "x"
    for form, letters in forms.items():
        replaced = f"replace({replaced}, {_quoted(form)}, {_quoted(letters)})"
    letter = f"CASE WHEN regexp_matches(y, {_quoted(_class(pairs))}) THEN translate(y, {_quoted(''.join(pairs))}, {_quoted(''.join(pairs.values()))}) ELSE y END"
    long = f"CASE WHEN regexp_matches(x, {_quoted(_class(forms))}) THEN {replaced} ELSE x END"
    return f"list_transform([list_transform([{sql}], lambda x: {long})[1]], lambda y: nfc_normalize({letter}))[1]"


def core_sql(column: str) -> str:
    """Without marks at either end, in lower case."""
    return f"lower(trim({column}, {_quoted(MARKS)}))"


def _plain_batches(batches: Iterator[pa.RecordBatch], text_at: int, fold: bool, blank: bool) -> Iterator[pa.RecordBatch]:
    import duckdb

    con = duckdb.connect(config={"threads": 1})
    for batch in batches:
        texts = pa.table({"t": batch.column(text_at).cast(pa.string())})  # noqa: F841 (read by the SQL)
        plain = plain_sql("t", blank)
        query = f"SELECT {core_sql(plain)} AS a, {core_sql('t')} AS b FROM texts" if fold else f"SELECT {plain} AS a, t AS b FROM texts"
        got = con.sql(query).to_arrow_table().combine_chunks()
        columns = [_flat(got.column(i)) for i in (0, 1)]
        kept = [i for i in range(batch.num_columns) if i != text_at]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *columns], names=[*[batch.schema.names[i] for i in kept], "plain", "raw"])
    con.close()


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())


def is_plain(text, blank: bool = False):
    """Column: whether a text consists of plain letters only, and so is its own consistent spelling."""
    letters = rf"[{PLAIN}]*(?:[ \n][{PLAIN}]+)*[ \n]?" if blank else rf"[{PLAIN}]*"
    return F.coalesce(text.rlike(rf"\A(?:{letters})\z"), F.lit(True))


def with_plain_text(df: DataFrame, text: str = "text", keep: tuple[str, ...] = (), fold: bool = False, blank: bool = False) -> DataFrame:
    """The columns ``keep``, ``plain`` (the consistent spelling) and ``raw``.

    With ``fold`` both lose marks at either end and case, as comparisons with a word list need. With ``blank`` the
    texts are running text, not single words.
    """
    narrow = df.select(*[F.col(k) for k in keep], F.col(text).alias("_text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in narrow.schema.fields[:-1])
    fn = partial(_plain_batches, text_at=len(keep), fold=fold, blank=blank)
    if fold:
        return narrow.mapInArrow(fn, f"{schema}plain string, raw string")
    asis = is_plain(F.col("_text"), blank)
    odd = narrow.where(~asis).mapInArrow(fn, f"{schema}plain string, raw string")
    return odd.unionByName(narrow.where(asis).select(*[F.col(k) for k in keep], F.col("_text").alias("plain"), F.col("_text").alias("raw")))


def lookalikes(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``word_id, lex_id`` of the words that look like a word of the lexicon but have other characters.

    Words made only of the plain letters and marks equal their own consistent spelling, so they cannot
    be cases and stay in the JVM. The join with the lexicon is Spark's: broadcast below its threshold,
    else a shuffle of the few words left.
    """
    odd = words.where(F.col("text").rlike(r"[^A-Za-zÄÖÜäöüß.,;:!?()]") & F.col("word_id").isNotNull())
    spelled = with_plain_text(odd, "text", ("word_id",), fold=True).where("plain <> raw and plain <> ''")
    listed = lexicon.where("word is not null and lex_id is not null").select("lex_id", F.lower("word").alias("plain"))
    return spelled.join(listed, "plain").select("word_id", "lex_id").distinct()
