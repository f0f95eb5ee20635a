"""Text functions over the lines of all documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright import corpus
from leafwright.functions import similarity
from leafwright.functions import text as tx
from leafwright.operators import chunks
from leafwright.storage import table, written

SPACE_SQL = r"'[\s\p{Z}]+'"
D = corpus.DOC_LINES_SQL


def _over_lines(column):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return corpus.document_lines(spark, sf_dir).select("doc_id", "line_no", column(F.col("line")).alias("result"))

    return query


def _flags(line):
    word = tx.words_of(line)
    count = lambda test: F.size(F.filter(word, test))
    return F.struct(count(tx.is_numeric).alias("numeric"), count(tx.is_punctuation).alias("punctuation"), count(lambda w: F.endswith(w, F.lit("⸗"))).alias("marked"), F.contains(F.lower(line), F.lit("stadt")).alias("found"))


def word_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric, punctuation-only and divided words of a line, and a search that ignores case."""
    return corpus.document_lines(spark, sf_dir).select("doc_id", "line_no", _flags(F.col("line")).alias("f")).select("doc_id", "line_no", "f.*")


def char_map_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = corpus.document_lines(spark, sf_dir).select("doc_id", "line_no", tx.mapped_characters(F.col("line")).alias("m"))
    return mapped.select("doc_id", "line_no", F.col("m.text").alias("result"), F.size("m.places").alias("n_places"), F.aggregate("m.places", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("sum_places"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("sentence_no", "sentence"))


def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two sentences with one in common."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", tx.sentences(F.col("text")).alias("s"))
    return chunks.word_chunks(docs, ["doc_id"], "s", 2, 1).select("doc_id", "chunk_id", "start_word_id", "end_word_id", F.array_join("words", " ").alias("chunk"))


def html_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coloured spans of scored words; the log probability is that of the stated perplexity."""
    words = corpus.scored_words(spark, sf_dir).where("word is not null and ppl > 0")
    logp = F.round(-F.ln("ppl"), 6)
    return words.select("page_id", "pos", tx.word_colour(logp).alias("colour"), tx.token_colour(logp).alias("token_colour"), tx.escaped(F.col("word")).alias("escaped"))


def file_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "html_files").select("file_id", "xml_path", "size_bytes", "modified_at").dropDuplicates(["file_id"])
    path = F.col("xml_path")
    return files.select("file_id", tx.file_stem(path).alias("stem"), tx.base_name(path).alias("base"), F.date_format("modified_at", "yyyy-MM-dd").alias("day"), tx.readable_size(F.col("size_bytes")).alias("size"))


def levenshtein_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divided words joined with the next word, against the joined form of the lexicon, within a third of its letters."""
    words = corpus.words(spark, sf_dir).where(F.col("text").isNotNull())
    ends = words.where(F.endswith("text", F.lit("⸗"))).select("page_id", "region_ord", (F.col("line_ord") + 1).alias("line_ord"), F.col("word_id").alias("left_id"), tx.without_line_mark(F.col("text")).alias("l"))
    starts = words.where("word_ord = 0").select("page_id", "region_ord", "line_ord", F.col("word_id").alias("right_id"), F.replace("text", F.lit("⸗"), F.lit("")).alias("r"))
    both = ends.join(starts, ["page_id", "region_ord", "line_ord"]).withColumn("combined", tx.normal_chunk(F.concat("l", "r")))
    both = written(both.select("left_id", "right_id", F.col("combined").alias("form")), "divided")
    listed = table(spark, sf_dir, "lexicon").groupBy(F.lower("word").alias("listed")).agg(F.count("*").alias("n"))
    near = similarity.near_pairs(both.select("form").distinct(), listed.select("listed")).join(listed, "listed")
    near = near.groupBy("form").agg(F.sum("n").alias("n"), F.min("edits").alias("least"))
    return both.join(near, "form").groupBy("left_id", "right_id").agg(F.sum("n").alias("n_near"), F.min("least").alias("edits"))


def phrase_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in a line at which its own first two words stand again."""
    lines = corpus.document_lines(spark, sf_dir).select("doc_id", "line_no", tx.words_of(F.col("line")).alias("w")).where(F.size("w") >= 2)
    return lines.select("doc_id", "line_no", F.size(similarity.phrase_places(F.col("w"), F.slice("w", 1, 2))).alias("n_places"))


SIMPLE = {
    "normalize_supervised": tx.normal_supervised, "normalize_hybrid": tx.normal_hybrid, "normalize_gold": tx.normal_gold, "normalize_chunk": tx.normal_chunk,
    "tokenize_lines": lambda c: F.array_join(tx.tokens(c), "|"), "split_words": lambda c: F.array_join(tx.words_of(c), "|"), "historical_chars": tx.historical, "page_number_lines": tx.is_page_number, "escape_html": tx.escaped,
}


def _over_docs(column):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", column(F.col("text")).alias("result"))

    return query


def queries() -> dict:
    out = {k: _over_lines(f) for k, f in SIMPLE.items()}
    out |= {"merge_split_words": _over_docs(tx.merge_marked), "hyphen_repair": _over_docs(tx.join_hyphens)}
    return out | {f.__name__: f for f in (word_flags, char_map_expand, sentence_split, sentence_chunks, html_spans, file_stems, levenshtein_join, phrase_places)}


def _line_sql(expr: str) -> str:
    return f"WITH {D} SELECT doc_id, line_no, {expr} AS result FROM d"


def _squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, {SPACE_SQL}, ' ', 'g'), ' ')"


SUPERVISED = _squeezed("lower(translate(line, 'äöüÄÖÜ' || chr(160), 'aouAOU '))")
PARTS = f"list_filter(string_split({_squeezed('line')}, ' '), lambda x: x <> '')"
ABBR = "|".join(a.removesuffix(".").replace(".", "\\.") for a in tx.ABBREVIATIONS)


def _hyphens(x: str) -> str:
    for _ in range(5):
        x = rf"regexp_replace({x}, '([\p{{L}}\p{{N}}_])[-⸗]\s+([a-zäöüß])', '\1\2', 'g')"
    return x


HISTORIC = "translate(nfc_normalize({}), 'ſʒƷƶ', 'szZz')"
MARKED = _hyphens(HISTORIC.format("text"))
MARKED = rf"replace(regexp_replace({MARKED}, '(?i)(^|[^\p{{L}}\p{{N}}_])({ABBR})\.(\s*[0-9]+(?:\.[0-9]+)*)?\.', '\1\2' || chr(57344) || '\3' || chr(57344), 'g'), '...', chr(57345))"
MARKED = rf"""regexp_replace({MARKED}, '([.!?]["'')\]”’»›]?)(\s+)([A-ZÄÖÜa-zäöüß])', '\1' || chr(57346) || '\3', 'g')"""
SENTENCES = f"list_filter(list_transform(string_split({MARKED}, chr(57346)), lambda s: trim(replace(replace(s, chr(57344), '.'), chr(57345), '...'), ' ')), lambda s: s <> '')"
MAPPING = ", ".join(f"'{a}': '{b}'" for a, b in tx.CHARACTERS.items())


def _escaped(x: str) -> str:
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{plain}', '{name}')"
    return x


def oracle_sql() -> dict[str, str]:
    esc, word_esc = _escaped("line"), _escaped("word")
    name = r"regexp_replace(xml_path, '^.*[/\\]', '')"
    size = "CASE " + " ".join(f"WHEN size_bytes >= {1024**k} THEN printf('%.1f', size_bytes / {1024**k}::DOUBLE) || ' {u}'" for k, u in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB"))))) + " WHEN size_bytes IS NOT NULL THEN '0 B' END"
    return {
        "normalize_supervised": _line_sql(SUPERVISED),
        "normalize_hybrid": _line_sql(f"replace({SUPERVISED}, 'ß', 'ss')"),
        "normalize_gold": _line_sql(_squeezed("translate(line, '⸗–—' || chr(160), '--- ')")),
        "normalize_chunk": _line_sql("replace(translate(lower(line), 'ſʒƶ', 'szz'), '-', '')"),
        "tokenize_lines": _line_sql(r"array_to_string(regexp_extract_all(translate(line, '⸗-', '  '), '[\p{L}\p{N}_]+'), '|')"),
        "split_words": _line_sql(f"array_to_string({PARTS}, '|')"),
        "historical_chars": _line_sql(HISTORIC.format("line")),
        "page_number_lines": _line_sql(r"regexp_matches(trim(line, ' '), '^(?:[—\-]\s*)?\p{Nd}+(?:\s*[—\-])?$')"),
        "escape_html": _line_sql(esc),
        "merge_split_words": "SELECT doc_id, regexp_replace(regexp_replace(text, '⸗\\n*', '', 'g'), '\\n+', ' ', 'g') AS result FROM documents WHERE text IS NOT NULL",
        "hyphen_repair": f"SELECT doc_id, {_hyphens('text')} AS result FROM documents WHERE text IS NOT NULL",
        "word_flags": rf"""WITH {D}, v AS (SELECT doc_id, line_no, line, {PARTS} AS w FROM d)
            SELECT doc_id, line_no, len(list_filter(w, lambda x: regexp_full_match(x, '\p{{N}}+')))::INTEGER AS numeric, len(list_filter(w, lambda x: regexp_full_match(x, '[.,;:!?\-]*')))::INTEGER AS punctuation,
            len(list_filter(w, lambda x: ends_with(x, '⸗')))::INTEGER AS marked, contains(lower(line), 'stadt') AS found FROM v""",
        "char_map_expand": f"""WITH {D}, v AS (SELECT doc_id, line_no, list_transform(list_filter(string_split(line, ''), lambda c: c <> ''), lambda c: coalesce(MAP {{{MAPPING}}}[c], c)) AS n FROM d)
            SELECT doc_id, line_no, array_to_string(n, '') AS result, coalesce(list_sum(list_transform(n, lambda c: length(c))), 0)::INTEGER AS n_places,
            coalesce(list_sum(list_transform(n, lambda c, i: length(c) * (i - 1))), 0)::BIGINT AS sum_places FROM v""",
        "sentence_split": f"WITH v AS (SELECT doc_id, {SENTENCES} AS s FROM documents WHERE text IS NOT NULL), i AS (SELECT *, unnest(range(len(s))) AS k FROM v) SELECT doc_id, k::INTEGER AS sentence_no, s[k + 1] AS sentence FROM i",
        "sentence_chunks": f"""WITH v AS (SELECT doc_id, {SENTENCES} AS s FROM documents WHERE text IS NOT NULL),
            i AS (SELECT *, unnest(range(CASE WHEN len(s) = 0 THEN 0 WHEN len(s) <= 2 THEN 1 ELSE len(s) - 1 END)) AS k FROM v)
            SELECT doc_id, k::INTEGER AS chunk_id, k::INTEGER AS start_word_id, (least(k + 2, len(s)) - 1)::INTEGER AS end_word_id, array_to_string(s[k + 1 : k + 2], ' ') AS chunk FROM i""",
        "html_spans": f"""WITH {corpus.PPL_SQL}, v AS (SELECT page_id, pos, word, round(-ln(ppl), 6) AS lp FROM p WHERE word IS NOT NULL AND ppl > 0)
            SELECT page_id, pos, CASE WHEN lp < -10 THEN 'darkred' WHEN lp < -5.5 THEN 'red' WHEN lp < -3.5 THEN 'orange' ELSE 'lightgreen' END AS colour,
            CASE WHEN lp < -5.5 THEN 'red' WHEN lp < -3.5 THEN 'yellow' ELSE 'green' END AS token_colour, {word_esc} AS escaped FROM v""",
        "file_stems": rf"""SELECT file_id, regexp_replace({name}, '\.[^.]*$', '') AS stem, regexp_replace({name}, '\..*$', '') AS base, strftime(modified_at, '%Y-%m-%d') AS day, {size} AS size
            FROM (SELECT DISTINCT file_id, xml_path, size_bytes, modified_at FROM html_files)""",
        "levenshtein_join": f"""WITH {corpus.WORDS_SQL}, e AS (SELECT page_id, region_ord, line_ord + 1 AS line_ord, word_id AS left_id, regexp_replace(text, '⸗+$', '') AS l FROM w WHERE ends_with(text, '⸗')),
            b AS (SELECT left_id, word_id AS right_id, replace(translate(lower(l || replace(text, '⸗', '')), 'ſʒƶ', 'szz'), '-', '') AS c FROM e JOIN w USING (page_id, region_ord, line_ord) WHERE word_ord = 0 AND text IS NOT NULL),
            n AS (SELECT left_id, right_id, length(lower(word)) AS n, levenshtein(translate(c, 'äöüß', '1234'), translate(lower(word), 'äöüß', '1234')) AS x FROM b JOIN lexicon ON true)
            SELECT left_id, right_id, count(*) AS n_near, min(x)::INTEGER AS edits FROM n WHERE x <= greatest(1, floor(0.3::DOUBLE * n)::INTEGER) GROUP BY 1, 2""",
        "phrase_places": f"""WITH {D}, v AS (SELECT doc_id, line_no, {PARTS} AS w FROM d)
            SELECT doc_id, line_no, len(list_filter(range(1, len(w)), lambda i: w[i] = w[1] AND w[i + 1] = w[2]))::INTEGER AS n_places FROM v WHERE len(w) >= 2""",
    }
