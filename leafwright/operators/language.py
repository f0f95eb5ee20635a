"""A relational language model: unigrams with one added count.

Any other model plugs in as a DataFrame ``word, logp`` (or as an Arrow function from text to tokens
with log probabilities); everything downstream takes log probabilities as a column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a model up to which it is broadcast (some 50 bytes each), and words of a larger one that are.
MAX_WORDS, HOT_WORDS = 500_000, 10_000


def unigrams(tokens: DataFrame, word: str = "word") -> DataFrame:
    """``word, n, logp``: logp = ln((n + 1) / (N + V)) over lower-case words."""
    counts = tokens.where(F.col(word).isNotNull()).groupBy(F.lower(word).alias("word")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all_n"), F.count("*").alias("n_words"))
    return counts.crossJoin(F.broadcast(total)).select("word", "n", F.ln((F.col("n") + 1) / (F.col("all_n") + F.col("n_words"))).alias("logp"))


def with_logp(words: DataFrame, model: DataFrame, word: str = "word") -> DataFrame:
    """Words with their log probability.

    The model is broadcast while it has at most ``MAX_WORDS`` words. A larger one is joined by key, the commonest
    words of the model (at most ``HOT_WORDS``) by broadcast even then, so no word gathers in one task.
    """
    side = model.select(F.col("word").alias("_lw"), "logp")
    if side.limit(MAX_WORDS + 1).count() <= MAX_WORDS:
        return words.join(F.broadcast(side), F.lower(word) == F.col("_lw"), "left").drop("_lw")
    hot = F.broadcast(model.orderBy(F.desc("n")).limit(HOT_WORDS).select(F.col("word").alias("_hw"), F.col("logp").alias("_hot")))
    marked = words.join(hot, F.lower(word) == F.col("_hw"), "left").drop("_hw")
    known = marked.where("_hot is not null").withColumnRenamed("_hot", "logp")
    rest = marked.where("_hot is null").drop("_hot").join(side, F.lower(word) == F.col("_lw"), "left").drop("_lw")
    return known.unionByName(rest)


def page_logp(pages: DataFrame, keys: list[str], words: str, model: DataFrame) -> DataFrame:
    """``keys..., lp``: the log probabilities of a page's words, in order; words that the model lacks have null."""
    single = pages.select(*keys, F.posexplode(words).alias("pos", "word"))
    scored = with_logp(single, model).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "logp"))).alias("_s"))
    return scored.select(*keys, F.transform("_s", lambda x: x["logp"]).alias("lp"))


#: A token of a text: what it is, its first character and the one after its last, its log probability (none for the first).
Token = tuple[str, int, int, float | None]


class UnigramScorer:
    """A token scorer of the kind ``token_scores`` takes: words between blanks by a table of log probabilities.

    The first token of a text has nothing before it and no score; a blank text has no tokens.
    """

    def __init__(self, logp: dict[str, float], unknown: float = -20.0) -> None:
        self.logp, self.unknown = logp, unknown

    def __call__(self, texts: list[str]) -> list[list[Token]]:
        return [self._tokens(t) for t in texts]

    def _tokens(self, text: str) -> list[Token]:
        out, at = [], 0
        for word in text.split(" "):
            if word:
                out.append((word, at, at + len(word), self.logp.get(word.lower(), self.unknown) if out else None))
            at += len(word) + 1
        return out


def _token_batches(batches: Iterator[pa.RecordBatch], scorer: Callable[[list[str]], list[list[Token]]]) -> Iterator[pa.RecordBatch]:
    score = scorer.value if hasattr(scorer, "value") else scorer
    for batch in batches:
        rows, out = [], ([], [], [], [], [])
        for row, tokens in enumerate(score([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()])):
            for pos, token in enumerate(tokens):
                rows.append(row)
                for column, value in zip(out, (pos, *token), strict=True):
                    column.append(value)
        at, kinds = pa.array(rows, pa.int64()), (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64())
        keys = [batch.column(i).take(at) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*keys, *[pa.array(v, t) for v, t in zip(out, kinds, strict=True)]], names=[*batch.schema.names[:-1], "pos", "token", "start_char", "end_char", "logp"])


def token_scores(texts: DataFrame, keys: list[str], text: str, scorer) -> DataFrame:
    """``keys..., pos, token, start_char, end_char, logp``: any language model over texts, a batch of texts at a time.

    ``scorer`` maps a list of texts to the tokens of each (or is a broadcast of such a function).
    """
    narrow = texts.select(*keys, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(partial(_token_batches, scorer=scorer), f"{schema}, pos int, token string, start_char int, end_char int, logp double")
