"""Token counts of texts by a public byte-level BPE vocabulary.

The vocabulary file is a parameter (default: the installed ``public_tokenizers`` package's
``byte_bpe_50k.tiktoken``); it is read on each worker once and never trained or copied. A null text
has no tokens count (null), an empty one has 0. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
#: The published split pattern of this vocabulary family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(vocabulary: str):
    """The encoder of a vocabulary file: a path, or a file name of the installed package."""
    import tiktoken

    path = vocabulary
    if "/" not in vocabulary:
        import public_tokenizers

        path = public_tokenizers.path(vocabulary)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, vocabulary: str = VOCABULARY) -> int:
    return len(encoder(vocabulary).encode_ordinary(text))


def _count_batches(batches: Iterator[pa.RecordBatch], vocabulary: str, text_at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [None if t is None else count_tokens(t, vocabulary) for t in batch.column(text_at).to_pylist()]
        kept = [i for i in range(batch.num_columns) if i != text_at]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(counts, pa.int64())], names=[*[batch.schema.names[i] for i in kept], "n_tokens"])


def with_token_counts(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``; the texts themselves stay behind."""
    narrow = df.select(*[F.col(k) for k in keep], F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(partial(_count_batches, vocabulary=vocabulary, text_at=len(keep)), f"{schema}, n_tokens bigint")
