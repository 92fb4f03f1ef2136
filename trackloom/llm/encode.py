"""Encoding of whole corpora with a rank-file vocabulary."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.bytepairs import load

#: Place of the vocabulary; a parameter of every operator here.
VOCABULARY = os.environ.get("TRACKLOOM_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
#: Characters that are encoded together.
BATCH_CHARS = 4_000_000


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Consecutive slices of about BATCH_CHARS; a longer text is one of its own."""
    a = chars = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > a and chars + n > BATCH_CHARS:
            yield a, i
            a, chars = i, 0
        chars += n
    if a < len(texts):
        yield a, len(texts)


def _rank_file(df: DataFrame, vocabulary: str):
    with open(vocabulary, "rb") as f:  # under a megabyte, whatever the corpus
        return df.sparkSession.sparkContext.broadcast(f.read())


def token_ids(docs: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array<int>) of every row, without special tokens.

    Null and empty texts give an empty list.  Whole texts are encoded; long ones
    in parts that no merge could cross.  Texts repeat their pieces, so each
    worker keeps a table of pieces: a new piece is covered greedily with the
    longest tokens, all borders between its tokens are verified at once against
    the order of merges, and only pieces with a border that merging wouldn't
    leave alone are merged exactly.  Strings of special tokens are ordinary text.
    Repeated keys keep their rows; other columns are ignored; an empty table
    gives none.
    """
    ranks = _rank_file(docs, vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = load(ranks.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in _slices(texts):
                at, ids = pairs.encode(texts[i:j])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], names=[key, "ids"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(encode, f"`{key}` {kind}, ids array<int>")


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with n_tokens (bigint); null and empty texts count 0."""
    ranks = _rank_file(docs, vocabulary)
    kept = [c for c in docs.columns if c != text]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = load(ranks.value)
        for b in batches:
            n = pairs.counts(b.column(len(kept)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(n, pa.int64())], names=[*kept, "n_tokens"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*kept).dtypes) + ", n_tokens bigint"
    return docs.select(*kept, F.col(text)).mapInArrow(count, schema)
