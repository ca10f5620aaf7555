"""Encoding whole tables of text with a public byte-level tokenizer (problem 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.bpe import encoder

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed public vocabularies are; pass another path where they are not."""
    try:
        import public_tokenizers

        return str(public_tokenizers.path(name))
    except ImportError:
        return f"/opt/tokenizers/{name}"


def packed_ids(batch: pa.RecordBatch, column: str, path: str) -> list[bytes]:
    return encoder(path).encode_batch(batch.column(column).to_pylist())


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key, ids``: one row for every input row, repeated rows included.

    Empty and null texts give an empty list; special tokens are ordinary text. A text is read whole, whatever its
    length. No shuffle: each task encodes its part of the scan, and a worker keeps its trie for its later tasks.
    """
    path = path or vocabulary_path()
    kind = df.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = packed_ids(batch, "_text", path)
            ends = np.cumsum([0, *map(len, packed)]) // 4
            values = pa.array(np.frombuffer(b"".join(packed), "<i4"))
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([batch.column("_key"), ids], ["_key", "ids"])

    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(encode, f"_key {kind}, ids array<int>").withColumnRenamed("_key", key)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key, n_tokens``: as :func:`encode_texts`, with the number of ids instead of the ids."""
    path = path or vocabulary_path()
    kind = df.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array([len(x) // 4 for x in packed_ids(batch, "_text", path)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_key"), sizes], ["_key", "n_tokens"])

    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(count, f"_key {kind}, n_tokens long").withColumnRenamed("_key", key)
