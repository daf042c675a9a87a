"""Token ids and token counts of whole corpora."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.bpe import encoder

BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.json"


def _vocabulary(df: DataFrame, path: str):
    """The vocabulary's bytes, whose size doesn't depend on the data, for every executor."""
    return df.sparkSession.sparkContext.broadcast(Path(path).read_bytes())


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """(key, ids): one row for each row of `df`, without special tokens.

    Null and empty texts give an empty list; a null key stays null; other columns are ignored.
    """
    shared = _vocabulary(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = encoder(shared.value).packed
        for batch in batches:
            rows = [packed(t) if t else b"" for t in batch.column(1).to_pylist()]
            ends = np.zeros(len(rows) + 1, dtype=np.int32)
            np.cumsum([len(r) // 4 for r in rows], out=ends[1:])
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), "ids")


def count_tokens(df: DataFrame, columns: list[str], text: str = "text", vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """`columns` of each row and ``tokens``, the number of ids of its text (0 for null and empty)."""
    shared = _vocabulary(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = encoder(shared.value).packed
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            sizes = pa.array([len(packed(t)) // 4 if t else 0 for t in texts], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes], names=[*columns, "tokens"])

    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    return df.select(*columns, F.col(text).alias("__text")).mapInArrow(run, f"{types}, tokens bigint")
