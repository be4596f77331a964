"""Problem 8: the whole corpus as token ids of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tabbyline.llm.bpe import DEFAULT_VOCABULARY, encoder
from tabbyline.session import ensure_shipped


def _lists(rows: list[list[int]]) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum(np.fromiter(map(len, rows), np.int32, len(rows)), out=offsets[1:])
    values = np.fromiter(chain.from_iterable(rows), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def encode_corpus(
    df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY
) -> DataFrame:
    """One row `(key, ids)` for each row of `df`, `ids` being the token ids of `text` without special tokens.

    A narrow operation: no shuffle, and only the two columns are read. Null and empty texts give an
    empty list; repeated rows give repeated results; a null key is kept; other columns, whatever their
    names, are not read. A batch is cut into slices of bounded text so that very long texts don't pile up.
    """
    ensure_shipped(df.sparkSession)
    key_type = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            for part in slices(batch, 1):
                ids = [encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(ids)], ["k", "ids"])

    schema = StructType([StructField("k", key_type), StructField("ids", ArrayType(IntegerType()))])
    return df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, schema).withColumnRenamed("k", key)


def count_corpus(
    df: DataFrame, columns: list[str], text: str, alias: str = "tokens", vocabulary: str = DEFAULT_VOCABULARY
) -> DataFrame:
    """The `columns` of `df` and the number of tokens of `text`, 0 for null and empty texts. Narrow."""
    ensure_shipped(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(vocabulary).count
        for batch in batches:
            counts = [count(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], schema.names)

    schema = StructType([*(df.schema[c] for c in columns), StructField(alias, LongType())])
    return df.select(*columns, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: int, limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of `batch` with at most about `limit` bytes in the string `column` each."""
    rows = batch.num_rows
    if rows < 2 or batch.column(column).nbytes <= limit:
        if rows:
            yield batch
        return
    yield from slices(batch.slice(0, rows // 2), column, limit)
    yield from slices(batch.slice(rows // 2), column, limit)
