"""Steps the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from harborlane import session

ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which also cuts its lineage."""
    spark = df.sparkSession
    path = session.fresh_dir(spark, f"llm-{label}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents no model learns from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def pieces(batch: pa.RecordBatch, column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``size`` bytes of text, at least one row each."""
    lengths = np.array(
        [0 if n is None else n for n in pa.compute.binary_length(batch[column]).to_pylist()],
        dtype=np.int64,
    )
    begin = total = 0
    for row, length in enumerate(lengths):
        if row > begin and total + length > size:
            yield batch.slice(begin, row - begin)
            begin, total = row, 0
        total += int(length)
    if begin < len(lengths):
        yield batch.slice(begin, len(lengths) - begin)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row begins in them (one entry more than rows).

    A null is empty.
    """
    column = column.cast(pa.large_binary()).fill_null(b"")
    rows = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=rows + 1 + column.offset)
    offsets = offsets[column.offset :]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
