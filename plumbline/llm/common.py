"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text a task works on at a time; longer documents are worked on alone.
SLICE_BYTES = 4 << 20


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` with only the columns named by the values, renamed to the keys."""
    return df.select(*[F.col(f"`{c}`").alias(k) for k, c in columns.items()])


def text_bytes(column: pa.Array) -> pa.Array:
    """The texts as binary, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).fill_null(b"")


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows with up to ``limit`` bytes, or of one row."""
    ends = np.asarray(offsets(texts))[1:]
    first, n = 0, len(texts)
    base = int(ends[0]) - len(texts[0].as_py()) if n else 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield first, end
        base, first = int(ends[end - 1]), end


def offsets(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset:]


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins and the last ends."""
    at = offsets(texts)
    data = texts.buffers()[2]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def hex64(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def table(spark, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
