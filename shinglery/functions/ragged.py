"""Ragged columns of Arrow batches as flat arrays, and flat arrays as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows, and bytes or values of them, that are worked on at once; a longer row is alone.
ROWS, STEP = 2048, 1 << 20


def ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a BINARY or list column one row after another, and where each row ends, from 0 on."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    ends = np.frombuffer(buffers[1], kind, column.offset + len(column) + 1)[column.offset :]
    if pa.types.is_list(column.type):
        values = column.values.to_numpy(zero_copy_only=False)
    else:
        values = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.empty(0, np.uint8)
    return values[ends[0] : ends[-1]], ends - ends[0]


def lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def wide(matrix: np.ndarray) -> pa.ListArray:
    """A row of the matrix as a list."""
    return lists(matrix.ravel(), np.arange(0, matrix.size + 1, matrix.shape[1]))


def blobs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of 32-bit words, one after another, as their little-endian bytes."""
    data = pa.py_buffer(np.ascontiguousarray(values, "<u4"))
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((4 * ends).astype(np.int32)), data])


def repeated(keys: pa.Array, sizes: np.ndarray) -> pa.Array:
    return keys.take(pa.array(np.repeat(np.arange(len(keys)), sizes)))


def map_ragged(df: DataFrame, key: str, made: Callable[[pa.Array, np.ndarray, np.ndarray], list[pa.Array]], columns: str) -> DataFrame:
    """Batches of `(key, <columns>)` that `made` builds of the keys, values and ends of a few rows of `(key, ragged)`; it
    gives the key's column too, so that it may repeat keys."""
    names = [key, *[c.split()[0] for c in columns.split(", ")]]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends = ragged(batch.column(1))
            lo = 0
            while lo < batch.num_rows:
                hi = min(lo + ROWS, batch.num_rows, max(lo + 1, int(np.searchsorted(ends, ends[lo] + STEP, side="right")) - 1))
                cols = made(batch.column(0).slice(lo, hi - lo), values[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo])
                yield pa.RecordBatch.from_arrays(cols, names)
                lo = hi

    return df.mapInArrow(mapped, f"`{key}` {dict(df.dtypes)[key]}, {columns}")
