"""Corpora in the packed layout: all texts back to back in a buffer, and where each ends.

A folder holds parts. `<part>.buffer` has the texts without separators, `<part>.ends` the exclusive, cumulative end of
each as an unsigned little-endian 64-bit number, `<part>.keys` the ids as signed ones. `manifest.json` names the parts
that were committed; what a failed attempt leaves is not named and not read. Rows with a null text or id are not
written, as the layout cannot say null.

A read is cut into byte ranges of the buffers: a task finds the first document that starts in its range by bisection
in the ends, so that the driver reads the manifest only. Of the columns `doc_id`, `size` and `text` only those of the
given schema are read: without `text` no buffer is opened.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "manifest.json"
#: Bytes of a task's range, and bytes and rows that it hands on at a time; a longer text is alone.
RANGE, BATCH, ROWS = 64 << 20, 4 << 20, 8192
TYPES = {"doc_id": pa.int64(), "size": pa.int64(), "text": pa.binary()}


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
    return pyarrow.fs.FileSystem.from_uri(uri)


@dataclass
class Part(WriterCommitMessage):
    """A part that a task wrote, or none if its name is empty."""

    name: str
    documents: int
    bytes: int


@dataclass
class Range(InputPartition):
    """The documents of a part that start at a byte in [low, high); those at its end belong to the last range."""

    name: str
    documents: int
    low: int
    high: int


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        name, documents, total = uuid.uuid4().hex, 0, 0
        with fs.open_output_stream(f"{root}/{name}.buffer") as buffer, fs.open_output_stream(f"{root}/{name}.ends") as ends, fs.open_output_stream(f"{root}/{name}.keys") as keys:
            for batch in iterator:
                t = pa.Table.from_batches([batch]).select(["doc_id", "text"]).drop_null().combine_chunks()
                if not t.num_rows:
                    continue
                text = t.column("text").chunk(0).cast(pa.large_binary())
                at = np.frombuffer(text.buffers()[1], np.int64, text.offset + len(text) + 1)[text.offset :]
                if at[-1] > at[0]:
                    buffer.write(memoryview(text.buffers()[2])[at[0] : at[-1]])
                ends.write((total + at[1:] - at[0]).astype("<u8").tobytes())
                keys.write(t.column("doc_id").to_numpy().astype("<i8").tobytes())
                documents, total = documents + t.num_rows, total + int(at[-1] - at[0])
        return Part(name if documents else "", documents, total)

    def commit(self, messages: list[Part | None]) -> None:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        parts = [[m.name, m.documents, m.bytes] for m in messages if m is not None and m.name]
        with fs.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps({"parts": parts}).encode())

    def abort(self, messages: list[Part | None]) -> None:
        fs, root = opened(self.path)
        for m in messages:
            if m is not None and m.name:
                for kind in ("buffer", "ends", "keys"):
                    fs.delete_file(f"{root}/{m.name}.{kind}")


class Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], size: int):
        self.path, self.columns, self.size = path, columns, size
        if unknown := set(columns) - set(TYPES):
            raise ValueError(f"no such columns: {sorted(unknown)}")

    def partitions(self) -> list[Range]:
        fs, root = opened(self.path)
        with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
            parts = json.loads(f.read())["parts"]
        return [Range(name, n, lo, lo + self.size if lo + self.size < total else total + 1) for name, n, total in parts for lo in range(0, max(total, 1), self.size)] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.documents:
            return
        fs, root = opened(self.path)
        with fs.open_input_file(f"{root}/{partition.name}.ends") as ends:

            def end(i: int) -> int:
                ends.seek(8 * i)
                return int.from_bytes(ends.read(8), "little")

            def first(byte: int) -> int:
                """The first document that starts at this byte or later."""
                lo, hi = 0, partition.documents
                while lo < hi:
                    mid = (lo + hi) // 2
                    if (end(mid - 1) if mid else 0) < byte:
                        lo = mid + 1
                    else:
                        hi = mid
                return lo

            at, stop = first(partition.low), first(partition.high)
            start = end(at - 1) if at else 0
            while at < stop:
                n = min(ROWS, stop - at)
                ends.seek(8 * at)
                own = np.frombuffer(ends.read(8 * n), "<u8").astype(np.int64)
                n = max(1, int(np.searchsorted(own, start + BATCH, side="right")))
                yield self._batch(fs, f"{root}/{partition.name}", at, start, own[:n])
                at, start = at + n, int(own[n - 1])

    def _batch(self, fs: pyarrow.fs.FileSystem, part: str, at: int, start: int, ends: np.ndarray) -> pa.RecordBatch:
        places = np.r_[start, ends] - start

        def section(kind: str, low: int, size: int) -> bytes:
            with fs.open_input_file(f"{part}.{kind}") as f:
                f.seek(low)
                return f.read(size)

        def column(c: str) -> pa.Array:
            if c == "size":
                return pa.array(np.diff(places))
            if c == "doc_id":
                return pa.array(np.frombuffer(section("keys", 8 * at, 8 * ends.size), "<i8").astype(np.int64))
            if places[-1] >= 1 << 31:
                raise ValueError("a text of two gigabytes or more")
            return pa.Array.from_buffers(pa.binary(), ends.size, [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(section("buffer", start, int(places[-1])))])

        return pa.RecordBatch.from_arrays([column(c) for c in self.columns], self.columns)


class PackedCorpus(DataSource):
    """`spark.read.format("packed")` and `df.write.format("packed")`; options: path, and range_bytes for a read."""

    @classmethod
    def name(cls) -> str:
        return "packed"

    def schema(self) -> str:
        return "doc_id long, size long, text binary"

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema.names, int(self.options.get("range_bytes", RANGE)))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if not {"doc_id", "text"} <= {*schema.names}:
            raise ValueError("a packed corpus needs the columns doc_id and text")
        return Writer(self.options["path"])


def write_packed(df: DataFrame, path: str) -> None:
    """Writes `(doc_id, text)`, a part for each task."""
    df.sparkSession.dataSource.register(PackedCorpus)
    df.select("doc_id", df["text"].cast("binary").alias("text")).write.format("packed").mode("append").save(path)


def read_packed(spark: SparkSession, path: str, columns: str = "doc_id long, text binary", range_bytes: int = RANGE) -> DataFrame:
    spark.dataSource.register(PackedCorpus)
    return spark.read.format("packed").schema(columns).option("range_bytes", range_bytes).load(path)
