"""Buckets stored lane after lane: fixed-width blocks with an index, read back by ranges of lanes.

A folder holds files of blocks. A block has the ids and buckets of some documents in one lane: n signed 64-bit ids, then n
unsigned 32-bit buckets, both little-endian, so that its size follows from n. `index.json` lists the blocks of
the files that were committed: file, lane, offset, n, least and greatest id. A read opens the blocks that its lanes
and ids ask for, and of these only the columns of its schema; what a failed attempt leaves is not in the index.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from shinglery.sources.packed import opened

INDEX = "index.json"
#: Rows of a block, and of the blocks that a task reads.
BLOCK, TASK = 1 << 18, 1 << 22
COLUMNS = ("doc_id", "lane", "bucket")


@dataclass
class Written(WriterCommitMessage):
    """The blocks of a task: [file, lane, offset, n, least id, greatest id]."""

    blocks: list


@dataclass
class Blocks(InputPartition):
    blocks: list


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        name, made, at = f"{uuid.uuid4().hex}.lanes", [], 0
        lane, ids, buckets, held = None, [], [], 0
        with fs.open_output_stream(f"{root}/{name}") as out:

            def flush() -> None:
                nonlocal at, ids, buckets, held
                if held:
                    a, b = np.concatenate(ids).astype("<i8"), np.concatenate(buckets).astype("<u4")
                    out.write(a.tobytes() + b.tobytes())
                    made.append([name, int(lane), at, held, int(a.min()), int(a.max())])
                    at += 12 * held
                    ids, buckets, held = [], [], 0

            for batch in iterator:
                if not batch.num_rows:
                    continue
                own, key, value = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("lane", "doc_id", "bucket"))
                cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), own.size]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    if own[lo] != lane:
                        flush()
                        lane = own[lo]
                    while lo < hi:
                        n = min(hi - lo, BLOCK - held)
                        ids.append(key[lo : lo + n])
                        buckets.append(value[lo : lo + n])
                        held, lo = held + n, lo + n
                        if held == BLOCK:
                            flush()
            flush()
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{INDEX}") as out:
            out.write(json.dumps([b for m in messages if m is not None for b in m.blocks]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        for name in {b[0] for m in messages if m is not None for b in m.blocks}:
            fs.delete_file(f"{root}/{name}")


class Reader(DataSourceReader):
    """Bounds of lanes and ids come from the options."""

    def __init__(self, path: str, columns: list[str], bounds: dict[str, tuple[int, int]], task: int = TASK):
        self.path, self.columns, self.bounds, self.task = path, columns, dict(bounds), task
        if unknown := set(columns) - set(COLUMNS):
            raise ValueError(f"no such columns: {sorted(unknown)}")

    def partitions(self) -> list[Blocks]:
        fs, root = opened(self.path)
        with fs.open_input_stream(f"{root}/{INDEX}") as f:
            index = json.loads(f.read())
        (low, high), (first, last) = self.bounds["lane"], self.bounds["doc_id"]
        out, rows = [[]], 0
        for b in index:
            if low <= b[1] <= high and b[4] <= last and b[5] >= first:
                if out[-1] and rows + b[3] > self.task:
                    out.append([])
                    rows = 0
                out[-1].append(b)
                rows += b[3]
        return [Blocks(x) for x in out]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        fs, root = opened(self.path)
        for name, lane, at, n, _, _ in partition.blocks:
            cols = {"lane": pa.array(np.full(n, lane, np.int64))}
            with fs.open_input_file(f"{root}/{name}") as f:
                for c, skip, kind in (("doc_id", 0, "<i8"), ("bucket", 8 * n, "<u4")):
                    if c in self.columns:
                        f.seek(at + skip)
                        cols[c] = pa.array(np.frombuffer(f.read(n * int(kind[2])), kind).astype(np.int64))
            yield pa.RecordBatch.from_arrays([cols[c] for c in self.columns], self.columns)


class FilteredReader(Reader):
    """Bounds come from filters too, for sessions with spark.sql.python.filterPushdown.enabled."""

    def pushFilters(self, filters: list[Filter]) -> list[Filter]:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in self.bounds:
                low, high = self.bounds[column]
                if isinstance(f, EqualTo):
                    low, high = max(low, f.value), min(high, f.value)
                elif isinstance(f, In):
                    low, high = max(low, min(f.value)), min(high, max(f.value))
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    low = max(low, f.value)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    high = min(high, f.value)
                self.bounds[column] = low, high
        return filters  # bounds leave blocks out; Spark still looks at each row


class LaneStore(DataSource):
    """`spark.read.format("lanes")` and `df.write.format("lanes")`; options: path; for a read lanes and ids as `low:high`,
    task_rows, and push to take bounds from filters."""

    @classmethod
    def name(cls) -> str:
        return "lanes"

    def schema(self) -> str:
        return "doc_id long, lane long, bucket long"

    def reader(self, schema: StructType) -> Reader:
        whole = (-(1 << 63), (1 << 63) - 1)
        bound = lambda c: tuple(int(x) for x in self.options[c].split(":")) if c in self.options else whole
        kind = FilteredReader if self.options.get("push", "false").lower() == "true" else Reader
        return kind(self.options["path"], schema.names, {"lane": bound("lanes"), "doc_id": bound("ids")}, int(self.options.get("task_rows", TASK)))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def write_lanes(buckets: DataFrame, path: str) -> None:
    """Writes `(doc_id, lane, bucket)`: range-partitioned and sorted by lane and id, so that a file holds few lanes in long
    blocks and a lane with many documents is spread over files. Rows with a null go."""
    buckets.sparkSession.dataSource.register(LaneStore)
    rows = buckets.select(*COLUMNS).where(F.col("doc_id").isNotNull() & F.col("lane").isNotNull() & F.col("bucket").isNotNull())
    rows.repartitionByRange("lane", "doc_id").sortWithinPartitions("lane", "doc_id").write.format("lanes").mode("append").save(path)


def read_lanes(spark: SparkSession, path: str, lanes: tuple[int, int] | None = None, ids: tuple[int, int] | None = None, columns: str = "doc_id long, lane long, bucket long", task_rows: int = TASK) -> DataFrame:
    """The rows of the lanes from low to high, both included, and of ids likewise; blocks that have none are not read."""
    spark.dataSource.register(LaneStore)
    source = spark.read.format("lanes").schema(columns).option("task_rows", task_rows)
    for name, bound in (("lanes", lanes), ("ids", ids)):
        source = source.option(name, f"{bound[0]}:{bound[1]}") if bound else source
    rows = source.load(path)
    for name, bound in (("lane", lanes), ("doc_id", ids)):
        rows = rows.where(F.col(name).between(*bound)) if bound and name in rows.columns else rows
    return rows
