"""Shared pieces: the shared folder, Arrow batch mapping, digests, table access."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share.

    Where a session on one machine has none (tests), a temporary folder is set as checkpoint folder; on a
    cluster that raises ValueError, as executors would not see it.
    """
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as a table in the shared folder and read again: cuts the lineage."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` made and that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t.shared_path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """The folders inside a folder, by name."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(f.getPath().toString() for f in found if f.isDirectory())


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


#: Longer keys are not remembered: in texts without spaces a word may be a paragraph.
LONGEST = 64
#: Bytes of an entry besides its key's and its value's own characters: object heads and the table's share.
ENTRY = 160


class Memory(dict):
    """Values of keys by `make`, in two generations of about `most` bytes: look up `memory[key]`, and go on with
    `memory.aged()` now and then. Keys above LONGEST are made anew each time."""

    def __init__(self, make: Callable, most: int, old: dict | None = None):
        super().__init__()
        self.make, self.most, self.old, self.held = make, most, old or {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            self[key] = value
            self.held += ENTRY + len(key) + (len(value) if isinstance(value, bytes) else 0)
        return value

    def put(self, keys: list, values: list[bytes]) -> None:
        """Values that were made elsewhere, of keys of at most LONGEST that it does not hold."""
        self.update(zip(keys, values, strict=True))
        self.held += ENTRY * len(keys) + sum(map(len, keys)) + sum(map(len, values))

    def aged(self) -> Memory:
        if self.held <= self.most:
            return self
        self.old = {}
        return Memory(self.make, self.most, self)


_KEPT: list = ["", None]


def kept(name: str, make: Callable):
    """What `make` made when the worker process last met another name, so that what it remembers outlives a task;
    a new name lets go of it."""
    if _KEPT[0] != name:
        _KEPT[:] = [name, None]
        _KEPT[1] = make()
    return _KEPT[1]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spans_text(spans) -> str:
    """`kind:start:end`, comma-joined."""
    return ",".join([f"{k}:{s}:{e}" for k, s, e in spans])


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def map_texts(df: DataFrame, fn: Callable[[list[str]], dict[str, list]], schema: dict[str, pa.DataType], text: str = "text", keep: list[str] | None = None, rows: int = 256) -> DataFrame:
    """Adds the columns that `fn` makes of the texts (null: empty), a few hundred rows at a time.

    `keep` names the columns to carry (all but the text, if None); fn's columns follow them. An input column
    that is named like one of fn's goes: rename it before (see `numbered`) to keep both.
    """
    keep = [c for c in (df.columns if keep is None else keep) if (c != text or keep) and c not in schema]
    source = df.select(*[F.col(f"`{c}`") for c in keep], *([] if text in keep else [F.col(f"`{text}`")]))
    ddl = ", ".join([f"`{c}` {t}" for c, t in source.dtypes[: len(keep)]] + [f"`{c}` {_ddl(t)}" for c, t in schema.items()])
    n, at = len(keep), source.columns.index(text)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                part = b.slice(lo, rows)
                made = fn([x or "" for x in part.column(at).to_pylist()])
                cols = [pa.array(made[c], t) for c, t in schema.items()]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *cols], [*keep, *schema])

    return source.mapInArrow(mapped, ddl)


def numbered(df: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """The columns under names `col_0`, `col_1`, ..., which no operator's own columns bear, and the text's."""
    names = [f"col_{i}" for i in range(len(df.columns))]
    return df.toDF(*names), names[df.columns.index(text)]


def _ddl(t: pa.DataType) -> str:
    if pa.types.is_list(t):
        return f"array<{_ddl(t.value_type)}>"
    if pa.types.is_struct(t):
        return "struct<" + ", ".join(f"{t.field(i).name}: {_ddl(t.field(i).type)}" for i in range(t.num_fields)) + ">"
    return {pa.int64(): "bigint", pa.int32(): "int", pa.float64(): "double", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean"}[t]
