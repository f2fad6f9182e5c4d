"""Corpora from tables and from the packed (buffer, ends) layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table, only the columns that fingerprints need. Rows are dealt out where there are fewer files than
    cores: a file may be one row group, which one task reads whole, however many splits it has. To move a text costs
    little beside the folds of its bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(4 * cores) if len(docs.inputFiles()) < cores else docs


def unpack(buffer: bytes, ends: list[int]) -> list[tuple[int, bytes]]:
    """Rows (position, bytes) from a buffer and exclusive, cumulative ends."""
    starts = [0, *ends[:-1]]
    if any(s > e for s, e in zip(starts, ends, strict=True)) or (ends and ends[-1] > len(buffer)):
        raise ValueError("ends must ascend within the buffer")
    return [(i, buffer[s:e]) for i, (s, e) in enumerate(zip(starts, ends, strict=True))]


def pack(docs: list[bytes]) -> tuple[bytes, list[int]]:
    ends, total = [], 0
    for d in docs:
        total += len(d)
        ends.append(total)
    return b"".join(docs), ends


def in_memory(spark: SparkSession, buffer: bytes, ends: list[int]) -> DataFrame:
    """`(doc_id LONG, text BINARY)` of a packed corpus."""
    return spark.createDataFrame([(i, bytearray(b)) for i, b in unpack(buffer, ends)], "doc_id long, text binary")
