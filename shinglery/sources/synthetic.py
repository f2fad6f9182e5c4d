"""Generated inputs for benchmarks: bytes, document ends and shingle hashes, all by `spark.range`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def synthetic_text(spark: SparkSession, n: int) -> DataFrame:
    """`(i, byte)` with byte = (i * i + i) mod 256."""
    r = F.col("id") % 256
    return spark.range(n).select(F.col("id").alias("i"), ((r * r + r) % 256).alias("byte"))


def synthetic_ends(spark: SparkSession, n: int, total: int, width: int = 200) -> DataFrame:
    """`(doc, end)`: documents of `width` bytes, the last ends cut at `total`."""
    return spark.range(n).select(F.col("id").alias("doc"), F.least((F.col("id") + 1) * width, F.lit(total).cast("long")).alias("end"))


def synthetic_hashes(spark: SparkSession, n: int) -> DataFrame:
    """`(i, h)` with h = i mod 1024."""
    return spark.range(n).select(F.col("id").alias("i"), (F.col("id") % 1024).alias("h"))


def synthetic_documents(spark: SparkSession, n: int, width: int = 200) -> DataFrame:
    """`(doc_id, text BINARY)`: n documents of `width` bytes of the synthetic text."""
    at = lambda j: (F.col("id") * width + j) % 256
    digits = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.lpad(F.hex((at(j) * at(j) + at(j)) % 256), 2, "0"))
    return spark.range(n).select(F.col("id").alias("doc_id"), F.unhex(F.array_join(digits, "")).alias("text"))


def synthetic_hash_arrays(spark: SparkSession, n: int, width: int = 200, k: int = 4) -> DataFrame:
    """`(doc_id, hs ARRAY<INT>)`: the synthetic hashes cut into documents as windows of `width` bytes lie."""
    per = width - k + 1
    hs = F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda j: ((F.col("id") * per + j) % 1024).cast("int"))
    return spark.range(n).select(F.col("id").alias("doc_id"), hs.alias("hs"))
