"""Byte windows and their hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shinglery.functions.murmur import murmur3_windows, native_whole_hash
from shinglery.functions.ragged import lists, map_ragged, repeated
from shinglery.plans.params import MinHashParams
from shinglery.sources.tables import written


def as_bytes(df: DataFrame, text: str = "text") -> Column:
    """UTF-8 bytes of a STRING column; a BINARY column as it is."""
    return F.encode(F.col(text), "UTF-8") if dict(df.dtypes)[text] == "string" else F.col(text)


def bytes_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """`(key, bin)` of the rows with a text."""
    return df.where(F.col(text).isNotNull()).select(key, as_bytes(df, text).alias("bin"))


def shingle_count(df: DataFrame, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`(key, shingles)`: the number of k-byte windows. Rows with null text go; short ones have 0."""
    n = F.greatest(F.octet_length(as_bytes(df, text)) - F.lit(k - 1), F.lit(0)).cast("long")
    return df.where(F.col(text).isNotNull()).select(key, n.alias("shingles"))


def window_hashes(data: np.ndarray, ends: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows inside each row of ragged bytes, and how many each row has."""
    every = murmur3_windows(data, k, seed)
    sizes = np.maximum(np.diff(ends) - (k - 1), 0).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    return every[np.arange(int(sizes.sum())) + np.repeat(ends[:-1] - first, sizes)], sizes


def shingle_hashes(df: DataFrame, params: MinHashParams, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`(key, hs ARRAY<INT>)`: the hash of every window in order, repeats kept (signed view); one pass over batches."""
    k, seed = params.k, params.seed

    def made(keys: pa.Array, data: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
        hashes, sizes = window_hashes(data, ends, k, seed)
        return [keys, lists(hashes.view(np.int32), np.r_[0, np.cumsum(sizes)])]

    return map_ragged(bytes_of(df, key, text), key, made, "hs array<int>")


def shingle_long(df: DataFrame, params: MinHashParams, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`(key, pos, h)`: one row per window, h in [0, 2^32)."""
    k, seed = params.k, params.seed

    def made(keys: pa.Array, data: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
        hashes, sizes = window_hashes(data, ends, k, seed)
        pos = np.arange(hashes.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return [repeated(keys, sizes), pa.array(pos), pa.array(hashes.astype(np.int64))]

    return map_ragged(bytes_of(df, key, text), key, made, "pos long, h long")


def row_totals(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the hashes of each row, and how many different ones it has; the rows' hashes lie one after another."""
    sums = np.r_[np.uint64(0), np.cumsum(hashes, dtype=np.uint64)]
    ends = np.r_[0, np.cumsum(sizes)]
    own = np.repeat(np.arange(sizes.size, dtype=np.uint64) << np.uint64(32), sizes) | hashes
    own.sort()
    first = np.r_[True, own[1:] != own[:-1]] if own.size else np.empty(0, bool)
    distinct = np.bincount((own[first] >> np.uint64(32)).astype(np.int64), minlength=sizes.size)
    return (sums[ends[1:]] - sums[ends[:-1]]).astype(np.int64), distinct


def shingle_totals(df: DataFrame, params: MinHashParams, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`(key, sum_h, distinct_h)`: the sum of the hashes of a key's windows, and how many different ones there are. Keys
    without a window go.

    Both are made of each text in the pass that hashes, and a row for each text is all that moves. Texts of a key that
    differ (by SHA-256) may share hashes: only the windows of such keys are counted in a shuffle.
    """
    k, seed = params.k, params.seed

    def made(ids: pa.Array, data: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
        hashes, sizes = window_hashes(data, ends, k, seed)
        return [ids, pa.array(sizes), *map(pa.array, row_totals(hashes, sizes))]

    docs = bytes_of(df, key, text)
    named = docs.select(F.struct(F.col(key).alias("key"), F.unhex(F.sha2("bin", 256)).alias("digest")).alias("id"), "bin")
    texts = map_ragged(named, "id", made, "windows long, sum_h long, distinct_h long").where("windows > 0")
    totals = written(texts.select(F.col("id.key").alias(key), "id.digest", "sum_h", "distinct_h"), "totals").groupBy(key)
    found = totals.agg(F.sum("sum_h").alias("sum_h"), F.max("distinct_h").alias("distinct_h"), (F.min("digest") != F.max("digest")).alias("differ"))
    several = written(found.where("differ").select(F.col(key).alias("several_key")), "several")
    again = docs.join(several, docs[key].eqNullSafe(several["several_key"]), "left_semi")
    counted = shingle_long(again, params, key, "bin").groupBy(key).agg(F.sum("h").alias("sum_h"), F.countDistinct("h").alias("distinct_h"))
    return found.where("NOT differ").drop("differ").unionByName(counted)


def whole_hash(df: DataFrame, seed: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`(key, h)`: the hash of each whole value, of any length, inside the JVM. Rows with null text go."""
    docs = df.where(F.col(text).isNotNull()).select(key, as_bytes(df, text).alias("murmur_bin"))
    return native_whole_hash(docs, "murmur_bin", seed, "h").select(key, "h")
