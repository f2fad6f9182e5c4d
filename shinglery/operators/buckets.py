"""Lanes of a signature hashed into bucket ids."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shinglery.functions.murmur import murmur3_words
from shinglery.functions.ragged import map_ragged, repeated
from shinglery.operators.shingles import bytes_of
from shinglery.operators.signature import folder
from shinglery.plans.params import M32, MinHashParams

ROWS = "lane long, bucket long"


def hasher(params: MinHashParams) -> Callable[[pa.Array, np.ndarray], list[pa.Array]]:
    """Columns key, lane and bucket of keys and their signatures, lane after lane."""
    rows, lanes, seed = params.rows, params.lanes, params.seed

    def hashed(keys: pa.Array, sig: np.ndarray) -> list[pa.Array]:
        buckets = murmur3_words(sig.reshape(-1, rows), seed).astype(np.int64)
        return [repeated(keys, np.full(len(keys), lanes)), pa.array(np.tile(np.arange(lanes), len(keys))), pa.array(buckets)]

    return hashed


def lane_buckets(signatures: DataFrame, params: MinHashParams, key: str = "doc_id") -> DataFrame:
    """`(key, lane, bucket)`: per lane the hash of its minima as little-endian 32-bit words.

    Bucket ids of different lanes are not comparable: match on (lane, bucket).
    """
    hashed = hasher(params)
    return map_ragged(signatures.select(key, "sig"), key, lambda keys, values, _: hashed(keys, values.astype(np.uint32)), ROWS)


def packed_buckets(packed: DataFrame, params: MinHashParams, key: str = "doc_id") -> DataFrame:
    """The same from `(key, bin)`, signatures as little-endian 32-bit words."""
    hashed = hasher(params)
    return map_ragged(packed.select(key, "bin"), key, lambda keys, data, _: hashed(keys, data.view("<u4")), ROWS)


def text_buckets(df: DataFrame, params: MinHashParams, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same straight from text: windows, minima and lanes in one pass over Arrow batches."""
    folded, hashed = folder(params), hasher(params)
    return map_ragged(bytes_of(df, key, text), key, lambda keys, data, ends: hashed(keys, folded(data, ends)), ROWS)


def empty_bucket(params: MinHashParams) -> int:
    """The bucket of a lane of a document without shingles, in every lane."""
    return int(murmur3_words(np.full((1, params.rows), M32, np.uint32), params.seed)[0])


def lane_matrix(buckets: DataFrame, width: int, key: str = "doc_id") -> DataFrame:
    """`(tile, lane, d0, d1, ...)`: lanes as rows and documents as columns, `width` documents to a tile.

    The document of key `tile * width + j` is column j of its tile, so that all documents show and no row
    grows with them. Columns of keys that do not occur are null; a repeated key shows its least bucket.
    """
    place = F.pmod(F.col(key), F.lit(width))
    firsts = [F.min(F.when(place == j, F.col("bucket"))).alias(f"d{j}") for j in range(width)]
    tile = F.floor((F.col(key) - place) / width).cast("long")
    return buckets.groupBy(tile.alias("tile"), "lane").agg(*firsts)


def lane_rows(buckets: DataFrame, keys: list[int], key: str = "doc_id", most: int = 1000) -> DataFrame:
    """`(lane, <key>, <key>, ...)`: the whole matrix of a few documents, lanes as rows, a column for each key."""
    if len(keys) > most:
        raise ValueError(f"more than {most} documents: use lane_matrix")
    return buckets.where(F.col(key).isin(keys)).groupBy("lane").pivot(key, keys).agg(F.min("bucket"))
