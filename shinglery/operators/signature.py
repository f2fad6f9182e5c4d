"""MinHash signatures: for each function the least `(a * h + b) mod 2^32` over a document's hashes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shinglery.functions.ragged import blobs, map_ragged, repeated, wide
from shinglery.operators.shingles import bytes_of, window_hashes
from shinglery.plans.params import M32, MinHashParams

#: Hashes that are folded at once; with two work arrays this stays inside a core's cache.
CHUNK = 1 << 15


def fold(flat: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A (documents, functions) matrix of unsigned minima over hashes that lie one document after another; rows
    without hashes hold 2^32 - 1."""
    out = np.full((sizes.size, a.size), M32, np.uint32)
    rows = np.flatnonzero(sizes)
    ends = np.cumsum(sizes[rows])
    at = done = 0
    while at < rows.size:
        upto = max(at + 1, int(np.searchsorted(ends, done + CHUNK, side="right")))
        starts = ends[at:upto] - sizes[rows[at:upto]] - done
        own = flat[done : ends[upto - 1]]
        if own.size <= CHUNK:
            out[rows[at:upto]] = _minima(own, starts, a, b)
        else:  # one document that is longer than a chunk
            parts = [_minima(own[lo : lo + CHUNK], starts, a, b) for lo in range(0, own.size, CHUNK)]
            out[rows[at]] = np.min(parts, axis=0)[0]
        at, done = upto, int(ends[upto - 1])
    return out


def _minima(flat: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    work, out = np.empty_like(flat), np.empty((a.size, starts.size), np.uint32)
    for j in range(a.size):
        np.multiply(flat, a[j], out=work)
        work += b[j]
        np.minimum.reduceat(work, starts, out=out[j])
    return out.T


def folder(params: MinHashParams) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Signatures of ragged bytes, a row each."""
    a, b, k, seed = np.array(params.a, np.uint32), np.array(params.b, np.uint32), params.k, params.seed
    return lambda data, ends: fold(*window_hashes(data, ends, k, seed), a, b)


def signature(df: DataFrame, params: MinHashParams, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`(key, sig ARRAY<LONG>)` straight from text; narrow, no shuffle, one pass over Arrow batches.

    A minimum ignores repeated hashes; to fold them costs less than to sort them out. Null text is dropped; a
    document with fewer than k bytes keeps the fold's identity 2^32 - 1 in every place.
    """
    folded = folder(params)
    return map_ragged(bytes_of(df, key, text), key, lambda keys, data, ends: [keys, wide(folded(data, ends).astype(np.int64))], "sig array<long>")


def signature_bytes(df: DataFrame, params: MinHashParams, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`(key, bin)`: the same as little-endian 32-bit words, half of what longs take."""
    folded, n = folder(params), params.functions
    return map_ragged(bytes_of(df, key, text), key, lambda keys, data, ends: [keys, blobs(folded(data, ends).ravel(), np.arange(len(keys) + 1) * n)], "bin binary")


def signature_from_hashes(df: DataFrame, params: MinHashParams, key: str = "doc_id", hashes: str = "hs") -> DataFrame:
    """The same from an `ARRAY<INT>` column of shingle hashes (signed view); null arrays are dropped."""
    a, b = np.array(params.a, np.uint32), np.array(params.b, np.uint32)

    def made(keys: pa.Array, values: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
        flat = values.astype(np.int32).view(np.uint32)
        return [keys, wide(fold(flat, np.diff(ends).astype(np.int64), a, b).astype(np.int64))]

    return map_ragged(df.where(F.col(hashes).isNotNull()).select(key, hashes), key, made, "sig array<long>")


def signature_long(signatures: DataFrame, key: str = "doc_id") -> DataFrame:
    """`(key, fn, minhash)`: one row per function."""
    return signatures.select(key, F.posexplode("sig").alias("fn", "minhash")).select(key, F.col("fn").cast("long").alias("fn"), "minhash")


def signature_rows(df: DataFrame, params: MinHashParams, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same straight from text, in the pass that folds."""
    folded, n = folder(params), params.functions

    def made(keys: pa.Array, data: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
        m = folded(data, ends)
        return [repeated(keys, np.full(len(keys), n)), pa.array(np.tile(np.arange(n), len(keys))), pa.array(m.ravel().astype(np.int64))]

    return map_ragged(bytes_of(df, key, text), key, made, "fn long, minhash long")
