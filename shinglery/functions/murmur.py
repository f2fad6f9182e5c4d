"""32-bit MurmurHash3: scalar, vectorised over byte windows, and as a Spark expression."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The constants of MurmurHash3_x86_32.
C1, C2 = 0xCC9E2D51, 0x1B873593
STEP_MUL, STEP_ADD = 5, 0xE6546B64
FINAL_1, FINAL_2 = 0x85EBCA6B, 0xC2B2AE35

M32 = 0xFFFFFFFF
SPARK_SEED = 42


def _rot(x, r):
    return ((x << r) | (x >> (32 - r))) & M32


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """The hash of `data`, in [0, 2^32)."""
    h, whole = seed, len(data) & ~3
    blocks = [int.from_bytes(data[i : i + 4], "little") for i in range(0, whole, 4)]
    for w in blocks:
        h ^= _rot(w * C1 & M32, 15) * C2 & M32
        h = (_rot(h, 13) * STEP_MUL + STEP_ADD) & M32
    h ^= _rot(int.from_bytes(data[whole:], "little") * C1 & M32, 15) * C2 & M32
    return _finish(h ^ len(data))


def _finish(h: int) -> int:
    h = (h ^ (h >> 16)) * FINAL_1 & M32
    h = (h ^ (h >> 13)) * FINAL_2 & M32
    return h ^ (h >> 16)


def _mix_words(w: np.ndarray) -> np.ndarray:
    w = w * np.uint32(C1)
    return ((w << np.uint32(15)) | (w >> np.uint32(17))) * np.uint32(C2)


#: Windows that are hashed together: their work arrays stay inside a core's cache.
WINDOWS = 1 << 14


def murmur3_windows(data: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The hash of each k-byte window of a uint8 array; empty if it has fewer than k bytes."""
    n = data.size - k + 1
    out = np.empty(max(n, 0), np.uint32)
    for lo in range(0, n, WINDOWS):
        m = min(WINDOWS, n - lo)
        out[lo : lo + m] = _windows(data[lo : lo + m + k - 1], m, k, seed)
    return out


def _words(data: np.ndarray, at: int, n: int) -> np.ndarray:
    """The little-endian words that begin at each of n places; the last may end beyond the data, as zeros."""
    whole = np.zeros(n + 6, np.uint8)
    own = data[at : at + n + 3]
    whole[: own.size] = own
    w = np.empty(n, np.uint32)
    for j in range(min(4, n)):
        m = (n - j + 3) // 4
        w[j::4] = whole[j : j + 4 * m].view("<u4")
    return w


def _turn_step(h: np.ndarray) -> np.ndarray:
    turned = h << np.uint32(13)
    h >>= np.uint32(19)
    h |= turned
    h *= np.uint32(STEP_MUL)
    h += np.uint32(STEP_ADD)
    return h


def _windows(data: np.ndarray, n: int, k: int, seed: int) -> np.ndarray:
    h = np.full(n, seed, np.uint32)
    for at in range(0, k & ~3, 4):
        h ^= _mix_words(_words(data, at, n))
        h = _turn_step(h)
    if k & 3:
        h ^= _mix_words(_words(data, k & ~3, n) & np.uint32((1 << 8 * (k & 3)) - 1))
    h ^= np.uint32(k)
    return _finish_all(h)


def murmur3_words(words: np.ndarray, seed: int) -> np.ndarray:
    """The hash of each row of a (rows, n) uint32 array, as its little-endian bytes."""
    h = np.full(len(words), seed, np.uint32)
    for j in range(words.shape[1]):
        h ^= _mix_words(words[:, j])
        h = _turn_step(h)
    return _finish_all(h ^ np.uint32(4 * words.shape[1]))


def _finish_all(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((16, FINAL_1), (13, FINAL_2), (16, None)):
        h ^= h >> np.uint32(shift)
        if factor:
            h *= np.uint32(factor)
    return h


def _undo(c: int) -> int:
    """What undoes a multiplication by an odd constant."""
    return pow(c, -1, 1 << 32)


def seed_literal(seed: int) -> int:
    """The INT whose built-in Spark hash is `seed`.

    `hash(x, y)` hashes y under the seed `hash(x)`, and each step of a one-block hash can be undone,
    so exactly one such integer exists for every seed.
    """
    h = seed ^ (seed >> 16)
    h = h * _undo(FINAL_2) & M32
    h = h ^ (h >> 13) ^ (h >> 26)
    h = h * _undo(FINAL_1) & M32
    h = (h ^ (h >> 16)) ^ 4
    h = _rot((h - STEP_ADD) * _undo(STEP_MUL) & M32, 19) ^ SPARK_SEED
    word = _rot(h * _undo(C2) & M32, 17) * _undo(C1) & M32
    return word - (1 << 32) if word >> 31 else word


def native_hash(col: Column, seed: int) -> Column:
    """Signed INT hash inside whole-stage code generation.

    Equals MurmurHash3_x86_32 only for BINARY values whose length is a multiple of four, INT and LONG.
    """
    return F.hash(F.lit(seed_literal(seed)).cast("int"), col)


def u32(col: Column) -> Column:
    """The unsigned view of a signed INT, as LONG."""
    return col.cast("long").bitwiseAND(F.lit(M32))


def affine(a: int, b: int, h: Column) -> Column:
    """`(a * h + b) mod 2^32` for LONG h in [0, 2^32) that never overflows under ANSI arithmetic."""
    low, high = h.bitwiseAND(F.lit(0xFFFF)), F.shiftright(h, 16)
    top = F.shiftleft((high * F.lit(a)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (low * F.lit(a) + top + F.lit(b)).bitwiseAND(F.lit(M32))


def native_whole_hash(df: DataFrame, value: str, seed: int, out: str) -> DataFrame:
    """Adds `out`, the hash of a BINARY column of any length, as LONG in [0, 2^32); no Python worker runs.

    The built-in hash equals MurmurHash3 on the bytes up to the last multiple of four. Its final mixing can be
    undone, which gives the state to which the tail and the length are then added. Each step is a column of its
    own, so that no expression repeats another one; names that begin with `murmur_` are reserved.
    """
    n, tail = F.octet_length(value), F.pmod(F.octet_length(value), F.lit(4))
    byte = lambda i: F.when(tail > i, F.conv(F.hex(F.substring(F.col(value), n - tail + (i + 1), F.lit(1))), 16, 10).cast("long")).otherwise(F.lit(0).cast("long"))
    word = byte(0).bitwiseOR(F.shiftleft(byte(1), 8)).bitwiseOR(F.shiftleft(byte(2), 16))
    h, k, size = F.col("murmur_h"), F.col("murmur_k"), F.col("murmur_n")
    times = lambda x, c: affine(c, 0, x)
    folded = lambda x, *by: functools.reduce(lambda a, b: a.bitwiseXOR(F.shiftright(x, b)), by, x)
    turned = F.shiftleft(k, 15).bitwiseOR(F.shiftright(k, 17)).bitwiseAND(F.lit(M32))
    steps = (
        {"murmur_h": u32(native_hash(F.substring(F.col(value), F.lit(1), n - tail), seed)), "murmur_k": word, "murmur_n": n.cast("long")},
        {"murmur_h": folded(h, 16), "murmur_k": times(k, C1)},
        {"murmur_h": times(h, _undo(FINAL_2)), "murmur_k": turned},
        {"murmur_h": folded(h, 13, 26), "murmur_k": times(k, C2)},
        {"murmur_h": times(h, _undo(FINAL_1))},
        {"murmur_h": folded(h, 16)},
        {"murmur_h": h.bitwiseXOR(size.bitwiseAND(F.lit(~3))).bitwiseXOR(k).bitwiseXOR(size)},
        {"murmur_h": folded(h, 16)},
        {"murmur_h": times(h, FINAL_1)},
        {"murmur_h": folded(h, 13)},
        {"murmur_h": times(h, FINAL_2)},
        {out: folded(h, 16)},
    )
    for made in steps:
        df = df.withColumns(made)
    return df.drop("murmur_h", "murmur_k", "murmur_n")
