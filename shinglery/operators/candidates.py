"""Documents that share buckets, and how similar their signatures are."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shinglery.functions.ragged import blobs, map_ragged, ragged
from shinglery.operators.buckets import empty_bucket
from shinglery.operators.skew import SHARE, split_join
from shinglery.plans.params import MinHashParams
from shinglery.sources.packed import opened
from shinglery.sources.tables import shared_path, written

#: The normal quantile of a confidence interval of 95 %.
QUANTILE = 1.959964
DECIMALS = 6
#: Signatures that a worker holds, half a KB each.
HELD = 1 << 17


def bucket_classes(buckets: DataFrame, params: MinHashParams, key: str = "doc_id") -> DataFrame:
    """`(lane, bucket, first_id, members)` of buckets with two rows and more: the least key and how many rows. Documents
    without shingles share a bucket in every lane by definition; it is left out."""
    met = buckets.where(F.col("bucket") != empty_bucket(params))
    return met.groupBy("lane", "bucket").agg(F.min(key).alias("first_id"), F.count("*").alias("members")).where("members > 1")


def banded_join(buckets: DataFrame, params: MinHashParams, key: str = "doc_id", share: int = SHARE) -> DataFrame:
    """`(key, lane, bucket, first_id, members)`: each row of `buckets` with its class. Give a table of buckets, as it is
    read several times.

    The pairs of a bucket are not listed: each member stands with the class's first, so that rows grow with the input
    and the classes hold every link. A hot bucket is dealt out to as many pieces as it has shares of all rows.
    """
    return split_join(buckets.select(key, "lane", "bucket"), bucket_classes(buckets, params, key), ["lane", "bucket"], key, share)


def candidate_pairs(joined: DataFrame, key: str = "doc_id") -> DataFrame:
    """`(first_id, key, lanes)`: each document with the first ones of its classes, and in how many lanes they meet. Rows
    move once, to their document, where lanes are told apart and counted."""
    met = joined.where(F.col(key) != F.col("first_id")).select("first_id", key, "lane").repartition(F.col(key))
    return met.groupBy("first_id", key).agg(F.countDistinct("lane").alias("lanes"))


def packed_signatures(signatures: DataFrame, key: str = "doc_id") -> DataFrame:
    """`(key, bin)`: the values of a signature as little-endian 32-bit words, half of what longs take."""
    return map_ragged(signatures.select(key, "sig"), key, lambda keys, values, ends: [keys, blobs(values, ends)], "bin binary")


def interval(agree: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Wilson's bounds of a share of which `agree` of n trials are seen."""
    p, z = agree / n, QUANTILE * QUANTILE
    middle = (p + z / (2 * n)) / (1 + z / n)
    half = QUANTILE / (1 + z / n) * np.sqrt(p * (1 - p) / n + z / (4 * n * n))
    return middle - half, middle + half


def frequent(pairs: DataFrame, a: str, most: int) -> tuple[DataFrame, bool]:
    """`(a)`: the keys that stand in the most pairs as a, `most` at most, and whether others are left. Keys of equal
    counts are in or out together; the driver gets a row for each count that occurs."""
    counts = written(pairs.where(F.col(a).isNotNull()).groupBy(a).agg(F.count("*").alias("pairs_of_key")), "counts")
    taken, least = 0, None
    sizes = counts.groupBy("pairs_of_key").count().orderBy(F.desc("pairs_of_key")).collect()
    for n, keys in sizes:
        if taken + keys > most:
            break
        taken, least = taken + keys, n
    kept = counts.where(F.lit(False) if least is None else F.col("pairs_of_key") >= least).select(a)
    return kept, bool(sizes) and least != sizes[-1][0]


@lru_cache(maxsize=1)
def _held(path: str, key: str) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The signatures of a small table, in a worker: different keys, each key's first row and how many it has, and rows."""
    fs, at = opened(path)
    table = pq.read_table(at, columns=[key, "bin"], filesystem=fs).combine_chunks()
    own = table[key].combine_chunks() if table.num_rows else pa.array([], table.schema.field(key).type)
    keys = own.unique()
    codes = pc.index_in(own, keys).to_numpy()
    order, sizes = np.argsort(codes, kind="stable"), np.bincount(codes, minlength=len(keys))
    rows = words(table["bin"].combine_chunks(), table.num_rows)
    return keys, np.cumsum(sizes) - sizes, sizes, rows if (order == np.arange(order.size)).all() else rows[order]


def words(column: pa.Array, n: int) -> np.ndarray:
    """A column of n blobs of equal length as a row of 32-bit words each."""
    return ragged(column)[0].view("<u4").reshape(n, -1)


def similarity(pairs: DataFrame, signatures: DataFrame, a: str, b: str, key: str = "doc_id", share: int = SHARE, held: int = HELD) -> DataFrame:
    """The columns of `pairs` with `agree`, `similarity`, `low` and `high`: in how many functions the signatures of the
    keys a and b agree, the share as an estimate of the Jaccard similarity of their shingles, and its bounds at 95 %.

    The keys that stand in the most pairs as a, `held` at most, have their signatures in a small table that each worker
    reads, so that of such pairs only the keys move; the firsts of bucket classes are few and stand in nearly all
    pairs. The signatures of other keys are joined. Keys that stand in very many pairs are split in the joins. Pairs
    of a key without a signature go; `signatures`, with `sig` or packed, has one row for a key. Give tables.
    """
    packed = signatures if "bin" in signatures.columns else packed_signatures(signatures, key)
    side = lambda c, to: packed.select(F.col(key).alias(c), F.col("bin").alias(to))
    kept, kinds = pairs.columns, dict(pairs.dtypes)
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", agree long, similarity double, low double, high double"

    def row(batch: pa.RecordBatch, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        agree = (x == y).sum(1)
        low, high = interval(agree, x.shape[1])
        made = [pa.array(agree), pa.array(agree / x.shape[1]), *[pa.array(np.round(v, DECIMALS)) for v in (low, high)]]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *made], [*kept, "agree", "similarity", "low", "high"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield row(batch, *(words(batch.column(c), batch.num_rows) for c in ("sig_a", "sig_b")))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, firsts, sizes, rows = _held(path, a)
        for batch in batches:
            own = pc.index_in(batch.column(a), keys.cast(batch.column(a).type))
            found = np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False))
            at = own.take(pa.array(found)).to_numpy()
            n = sizes[at]
            found, at = np.repeat(found, n), np.repeat(firsts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
            if found.size:
                batch = batch.take(pa.array(found))
                yield row(batch, rows[at], words(batch.column("sig_b"), found.size))

    def moved(some: DataFrame) -> DataFrame:
        first = split_join(some, side(a, "sig_a"), [a], b, share)
        both = split_join(first, side(b, "sig_b"), [b], a, share, some)
        return both.select(*kept, "sig_a", "sig_b").mapInArrow(joined, ddl)

    keys, more = frequent(pairs, a, held)
    path = shared_path(pairs.sparkSession, "held")
    side(a, "bin").join(F.broadcast(keys), a, "left_semi").write.parquet(path)
    if pairs.sparkSession.read.parquet(path).count() > held:  # rows of repeated keys
        return moved(pairs)
    near = split_join(pairs.join(F.broadcast(keys), a, "left_semi"), side(b, "sig_b"), [b], a, share, pairs)
    out = near.select(*kept, "sig_b").mapInArrow(looked_up, ddl)
    return out.unionByName(moved(pairs.join(F.broadcast(keys), a, "left_anti"))) if more else out


def interval_sql(agree: str, n: int) -> str:
    p, z = f"({agree} / {n}.0)", QUANTILE * QUANTILE
    middle, half = f"({p} + {z / (2 * n)!r}) / {1 + z / n!r}", f"{QUANTILE / (1 + z / n)!r} * sqrt({p} * (1 - {p}) / {n}.0 + {z / (4 * n * n)!r})"
    return f"{p}::DOUBLE AS similarity, round(({middle} - {half})::DOUBLE, {DECIMALS}) AS low, round(({middle} + {half})::DOUBLE, {DECIMALS}) AS high"
