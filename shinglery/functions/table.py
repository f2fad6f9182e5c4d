"""Fingerprints as a table function of SQL."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from shinglery.functions.murmur import murmur3_words
from shinglery.operators.signature import folder
from shinglery.plans.params import MinHashParams, seeded_family

NAME = "minhash_buckets"


@cache
def parameters(k: int, seed: int, lanes: int, functions: int, family_seed: int | None) -> tuple:
    """Parameters and their fold, made once in a worker; no family seed: the canonical family."""
    if family_seed is None:
        params = MinHashParams.canonical(k=k, seed=seed, lanes=lanes)
    else:
        a, b = seeded_family(functions, family_seed)
        params = MinHashParams(k=k, seed=seed, lanes=lanes, a=a, b=b)
    return params, folder(params)


@udtf(returnType="lane bigint, bucket bigint", useArrow=True)
class MinHashBuckets:
    """`minhash_buckets(text, k, seed, lanes, functions, family_seed)`: a row for each lane of a text or binary value, none
    for null. A null family seed stands for the canonical family of 128 functions."""

    def eval(self, text, k: int, seed: int, lanes: int, functions: int, family_seed: int) -> Iterator[tuple[int, int]]:
        if text is None:
            return
        data = np.frombuffer(text.encode("utf-8", "replace") if isinstance(text, str) else bytes(text), np.uint8)
        params, folded = parameters(k, seed, lanes, functions, family_seed)
        words = folded(data, np.array([0, data.size])).reshape(-1, params.rows)
        yield from enumerate(murmur3_words(words, params.seed).tolist())


def register(spark: SparkSession) -> None:
    """Makes `minhash_buckets` known to the session's SQL."""
    spark.udtf.register(NAME, MinHashBuckets)
