"""Text to buckets in one narrow plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shinglery.operators.buckets import text_buckets
from shinglery.plans.params import MinHashParams


def minhash_pipeline(df: DataFrame, params: MinHashParams | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`(key, lane, bucket)` of each document; no shuffle, so it also runs on a stream."""
    return text_buckets(df, params or MinHashParams(), key, text)
