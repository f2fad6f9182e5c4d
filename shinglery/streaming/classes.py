"""Bucket classes of a stream of documents, and what of each document is new.

The state is one row for each (lane, bucket) that is alive: its first document, how many came, and when it
ends. A bucket is alive until no document has met it for `gap` of event time, so that state expires with the
watermark and holds no lists of members. What is emitted depends on event times alone: the files of a stream may
come in any order within the watermark's delay, and a restart from the checkpoint repeats nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shinglery.operators.buckets import empty_bucket, text_buckets
from shinglery.plans.params import MinHashParams

CLASS = "lane long, bucket long, first_id long, members long, begins timestamp, ends timestamp"


def timed_buckets(docs: DataFrame, params: MinHashParams, key: str = "doc_id", text: str = "text", at: str = "at") -> DataFrame:
    """`(key, at, lane, bucket)` of documents with an event time; those without text, shingles or time have no rows."""
    named = docs.where(F.col(at).isNotNull()).select(F.struct(F.col(at).alias("at"), F.col(key).alias("key")).alias("id"), text)
    rows = text_buckets(named, params, "id", text).where(F.col("bucket") != empty_bucket(params))
    return rows.select(F.col("id.key").alias(key), F.col("id.at").alias(at), "lane", "bucket")


def session_classes(buckets: DataFrame, gap: str, delay: str | None = None, key: str = "doc_id", at: str = "at") -> DataFrame:
    """`(lane, bucket, first_id, members, begins, ends)`: the stretches in which a bucket is alive. On a stream, `delay`
    is how late rows may come; a class is emitted when the watermark passes its end."""
    timed = buckets.withWatermark(at, delay) if delay else buckets
    alive = timed.groupBy(F.session_window(at, gap).alias("alive"), "lane", "bucket").agg(F.min(F.struct(F.col(at), F.col(key).alias("key"))).alias("first"), F.count("*").alias("members"))
    return alive.select("lane", "bucket", F.col("first.key").alias("first_id"), "members", F.col("alive.start").alias("begins"), F.col("alive.end").alias("ends"))


def stream_classes(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, gap: str, delay: str, params: MinHashParams | None = None, files: int = 1000) -> StreamingQuery:
    """Appends the classes that have ended to `out`, over the Parquet files that `folder` has and has not seen yet,
    at most `files` in a batch; then stops. `schema` has doc_id, text and at."""
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    ended = session_classes(timed_buckets(docs, params or MinHashParams()), gap, delay)
    sink = ended.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
    return sink.trigger(availableNow=True).start()


def novelty(docs: DataFrame, classes: DataFrame, params: MinHashParams, key: str = "doc_id") -> DataFrame:
    """`(key, leads, seen)`: in how many lanes a document is the first of its class, and whether it is not in all, so that
    something like it was seen before. A key has one document."""
    leads = classes.groupBy(F.col("first_id").alias("leader")).agg(F.count("*").alias("leads"))
    found = docs.select(key).join(leads.hint("shuffle_hash"), F.col(key) == F.col("leader"), "left")
    n = F.coalesce("leads", F.lit(0).cast("long"))
    return found.select(key, n.alias("leads"), (n < params.lanes).alias("seen"))
