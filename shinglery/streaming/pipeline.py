"""The bucket pipeline over a growing folder of documents."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from shinglery.plans.params import MinHashParams
from shinglery.plans.pipeline import minhash_pipeline


def stream_buckets(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, params: MinHashParams | None = None) -> StreamingQuery:
    """Appends `(doc_id, lane, bucket)` of each new Parquet file to `out`, once per row, then stops."""
    docs = spark.readStream.schema(schema).parquet(folder)
    sink = minhash_pipeline(docs, params).writeStream.format("parquet").outputMode("append")
    return sink.option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
