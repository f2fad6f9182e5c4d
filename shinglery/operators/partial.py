"""Partial signatures: a document's windows cut into segments, folded apart and merged by their minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shinglery.functions.ragged import map_ragged, wide
from shinglery.operators.shingles import bytes_of
from shinglery.operators.signature import folder
from shinglery.plans.params import MinHashParams

#: Windows of a segment.
SEGMENT = 1 << 20


def segments(df: DataFrame, params: MinHashParams, size: int = SEGMENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`(id STRUCT<key, digest, parts>, part, bin)`: `size` windows each, so that neighbours share k - 1 bytes. A row's
    identity is its key and the digest of its text, which a lost executor finds again."""
    docs = bytes_of(df, key, text)
    parts = F.greatest(F.lit(1), F.ceil((F.octet_length("bin") - (params.k - 1)) / size)).cast("int")
    named = docs.select(F.struct(F.col(key).alias("key"), F.unhex(F.md5("bin")).alias("digest"), parts.alias("parts")).alias("id"), "bin")
    cut = named.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("id.parts") - 1)))
    return cut.select("id", "part", F.substring("bin", F.col("part") * size + 1, F.lit(size + params.k - 1)).alias("bin"))


def partial_signatures(cut: DataFrame, params: MinHashParams) -> DataFrame:
    """`(id, sig)` of each segment; narrow."""
    folded = folder(params)
    return map_ragged(cut.select("id", "bin"), "id", lambda ids, data, ends: [ids, wide(folded(data, ends).astype("int64"))], "sig array<long>")


def merged(partials: DataFrame, key: str = "doc_id") -> DataFrame:
    """`(key, sig)`: the least value of each function over the segments of a row, by `min` aggregates that combine before
    they move. Rows of equal key and text have equal segments; as many rows are given back."""
    least = partials.select("id", F.posexplode("sig").alias("fn", "m")).groupBy("id", "fn").agg(F.min("m").alias("m"), F.count("*").alias("seen"))
    one = least.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("fn", "m"))).alias("found"), F.max("seen").alias("seen"))
    rows = one.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.floor(F.col("seen") / F.col("id.parts")))))
    return rows.select(F.col("id.key").alias(key), F.transform("found", lambda x: x["m"]).alias("sig"))


def split_signature(df: DataFrame, params: MinHashParams, size: int = SEGMENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`signature`, in which one long document is the work of many tasks.

    Documents of at most `size` windows are folded where they are read; longer ones are cut, their segments dealt
    out, folded and merged. Only the long ones move. The texts are read twice, and each is folded once.
    """
    windows = F.octet_length(F.encode(text, "UTF-8") if dict(df.dtypes)[text] == "string" else F.col(text)) - (params.k - 1)
    folded = folder(params)
    short = map_ragged(bytes_of(df.where(windows <= size), key, text), key, lambda keys, data, ends: [keys, wide(folded(data, ends).astype("int64"))], "sig array<long>")
    dealt = segments(df.where(windows > size), params, size, key, text).repartition("id.digest", "part")
    return short.unionByName(merged(partial_signatures(dealt, params), key))
