"""Times the headline queries, warm; prints one JSON line.

documents: signatures and buckets of the documents table. synthetic_*: the published configurations on generated
documents of 200 bytes, k = 4, 128 functions, over BENCH_BYTES (64 MiB) of text: shingle hashes alone, signatures
of given hashes, and both fused. `rates` has documents and, for signatures, affine minima a second.
"""

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shinglery.operators import shingles, signature
from shinglery.plans.params import MinHashParams
from shinglery.plans.queries import QUERIES
from shinglery.sources import synthetic

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
BYTES = int(os.environ.get("BENCH_BYTES", 1 << 26))
WIDTH = 200
P = MinHashParams.canonical()


def headline(spark: SparkSession, texts: DataFrame, hashes: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    count = lambda df, c: df.agg(F.sum(F.element_at(c, 1).cast("long")), F.sum(F.element_at(c, -1).cast("long")))
    return {
        "minhash_signature": lambda: QUERIES["minhash_signature"](spark, SF),
        "pipeline_buckets": lambda: QUERIES["pipeline_buckets"](spark, SF),
        "murmur3_any_length": lambda: QUERIES["murmur3_any_length"](spark, SF),
        "synthetic_shingle_hash": lambda: count(shingles.shingle_hashes(texts, P), "hs"),
        "synthetic_signature": lambda: signature.signature_from_hashes(hashes, P),
        "synthetic_pipeline": lambda: signature.signature(texts, P),
    }


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.files.maxPartitionBytes", "2m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    docs = BYTES // WIDTH
    texts = synthetic.synthetic_documents(spark, docs, WIDTH).cache()
    hashes = synthetic.synthetic_hash_arrays(spark, docs, WIDTH, P.k).cache()
    texts.count(), hashes.count()
    times, rates = {}, {}
    for name, query in headline(spark, texts, hashes).items():
        run = lambda q=query: q().write.format("noop").mode("overwrite").save()
        run()
        began = time.time()
        run()
        times[name] = round(time.time() - began, 3)
        if name.startswith("synthetic"):
            rates[name] = {"documents": round(docs / times[name])}
            if name != "synthetic_shingle_hash":
                rates[name]["affine_minima"] = round(docs * (WIDTH - P.k + 1) * P.functions / times[name])
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF, "bytes": BYTES, "rates": rates}))


if __name__ == "__main__":
    main()
