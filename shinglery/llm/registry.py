"""The queries of this subpackage by name, and those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shinglery.llm import base_sql, filter_audit, flac, jaccard_join, language_model, licences, merkle, mixing, packing, pii, secrets, style_tree, topk, toxicity
from shinglery.llm.common import documents, shared_dir


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, tags and expressions of every document; null and empty texts have none."""
    return licences.license_scan(documents(spark, sf_dir).select("doc_id", "text"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document; null and empty texts have none."""
    return pii.scan(documents(spark, sf_dir).select("doc_id", "text"))


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and base scores of every document, learnt from those not held out; null is the end token alone."""
    docs = documents(spark, sf_dir).select("doc_id", language_model.held_out(F.col("doc_id")).alias("held_out"), "text")
    return language_model.score(docs, language_model.fit(docs.where("NOT held_out")))


def op4_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a FLAC stream, read back from the media column block by block and described."""
    return flac.described(flac.store(documents(spark, sf_dir).select("doc_id", "text")))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document; null texts have size 0, a null source is the last one."""
    mixed = mixing.mix(mixing.keyed(documents(spark, sf_dir), ["doc_id", "source"]))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, by the ledger of its folder: blobs that an earlier run scanned are not scanned again."""
    root = f"{shared_dir(spark).rstrip('/')}/secret-ledger-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    found = secrets.scan_versions(documents(spark, sf_dir).select("doc_id", "text"), root)
    n = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("findings", lambda x: x["kind"].isin(*secrets.BASE))
    digests = [F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("findings")).alias("spans")]
    return found.select("doc_id", *map(n, secrets.BASE), *digests, F.lit(secrets.RULES_VERSION).alias("rules"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labelled ones that are not held out; empty texts have a score too."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "text"), model)


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best others of every 50th vector by inner product; vectors with nulls or non-finite parts take no part."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", topk.quantized(F.col("embedding")).alias("q")).where("q IS NOT NULL AND vec_id IS NOT NULL")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class and the number of links of every document."""
    found = jaccard_join.jaccard_join(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "class_id", "rep_id", "n_links", "n_shingles")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document stands in the packed sequences."""
    return packing.pack_documents(documents(spark, sf_dir).select("doc_id", "text"))


def op11_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by the style tree of its host."""
    return style_tree.extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and fold of every document."""
    return merkle.manifest(documents(spark, sf_dir).select(*merkle.FIELDS))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every order of the five filters keeps, removes and hides in each source."""
    return filter_audit.filter_audit(documents(spark, sf_dir).select("doc_id", "source", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: The fixed columns of scans, which SQL can express, by the query whose rows they are.
FIXED = {
    "license_base": (op1_license_scan, ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"), base_sql.licence_sql),
    "pii_base": (op2_pii, ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"), base_sql.personal_sql),
    "media_base": (op4_flac_media, ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"), base_sql.media_sql),
    "secret_base": (op6_secret_scan, ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256"), base_sql.secret_sql),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_pii, op3_kneser_ney, op4_flac_media, op5_mix_sources, op6_secret_scan, op7_toxicity, op8_exact_topk, op9_jaccard_join, op10_packing, op11_style_tree, op12_merkle_manifest, op13_filter_audit)} | {
        name: lambda spark, sf_dir, of=of, columns=columns: of(spark, sf_dir).select(*columns) for name, (of, columns, _) in FIXED.items()
    }


def oracle_sql() -> dict[str, str]:
    return {name: made() for name, (_, _, made) in FIXED.items()} | {"op12_merkle_manifest": merkle.sql(), "op13_filter_audit": filter_audit.sql(), "op3_kneser_ney": language_model.sql(), "op5_mix_sources": mixing.sql(), "op8_exact_topk": topk.sql(), "op9_jaccard_join": jaccard_join.sql()}
