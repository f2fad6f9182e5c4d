"""A training corpus from documents: no toxic ones, one of each group of near duplicates, without personal
data, mixed to the target weights of the sources, packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shinglery.llm import jaccard_join, mixing, packing, pii, toxicity
from shinglery.llm.common import numbered, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field does not reject; null and empty texts stay."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own, text = numbered(docs)
    return toxicity.score(own, model, text, own.columns).where("predicted = 0").select(*own.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group that links of similarity 0.8 or more connect.

    Null text is empty; texts without words are copies only if they are equal; a null id comes last in its group; of
    repeated rows one stays; an empty table stays empty; all columns are kept, whatever their names."""
    return jaccard_join.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kind's name in brackets in place of each span; null and empty texts stay as they are, repeated rows alike,
    and `n_chars`, if there is one, is the new text's."""
    own, text = numbered(docs)
    clean = F.when(F.col(text).isNotNull(), F.col("pii_text"))
    new = {"text": clean, "n_chars": F.length(clean).cast("long")}
    return pii.redact(own, text).select(*[new.get(c, F.col(n)).alias(c) for c, n in zip(docs.columns, own.columns, strict=True)])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each epoch of a document that the mix takes, the last cut at the source's budget.

    Documents without words (null, empty) have size 0 and are not taken; a null source is a source, last in order; repeated
    rows are rows of their own; rows of equal random key follow each other by id and number."""
    own, text = numbered(docs)
    named = dict(zip(docs.columns, own.columns, strict=True))
    keyed = mixing.keyed(own, own.columns, text, named["doc_id"])
    rows = mixing.take(keyed, mixing.mix(keyed, named["source"], named["doc_id"]), text)
    return rows.select(*[F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(n).alias(c) for c, n in named.items()])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences. Null and empty texts are the end id alone; repeated rows get
    places of their own; pieces of equal length are ranked by id, start, checksum and number."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("pii", personal_data), ("mixing", mixed), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
