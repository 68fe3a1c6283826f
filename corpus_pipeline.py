"""From raw documents to packed training sequences: STAGES, each over all that the stage before it kept.

Each stage is one corpus operator as a function (spark, docs, sf_dir) -> DataFrame; its
result is meant to be written and read again before the next stage.  All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import minhash, mixing, packing, pii, quality
from tablewright.llm.session import prepared, small, table


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    model = quality.train(docs, quality.graded(table(spark, sf_dir, "labels")))
    return quality.classify(docs, model).where("kept").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, and one row of each document."""
    found = minhash.cut(minhash.near_duplicates(docs).select("doc_id", "kept"))
    gone = found.where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(small(gone), docs["doc_id"].cast("long") == F.col("_gone"), "left_anti").select(*docs.columns)
    again = found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_times")).where("_times > 1").select(F.col("doc_id").alias("_again"))
    again = minhash.cut(again)
    if again.isEmpty():
        return left
    # rows of one id are one document: its longest text stays, ties by the text
    same = left["doc_id"].cast("long") == F.col("_again")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(F.coalesce(F.length(F.col("text").cast("string")), F.lit(-1)).alias("n"), F.col("text").cast("string").alias("t"))
    one = left.join(small(again), same).groupBy("_again").agg(F.max_by(row, order).alias("row")).select("row.*")
    return left.join(small(again), same, "left_anti").select(*docs.columns).unionByName(one)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and disclosing terms put as tags."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their weights, in global random order."""
    return mixing.mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", judge_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: The learned stage and the sketches are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepared(spark), sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
