"""Corpus preparation in five stages: quality, toxicity, near-duplicates, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodetext.llm import mixing, packing, quality, simhash, toxicity
from lodetext.llm.shared import drop_stored, prepared, stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose co-trained probability of good quality is at least 0.3 stay.

    Null and empty texts are scored by the same features, all zero; equal rows get equal scores, so that all or none of them stay. Without labels of both classes all stay.
    """
    prepared(spark)
    rows = quality.features(docs)
    model = quality.fitted(spark, rows, sf_dir)
    drop_stored(rows)
    return docs.where(model.score() >= 0.3)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go.

    Null and empty texts have no evidence and stay; equal texts get equal scores. Without toxic labels all stay.
    """
    prepared(spark)
    return docs.where(toxicity.fitted(spark, docs, sf_dir).score(spark, "text") < 0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays: that with the smallest doc_id.

    Null and empty texts are copies of each other. Of equal ids (null last) the smallest md5 of the text decides, and of equal rows one stays.
    """
    prepared(spark)
    return simhash.deduplicated(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to target weights: a document stays as often as it is taken, the last piece of a source cut to the words taken.

    A null source is a source of its own. Documents without words have nothing to be taken, so that no row of theirs is left; ties are cut by a seeded order.
    """
    prepared(spark)
    return mixing.materialised(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2,048 tokens; a row is a piece of a document. Null and empty texts are their end token alone; repeated rows are packed each."""
    prepared(spark)
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("quality_classifier", good_quality),
    ("toxicity", not_toxic),
    ("simhash_near_dedup", near_duplicates),
    ("source_mixture", mixture),
    ("packing", packed),
]

#: Classifiers, similarity search and tokenization have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages make of sf_dir's documents. Each stage's rows are written in the shared folder and read by the next; other columns of documents go along."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
