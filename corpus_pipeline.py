"""From raw documents to encoded training text in five written stages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ocuspark.llm import mixing, pieces, quality, similar, substring
from ocuspark.llm.text import small_batches, table
from ocuspark.operators.lineage import ensure_checkpoint_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts, fitted on the given labels."""
    small_batches(spark)
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.keep_quality(docs, model)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each component of five-word similarity 0.8 or more."""
    small_batches(spark)
    return similar.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 13 or more words that an earlier document holds."""
    return substring.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: whole copies, and the words of further blocks."""
    return mixing.mix_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and sampled piece ids of every row; they decode to the text."""
    return pieces.encode(docs, pieces.default_vocabulary(spark))


STAGES = [
    ("quality", keep_good),
    ("near_dedup", keep_one_of_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on all that its predecessor kept, each written and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
