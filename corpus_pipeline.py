"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is
written as Parquet and read back as the next one's docs. All stages but the last return the columns of
documents. For all stages: an empty table gives an empty result, and further columns are kept as they are,
whatever their names, but for the last stage, which returns its own. A stage sets the session to small batches
between Spark and Python, which bounds what a task holds of very long texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from webquarry.llm import exact_dedup, langid, mixing, near_dedup, packing
from webquarry.llm.common import delete, scratch_dir, scratch_scope, small_batches
from webquarry.llm.queries import tokenizer


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too), and those in none of the languages of the corpus.

    A very long text is judged as a whole; repeated rows are judged alike, row by row; ties between languages go to
    the lesser name; null ids and sources count for nothing.
    """
    small_batches(spark)
    return langid.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays; a null id ranks below all others.

    Null texts equal empty ones; rows that repeat id and text stay together; texts of any length are compared whole.
    """
    small_batches(spark)
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, the document with the least id stays; a null id ranks first.

    Null and empty texts are near each other only; very long texts are compared whole; rows that repeat the id and
    text of the one that stays, stay.
    """
    small_batches(spark)
    return near_dedup.thin(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, once for each time that the mix takes them.

    Null and empty texts have no words and aren't taken; a null source is a source; the last copy of a source is cut
    at a word, however long its text; rows of one id share a place; ties of position go by id.
    """
    small_batches(spark)
    return mixing.curriculum(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset.

    A null text is an empty document of one token; very long texts are cut into pieces; repeated rows are packed one
    by one; ties of length go by rank.
    """
    small_batches(spark)
    return packing.packed(docs, tokenizer())


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]

#: Signatures, training order and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root, before = f"{scratch_dir(spark)}/webquarry-pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        if before:
            delete(spark, f"{root}/{before}")
        before = name
    return docs
