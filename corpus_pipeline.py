"""A corpus pipeline: toxicity, exact dedup, near dedup, repeated passages, packing.

Each stage is handed what the stage before kept and returns the documents that go on, with the columns of
``documents``; the last one returns the packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import exact_dedup, near_dedup, packing, suffix_dedup, toxicity
from weftgraph.llm.common import remove, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on the labelled documents among ``docs``; a null or empty text stays, and so does one at the bound."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the least doc_id stays, of its rows the least in all columns; null texts stay."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the least doc_id stays; texts without words stay."""
    return near_dedup.drop_near_duplicates(docs)


def erase_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in the first document that has them only; a text that is one such passage goes."""
    return suffix_dedup.erase_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document gets its place in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", erase_repeats),
    ("packing", pack),
]

ORACLE_SQL = None  # stages 1, 3 and 5 can't be expressed in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between two stages the documents are a Parquet table in the shared folder.

    A stage's table goes once the next one is written; the last one stays for the result to be read from.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return docs
