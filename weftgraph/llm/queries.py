"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .common import table
from .exact_dedup import exact_duplicates
from .near_dedup import near_duplicates
from .ann import nearest
from .packing import pack
from .suffix_dedup import repeated_passages
from . import bpe, language, quality, token_count, toxicity


def op2_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op1_suffix_dedup(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents"))


def op3_token_counts(spark, sf_dir):
    return token_count.token_counts(table(spark, sf_dir, "documents"), token_count.load())


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op6_bpe(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents"), bpe.load())


def op10_neighbours(spark, sf_dir):
    """Queries are the rows whose id is divisible by 50; all rows are searched."""
    return nearest(table(spark, sf_dir, "embeddings"), queries="id % 50 = 0")


QUERIES = {f.__name__: f for f in (op2_near_dedup, op5_exact_dedup, op7_toxicity, op8_quality, op9_packing, op1_suffix_dedup, op3_token_counts, op4_language_id, op6_bpe, op10_neighbours)}

SQL = {
    "op5_exact_dedup": """
        SELECT doc_id, duplicate_of, copies FROM (
            SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS duplicate_of, count(*) OVER (PARTITION BY text) AS copies
            FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL))
        WHERE doc_id <> duplicate_of""",
}
