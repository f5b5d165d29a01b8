"""Predicate builders: each gives a boolean column, to be used in ``where`` or inside a path step."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import jaccard, js_divergence
from .stats import degrees


def support_at_least(least: int, column: str = "support") -> Column:
    return F.col(column) >= least


def recent(batch: Column, current, window: int) -> Column:
    """Inside the sliding window of so many batches up to the current one; rows without a batch (-1) stay."""
    return (batch > current - window) | (batch == -1)


def frequent_only(instances: DataFrame, supports: DataFrame, least: int) -> DataFrame:
    """Instances of frequent patterns; none are left if no pattern is frequent."""
    return instances.join(supports.where(support_at_least(least)).select("pattern"), "pattern", "left_semi")


def with_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices that have an edge."""
    return vertices.join(degrees(edges), "v", "left_semi")


def after(end) -> Column:
    return F.col("ts") > end


def passes(feature: Column, test: Column) -> Column:
    """A vertex without the feature passes."""
    return feature.isNull() | test


def max_degree(degree: Column, most: int) -> Column:
    return passes(degree, degree <= most)


def min_degree(degree: Column, least: int) -> Column:
    return passes(degree, degree >= least)


def coherent(topic: Column, other: Column, below: float) -> Column:
    d = js_divergence(topic, other)
    return passes(d, d < below)


def near_topics(topics: DataFrame, group: str, below: float, block: int = 2048) -> DataFrame:
    """(v, nbr), v < nbr: a superset of the pairs of one group that are ``coherent``, without looking at their logarithms.

    The divergence is no less than 1 - sum(sqrt(p q)), as a binary entropy h(x) is no more than 2 sqrt(x (1 - x)). So blocks of
    vectors are compared by a matrix product; each pair of blocks is one task's work, whatever the size of a group.
    """
    most = topics.groupBy(group).count().agg(F.max("count")).first()[0] or 1
    n = -(-most // block)
    b = F.pmod(F.xxhash64("v"), F.lit(n)).cast("int")
    spread = topics.select(F.col(group).alias("g"), "v", "topic", b.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("c"))
    spread = spread.select("g", "v", "topic", "b", F.least("b", "c").alias("i"), F.greatest("b", "c").alias("j")).where(F.col("g").isNotNull())

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        rows = rows.assign(size=[-1 if x is None else len(x) for x in rows.topic])
        parts = {k: (x.v.to_numpy(), None if k[1] < 1 else np.stack(x.topic.to_numpy()).astype(float)) for k, x in rows.groupby(["b", "size"])}
        i, j = int(rows.i.iloc[0]), int(rows.j.iloc[0])
        for (b1, k1), (v1, x1) in parts.items():
            for (b2, k2), (v2, x2) in parts.items():
                if b1 != i or b2 != j:
                    continue
                if k1 != k2 or x1 is None:  # no divergence: passes
                    p, q = np.divmod(np.arange(len(v1) * len(v2)), len(v2))
                else:
                    h = (x1.sum(1)[:, None] + x2.sum(1)) / 2 - np.sqrt(x1) @ np.sqrt(x2).T
                    p, q = np.nonzero(~(h >= below + 1e-9))
                a, c = v1[p], v2[q]
                keep = a < c if i == j else a != c
                out.append(pd.DataFrame({"v": np.minimum(a, c)[keep], "nbr": np.maximum(a, c)[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"v": [], "nbr": []})

    kind = dict(topics.dtypes)["v"]
    return spread.groupBy("g", "i", "j").applyInPandas(pairs, f"v {kind}, nbr {kind}")


def citation(degree: Column, least: int, most: int, a: Column, b: Column, overlap: float) -> Column:
    return passes(degree, degree.between(least, most)) & (jaccard(a, b) > overlap)


FILTERS = {"max_degree": max_degree, "min_degree": min_degree, "topic": coherent, "citation": citation}


def named_triples(triples: DataFrame, phrases: str = "phrases") -> DataFrame:
    """Extracted triples (s, p, o, phrases): the predicate isn't a possessive, the subject has one of the sentence's
    named phrases, and after is or was the object has one too."""
    has = lambda c: F.exists(phrases, lambda n: F.col(c).contains(n))
    return triples.where(~F.col("p").startswith("'s") & has("s") & (~F.lower("p").isin("is", "was") | has("o")))


def confident(least: float = 0.98) -> Column:
    return F.col("conf") > least


def seeded(seeds: list[str], columns=("s", "o")) -> Column:
    """One of the columns has one of the seeds in it: subject or object for entity seeds, ``('p',)`` for predicates."""
    out = F.lit(False)
    for c in columns:
        for s in seeds:
            out = out | F.contains(F.lower(F.col(c)), F.lit(s.lower()))
    return out


GENERIC = ("LOCATION", "ORGANIZATION", "PERSON", "LOC", "ORG", "PER", "MISC", "NONE")


def real_mention(mention: Column) -> Column:
    return ~F.upper(mention).isin(*GENERIC)


def scored(score: Column, least: float) -> Column:
    """At least so high; NaN isn't."""
    return ~F.isnan(score) & (score >= least)


STOP_WORDS = ("the", "and", "of", "to", "in", "a", "is", "that", "for", "it", "was", "on", "with", "as")


def english(text: Column, lang: Column | None = None, share: float = 0.1) -> Column:
    """By the label where there is one, else by the share of frequent English words."""
    w = F.split(F.lower(text), r"[^\p{L}]+")
    guess = F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))) >= share * F.size(w)
    return guess if lang is None else F.coalesce(lang == "en", guess)


EVENT_WORDS = ("release", "announced", "accident", "sell", "selling")


def event_hits(docs: DataFrame, words=EVENT_WORDS, longer_than: int = 8) -> DataFrame:
    """(doc_id, hits): lines of more than so many words that have a word of the list, summed over the list."""
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.size(F.split("line", " ")) > longer_than)
    hits = sum((F.contains(F.lower("line"), F.lit(w)).cast("long") for w in words), F.lit(0).cast("long"))
    return lines.groupBy("doc_id").agg(F.sum(hits).alias("hits"))
