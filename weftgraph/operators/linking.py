"""Collective entity linking: mentions of a block are linked to graph entities together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import compatibility, dice, phrase_similarity, relatedness, tokens
from .stats import neighbour_sets

NEW_ENTITY = "new: "
#: Tokens longer than this are compared with all of a length that can match, as their parts would be too many.
LONG = 32


def mentions(triples: DataFrame, block: str = "block") -> DataFrame:
    """(block, mention): distinct subjects and objects of each block."""
    return triples.select(block, F.explode(F.array("s", "o")).alias("mention")).distinct()


def _token_parts(word: str, threshold: float) -> list[tuple[int, int, int, str]]:
    """(length, other length, place, part): the word cut into one part more than the edits that a match with a word of
    the other length may have, for each other length that can match; one part at least is in that word unchanged."""
    n, out = len(word), []
    for m in range(1, _longest_match(n, threshold) + 1):
        k = _edits(n, m, threshold)
        if k < abs(n - m):
            continue
        if max(n, m) > LONG:
            out.append((n, m, -1, ""))
            continue
        cuts = [n * i // (k + 1) for i in range(k + 2)]
        out += [(n, m, a, word[a:z]) for a, z in zip(cuts, cuts[1:])]
    return list(set(out))


def _token_windows(word: str, threshold: float) -> list[tuple[int, int, int, str]]:
    """As ``_token_parts`` of words of other lengths, wherever their parts may lie in this word."""
    m, out = len(word), set()
    for n in range(1, _longest_match(m, threshold) + 1):
        k = _edits(n, m, threshold)
        if k < abs(n - m):
            continue
        if max(n, m) > LONG:
            out.add((n, m, -1, ""))
            continue
        cuts = [n * i // (k + 1) for i in range(k + 2)]
        for a, z in zip(cuts, cuts[1:]):
            for at in range(max(0, a - k), min(m - (z - a), a + k) + 1):
                out.add((n, m, a, word[at : at + z - a]))
    return list(out)


def _edits(n: int, m: int, threshold: float) -> int:
    """The most edits d with (1 - d / n) + (1 - d / m) >= 2 * threshold, rounded up where that is near."""
    return int(2 * (1 - threshold) * n * m / (n + m) + 1e-6)


def _longest_match(n: int, threshold: float) -> int:
    """No longer word can match one of n letters, as the difference in length alone is too many edits."""
    m = n
    while _edits(n, m + 1, threshold) >= m + 1 - n:
        m += 1
    return m


def _similar_tokens(words: DataFrame, others: DataFrame, threshold: float) -> DataFrame:
    """(t, u): all pairs of a token of ``words`` (t) and one of ``others`` (u) that match by edit distance, and some more."""

    def keys(df, c, cut):
        kind = "array<struct<n:int,m:int,place:int,part:string>>"
        make = F.pandas_udf(lambda x: pd.Series([[dict(zip(("n", "m", "place", "part"), k)) for k in cut(w, threshold)] for w in x]), kind)
        return df.select(c, F.explode(make(c)).alias("key")).select(c, "key.*")

    return keys(words, "t", _token_parts).join(keys(others, "u", _token_windows), ["n", "m", "place", "part"]).select("t", "u").distinct()


def candidates(entities: DataFrame, mention: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(mention, entity, similarity): entities (entity, label) whose phrase similarity reaches the threshold.

    The same as ``all_pairs`` for a threshold above 0: phrases of that similarity share a token, or two of their tokens match
    by edit distance. Such tokens have one of a few parts in common at nearly the same place, so they are found by a
    join of distinct tokens and there is no cross join of all vertices and mentions.
    """
    m = mention.select("mention").distinct()
    has = lambda df, c, name: df.select(c, F.explode(F.array_distinct(tokens(F.col(c)))).alias(name))
    said, named = has(m, "mention", "t"), has(entities.select("label").distinct(), "label", "u")
    # phrase_similarity matches tokens by the default threshold, whatever is asked of the phrases
    same = _similar_tokens(said.select("t").distinct(), named.select("u").distinct(), 0.7)
    pair = said.join(same, "t").join(named, "u").select("mention", "label").distinct().join(entities.select("entity", "label"), "label")
    return _scored(pair, threshold)


def all_pairs(entities: DataFrame, mention: DataFrame, threshold: float = 0.7) -> DataFrame:
    """As ``candidates``, by comparing each entity with each mention."""
    return _scored(entities.select("entity", "label").crossJoin(mention.select("mention").distinct()), threshold)


def _scored(pair: DataFrame, threshold: float) -> DataFrame:
    exact = dice(tokens(F.col("mention")), tokens(F.col("label")))
    sure = pair.withColumn("exact", exact)
    both = sure.withColumn("similarity", F.when(F.col("exact") >= threshold, F.col("exact")).otherwise(phrase_similarity(F.col("mention"), F.col("label"))))
    return both.where(F.col("similarity") >= threshold).groupBy("mention", "entity").agg(F.max("similarity").alias("similarity"))


def context_scores(block_candidates: DataFrame, block_mentions: DataFrame, edges: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(block, mention, entity, score): half by the entity's share of neighbours among the mention's candidates, half by
    how many of its neighbours are mentioned in the block."""
    near = neighbour_sets(edges).select(F.col("v").alias("entity"), "nbrs")
    words = block_mentions.groupBy("block").agg(F.collect_set("mention").alias("words"))
    x = block_candidates.join(near, "entity", "left").join(words, "block").withColumn("nbrs", F.coalesce("nbrs", F.expr("cast(array() as array<string>)")))
    common = F.size(F.array_intersect(F.transform("nbrs", F.lower), F.transform("words", F.lower)))
    total = F.sum(F.size("nbrs")).over(W.partitionBy("block", "mention"))
    score = compatibility(F.size("nbrs"), total, common, F.size("words"), F.size("nbrs"))
    return x.select("block", "mention", "entity", score.alias("score")).where(F.col("score") >= threshold)


def entity_relatedness(scored: DataFrame, edges: DataFrame) -> DataFrame:
    """(block, a, b, related): candidates of different mentions of a block, related by shared neighbours, above 0."""
    near = neighbour_sets(edges)
    everyone = near.agg(F.count(F.lit(1)).alias("everyone"))
    one = scored.select("block", "mention", "entity").distinct()
    pair = one.join(one.select("block", F.col("mention").alias("m2"), F.col("entity").alias("b")), "block").where("mention < m2 and entity != b")
    pair = pair.select("block", F.least("entity", "b").alias("a"), F.greatest("entity", "b").alias("b")).distinct()
    x, y = near.select(F.col("v").alias("a"), F.col("nbrs").alias("na")), near.select(F.col("v").alias("b"), F.col("nbrs").alias("nb"))
    both = pair.join(x, "a").join(y, "b").crossJoin(F.broadcast(everyone))
    r = relatedness(F.size("na"), F.size("nb"), F.size(F.array_intersect("na", "nb")), F.col("everyone"))
    return both.select("block", "a", "b", r.alias("related")).where(F.col("related") > 0)


def referent_graph(scored: DataFrame, related: DataFrame) -> DataFrame:
    """(block, src, dst, w): mention to entity and entity to entity both ways, outgoing weights summing to 1.

    Mentions are ``m:...`` and entities ``e:...``, so equal labels stay apart.
    """
    e = lambda c: F.concat(F.lit("e:"), F.col(c))
    up = scored.select("block", F.concat(F.lit("m:"), "mention").alias("src"), e("entity").alias("dst"), F.col("score").alias("w"))
    there, back = (related.select("block", e(x).alias("src"), e(y).alias("dst"), F.col("related").alias("w")) for x, y in (("a", "b"), ("b", "a")))
    all_ = up.unionByName(there).unionByName(back).where("w > 0")
    return all_.withColumn("w", F.col("w") / F.sum("w").over(W.partitionBy("block", "src")))


def evidence(block: pd.DataFrame, restart: float) -> pd.DataFrame:
    """Solves r = restart * (I - (1 - restart) T)^-1 s for one block; the score of a link is T[m, e] * r[e]."""
    names = sorted(set(block.src) | set(block.dst))
    at = {n: i for i, n in enumerate(names)}
    t = np.zeros((len(names), len(names)))
    for s, d, w in zip(block.src, block.dst, block.w):
        t[at[d], at[s]] += w
    start = np.array([n.startswith("m:") for n in names], float)
    start /= max(start.sum(), 1)
    r = restart * np.linalg.solve(np.eye(len(names)) - (1 - restart) * t, start)
    up = block[block.src.str.startswith("m:")]
    score = [t[at[d], at[s]] * r[at[d]] for s, d in zip(up.src, up.dst)]
    return pd.DataFrame({"block": up.block, "mention": up.src.str[2:], "entity": up.dst.str[2:], "score": score})


def collective(graph: DataFrame, restart: float = 0.1) -> DataFrame:
    """(block, mention, entity, score) of every candidate after evidence was spread through its block."""
    kind = graph.schema["block"].dataType.simpleString()
    return graph.groupBy("block").applyInPandas(lambda b: evidence(b, restart), f"block {kind}, mention string, entity string, score double")


def best(scores: DataFrame) -> DataFrame:
    """The highest score of each mention, of equal ones the first entity."""
    nth = F.row_number().over(W.partitionBy("block", "mention").orderBy(F.desc("score"), "entity"))
    return scores.withColumn("nth", nth).where("nth = 1").drop("nth")


def link(triples: DataFrame, entities: DataFrame, edges: DataFrame, phrase: float = 0.7, least: float = 0.0, restart: float = 0.1, new: str = NEW_ENTITY) -> DataFrame:
    """(block, mention, entity, score): every mention of the (block, s, p, o) triples; without a candidate it is a new
    entity with score 0, with a single one it is linked to that."""
    said = mentions(triples)
    cand = said.join(candidates(entities, said, phrase), "mention").select("block", "mention", "entity")
    scored = context_scores(cand, said, edges, least)
    spread = best(collective(referent_graph(scored, entity_relatedness(scored, edges)), restart))
    # candidates without any weight don't reach the graph: the first of them stands for the mention
    first = scored.groupBy("block", "mention").agg(F.min("entity").alias("first"))
    out = said.join(first, ["block", "mention"], "left").join(spread, ["block", "mention"], "left")
    return out.select("block", "mention", F.coalesce("entity", "first", F.concat(F.lit(new), "mention")).alias("entity"), F.coalesce("score", F.lit(0.0)).alias("score"))


def weighted(block_candidates: DataFrame, block_mentions: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """(block, mention, entity, score, rank): linking one mention at a time by context, popularity and type, 0.7, 0.25, 0.05."""
    c = context_scores(block_candidates, block_mentions, edges)
    near = neighbour_sets(edges).select(F.col("v").alias("entity"), F.size("nbrs").alias("popularity"))
    x = c.join(near, "entity", "left").withColumn("popularity", F.coalesce("popularity", F.lit(0)))
    most = F.greatest(F.lit(1), F.max("popularity").over(W.partitionBy("block", "mention")))
    score = 0.7 * F.col("score") + 0.25 * F.col("popularity") / most + 0.05
    x = x.withColumn("score", score)
    rank = F.row_number().over(W.partitionBy("block", "mention").orderBy(F.desc("score"), "entity"))
    return x.withColumn("rank", rank).where(F.col("rank") <= top).select("block", "mention", "entity", "score", "rank")
