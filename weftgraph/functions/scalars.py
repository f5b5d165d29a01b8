"""Scalar functions as column expressions; ``register`` makes them SQL functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..kg import batch_id  # noqa: F401


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def kl_divergence(p: Column, q: Column) -> Column:
    """Base 2; 0 log 0 is 0, and a positive p over a zero q is infinite. Null for vectors of different length."""
    term = lambda a, b: F.when(a == 0, 0.0).when(b == 0, F.lit(float("inf"))).otherwise(a * F.log2(a / b))
    return F.when(F.size(p) == F.size(q), _sum(F.zip_with(p, q, term)))


def js_divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence, base 2: between 0 and 1. Null for vectors of different length."""
    part = lambda a, b: F.when(a == 0, 0.0).otherwise(a * F.log2(2 * a / (a + b)))
    return F.when(F.size(p) == F.size(q), _sum(F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2)))


def euclidean(p: Column, q: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(p, q, lambda a, b: (a - b) * (a - b))))


def dot(p: Column, q: Column) -> Column:
    return _sum(F.zip_with(p, q, lambda a, b: a * b))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def softmax(v: Column) -> Column:
    """A distribution from any vector."""
    scale = lambda e: let(_sum(e), lambda total: F.transform(e, lambda x: x / total))
    grow = lambda d: let(F.array_max(d), lambda top: F.transform(d, lambda x: F.exp(x - top)))
    return let(let(F.transform(v, lambda x: x.cast("double")), grow), scale)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def compatibility(neighbours, all_neighbours, common, mentions, size) -> Column:
    """Half the share of the neighbours, half 2c / (m n); without context the second half is 0."""
    context = F.when(mentions * size == 0, 0.0).otherwise(2.0 * common / (mentions * size))
    return 0.5 * F.when(all_neighbours == 0, 0.0).otherwise(neighbours / all_neighbours) + 0.5 * context


def relatedness(a, b, common, everyone) -> Column:
    """Of entities with a and b neighbours, ``common`` of them shared, among ``everyone``; null if nothing is shared."""
    distance = (F.log(F.greatest(a, b)) - F.log(common)) / (F.log(everyone) - F.log(F.least(a, b)))
    return F.when(common > 0, 1 - distance)


def sampling_probability(n, frequency, support) -> Column:
    """1 - max(0, n - frequency * support) / n."""
    return 1 - F.greatest(F.lit(0.0), n - frequency * support) / n


def uniform(*key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the key and seed alone (md5), so samples can be repeated anywhere."""
    digest = F.md5(F.concat_ws("|", *key, F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def pattern_key(pattern) -> Column:
    """A 64-bit name of a canonical pattern."""
    return F.xxhash64(pattern)


def doublings(most: int) -> int:
    """Growth rounds until patterns of ``most`` edges: the whole logarithm to base 2."""
    return int(math.log2(most))


def doublings_of(most: Column) -> Column:
    """As ``doublings``, of a column."""
    return (F.length(F.bin(most.cast("long"))) - 1).cast("int")


def tokens(phrase: Column) -> Column:
    """Lower-case parts between space, ``_``, ``,`` and ``$``, sorted."""
    return F.array_sort(F.filter(F.split(F.lower(phrase), "[ _,$]"), lambda x: x != ""))


def dice(a: Column, b: Column) -> Column:
    """Of two token arrays as multisets: twice the shared tokens over all."""
    count = lambda xs, t: F.size(F.filter(xs, lambda y: y == t))
    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, t: acc + F.least(count(a, t), count(b, t)))
    return F.when(F.size(a) + F.size(b) == 0, 0.0).otherwise(2.0 * shared / (F.size(a) + F.size(b)))


def _levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def phrase_similarity_of(query: str | None, phrase: str | None, threshold: float = 0.7) -> float | None:
    """Dice of the tokens if it reaches the threshold; else sorted tokens are merged, and two match if their edit
    distance over either length leaves 1.4 together. Each match counts 2 of all tokens."""
    if query is None or phrase is None:
        return None
    import re
    from collections import Counter

    a, b = (sorted(t for t in re.split(r"[ _,$]", x.lower()) if t) for x in (query, phrase))
    if not a or not b:
        return 0.0
    exact = 2 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b))
    if exact >= threshold:
        return exact
    i = j = score = 0
    while i < len(a) and j < len(b):
        d = _levenshtein(a[i], b[j])
        if (1 - d / len(a[i])) + (1 - d / len(b[j])) >= 2 * threshold:
            score, i, j = score + 2, i + 1, j + 1
        elif a[i] < b[j]:
            i += 1
        else:
            j += 1
    return score / (len(a) + len(b))


def _pairwise(one):
    """A vectorised function of two columns; made when it is used, as it asks for a running session."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(run, "double")


def phrase_similarity(query: Column, phrase: Column) -> Column:
    return _pairwise(phrase_similarity_of)(query, phrase)


def register(spark: SparkSession) -> None:
    """``phrase_sim(query, phrase)`` and ``js_divergence(p, q)`` in SQL; the latter is a SQL function over built-in ones."""
    spark.udf.register("phrase_sim", _pairwise(phrase_similarity_of))
    part = "CASE WHEN {0} = 0 THEN 0D ELSE {0} * log2(2 * {0} / ({0} + {1})) END"
    body = f"aggregate(zip_with(p, q, (a, b) -> ({part.format('a', 'b')} + {part.format('b', 'a')}) / 2), 0D, (s, x) -> s + x)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION js_divergence(p ARRAY<DOUBLE>, q ARRAY<DOUBLE>) RETURNS DOUBLE RETURN CASE WHEN size(p) = size(q) THEN {body} END")


def coreference(sentence: Column, mentions: Column) -> Column:
    """``sentence`` with each (mention, name) of the array replaced as a whole word."""
    return F.aggregate(mentions, sentence, lambda text, m: F.regexp_replace(text, F.concat(F.lit(r"\b"), m["mention"], F.lit(r"\b")), m["name"]))
