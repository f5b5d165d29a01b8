"""Iterative graph operators and integer coding."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kg import checkpointed, few, stored
from .stats import ranked_rows


def pagerank(edges: DataFrame, rounds: int = 10, reset: float = 0.15, tolerance: float | None = None, most: int = 10_000) -> DataFrame:
    """(v, rank): unnormalised ranks, 1 at first; a round is reset + (1 - reset) * what sources hand on.

    With ``tolerance`` the rounds end once no rank changes by more. Links lie at their source, about ``most`` in a row, and
    stay there in all rounds: a round shuffles what is handed on, and sorts nothing.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = edges.where("s is not null")
    link = e.select(F.col("s").alias("v"), "o", F.lit(True).alias("real")).unionAll(e.select(F.col("o").alias("v"), F.lit(None).cast("string").alias("o"), F.lit(False).alias("real")).distinct())
    link = link.repartition(parts, "v").distinct()
    degree = link.groupBy("v").agg(F.count_if("real").alias("degree"))
    # a hub's targets lie in many rows
    at = F.pmod(F.xxhash64("o"), F.floor(F.col("degree") / most) + 1)
    to = link.join(degree.hint("shuffle_hash"), "v", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))  # a null is no source
    to = to.groupBy("v", "degree", at.alias("at")).agg(F.collect_list("o").alias("to")).drop("at")
    to = to.persist(StorageLevel.DISK_ONLY)
    rank = to.withColumn("rank", F.lit(1.0))
    for turn in range(rounds):
        given = rank.where("size(to) > 0").select((F.col("rank") / F.col("degree")).alias("x"), F.explode("to").alias("v")).groupBy("v").agg(F.sum("x").alias("given"))
        new = to.join(given.hint("shuffle_hash"), "v", "left").select("v", "degree", "to", (reset + (1 - reset) * F.coalesce("given", F.lit(0.0))).alias("rank"))
        if tolerance is not None:
            new = checkpointed(new)
            change = new.select("v", "rank").distinct().join(rank.select("v", F.col("rank").alias("old")).distinct(), "v").agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0]
        rank = new
        if tolerance is not None and (change is None or change <= tolerance):
            break
    out = stored(rank.groupBy("v").agg(F.max("rank").alias("rank")))
    to.unpersist()
    return out


def triangles(edges: DataFrame) -> DataFrame:
    """(v, triangles): of the undirected simple graph; only vertices in one are listed.

    Edges point from the end of lower degree, so that no hub has many out of it. An edge (f, t) is closed by what both its
    ends point to; the end that points to less is looked through, so no pairs of neighbours are formed.
    """
    e = edges.where("s != o").select(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).distinct()
    near = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).repartition("a")
    d = near.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    # each end is handed the other's degree, and the lower end keeps the edge
    given = near.join(d.hint("shuffle_hash"), "a").select(F.col("b").alias("f"), F.col("a").alias("t"), F.col("d").alias("dt")).repartition("f")
    both = given.join(d.select(F.col("a").alias("f"), F.col("d").alias("df")).hint("shuffle_hash"), "f")
    low = both.where(F.struct(F.col("df").alias("d"), F.col("f").alias("v")) < F.struct(F.col("dt").alias("d"), F.col("t").alias("v")))
    return _closed(stored(low.groupBy("f").agg(F.collect_list("t").alias("to"))))


def _candidates(out: DataFrame) -> DataFrame:
    """(f, t, x, a, b): f points to t; x closes them if a points to b. ``out`` is (f, to)."""
    edge = out.select("f", F.size("to").alias("n"), F.explode("to").alias("t")).join(out.select(F.col("f").alias("t"), F.col("to").alias("on")), "t")
    far = edge.where("size(on) <= n").select("f", "t", F.explode("on").alias("x")).select("*", F.col("f").alias("a"), F.col("x").alias("b"))
    rest = edge.where("size(on) > n").select("f", "t").join(out, "f").select("f", "t", F.explode("to").alias("x"))
    return far.unionAll(rest.where("x != t").select("*", F.col("t").alias("a"), F.col("x").alias("b")))


def _closed(out: DataFrame) -> DataFrame:
    hit = _candidates(out).join(out.select(F.col("f").alias("a"), F.explode("to").alias("b")), ["a", "b"])
    return hit.select(F.explode(F.array("f", "t", "x")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("triangles"))


def clusters(pairs: DataFrame, k: int, rounds: int = 10, least: int = 2) -> DataFrame:
    """(v, cluster): power iteration clustering of pairs (a, b, n) with n >= ``least``."""
    from pyspark.ml.clustering import PowerIterationClustering

    heavy = pairs.where(F.col("n") >= least)
    ids = encode_labels(heavy.select(F.explode(F.array("a", "b")).alias("label")))
    coded = heavy.join(ids.select(F.col("label").alias("a"), F.col("id").alias("src")), "a").join(ids.select(F.col("label").alias("b"), F.col("id").alias("dst")), "b")
    coded = coded.select("src", "dst", F.col("n").cast("double").alias("weight"))
    model = PowerIterationClustering(k=k, maxIter=rounds, initMode="degree", srcCol="src", dstCol="dst", weightCol="weight")
    return model.assignClusters(coded).join(ids, "id").select(F.col("label").alias("v"), "cluster")


def encode_labels(labels: DataFrame) -> DataFrame:
    """(label, id): distinct labels numbered from 0 in their order."""
    return ranked_rows(labels.select("label").distinct(), "label").select("label", F.col("rank0").alias("id"))


def encode_graph(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Integer triples (s, p, o), the vertex dictionary and the predicate dictionary."""
    v = encode_labels(edges.select(F.explode(F.array("s", "o")).alias("label")))
    p = encode_labels(edges.select(F.col("p").alias("label")))
    code = lambda d, c: d.select(F.col("label").alias(c), F.col("id").alias(c + "_id"))
    ints = edges.select("s", "p", "o").join(few(code(p, "p")), "p").drop("p").join(code(v, "s").hint("shuffle_hash"), "s").drop("s").join(code(v, "o").hint("shuffle_hash"), "o")
    return ints.select(F.col("s_id").alias("s"), F.col("p_id").alias("p"), F.col("o_id").alias("o")), v, p


def decode_graph(ints: DataFrame, vertices: DataFrame, predicates: DataFrame) -> DataFrame:
    name = lambda d, c: d.select(F.col("id").alias(c), F.col("label").alias(c + "_label"))
    out = ints.join(name(vertices, "o").hint("shuffle_hash"), "o").join(name(vertices, "s").hint("shuffle_hash"), "s").join(few(name(predicates, "p")), "p")
    return out.select(F.col("s_label").alias("s"), F.col("p_label").alias("p"), F.col("o_label").alias("o"))
