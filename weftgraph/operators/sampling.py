"""Structure-aware edge samples. Every draw is a hash of the edge and a seed, so a sample can be repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import uniform
from ..kg import stored
from .stats import degrees, mean_and_deviation, rank_band


def _draw(seed: int):
    return uniform(F.col("s"), F.col("p"), F.col("o"), seed=seed)


def value_band(metric: DataFrame, column: str, percent: float) -> DataFrame:
    """Vertices whose value lies in the lowest or highest ``percent`` of the range of values."""
    ends = metric.agg(F.min(column).alias("low"), F.max(column).alias("high"))  # one row
    width = (F.col("high") - F.col("low")) * percent / 100
    inside = (F.col(column) <= F.col("low") + width) | (F.col(column) >= F.col("high") - width)
    return metric.crossJoin(F.broadcast(ends)).where(inside).select("v")


def band_sample(edges: DataFrame, metric: DataFrame, column: str, percent: float, p: float, q: float, seed: int = 1, most: int = 100_000) -> DataFrame:
    """``sample_and_hold`` at the ``value_band`` of a metric that every vertex of the edges has. Values are few at the ends and
    many between them, or the other way round: where up to ``most`` vertices are outside the band, these are broadcast and
    the edges are neither shuffled nor sorted; else both ends are joined."""
    metric = stored(metric.select("v", column))
    low, high = metric.agg(F.min(column), F.max(column)).first()
    if low is None:
        return edges.limit(0)
    inside = (F.col(column) <= low + (high - low) * percent / 100) | (F.col(column) >= high - (high - low) * percent / 100)
    outside = metric.where(~inside & F.col("v").isNotNull()).select("v")
    if outside.limit(most + 1).count() > most:
        return sample_and_hold(edges, value_band(metric, column, percent), p, q, seed)
    s, o = outside.select(F.col("v").alias("s"), F.lit(True).alias("out_s")), outside.select(F.col("v").alias("o"), F.lit(True).alias("out_o"))
    at = edges.where((_draw(seed) < q) | (_draw(seed + 1) < p)).join(F.broadcast(s), "s", "left").join(F.broadcast(o), "o", "left")
    return at.where((F.col("s").isNotNull() & F.col("out_s").isNull()) | (F.col("o").isNotNull() & F.col("out_o").isNull())).select(*edges.columns)


def sample_and_hold(edges: DataFrame, chosen: DataFrame, p: float, q: float, seed: int = 1, others: bool = False) -> DataFrame:
    """Edges at a chosen vertex are held with probability q and else sampled with p; ``others`` keeps the rest whole."""
    mark = chosen.select("v").distinct()
    s, o = mark.select(F.col("v").alias("s"), F.lit(True).alias("in_s")).hint("shuffle_hash"), mark.select(F.col("v").alias("o"), F.lit(True).alias("in_o")).hint("shuffle_hash")
    at = edges.join(s, "s", "left").join(o, "o", "left").withColumn("at", F.coalesce("in_s", "in_o", F.lit(False)))
    taken = (_draw(seed) < q) | (_draw(seed + 1) < p)
    return at.where((F.col("at") & taken) | (F.lit(others) & ~F.col("at"))).select(*edges.columns)


def ordered_hold(edges: DataFrame, chosen: DataFrame, order: str, p: float, q: float, seed: int = 1) -> DataFrame:
    """Edges at a chosen vertex: held with q if an earlier edge had one of its ends, else sampled with p. Others stay."""
    e = edges.withColumn("eid", F.xxhash64("s", "p", "o", order))
    ends = e.select("eid", order, F.explode(F.array("s", "o")).alias("v"))
    first = F.min(F.struct(order, "eid")).over(W.partitionBy("v"))
    seen = ends.withColumn("before", F.struct(order, "eid") > first).groupBy("eid").agg(F.bool_or("before").alias("before"))
    mark = chosen.select("v", F.lit(True).alias("mark")).distinct()
    touched = ends.join(mark, "v").select("eid").distinct().withColumn("at", F.lit(True))
    all_ = e.join(seen, "eid").join(touched, "eid", "left")
    return all_.where(F.col("at").isNull() | (_draw(seed) < F.when(F.col("before"), q).otherwise(p))).select(*edges.columns)


def similar_rank(edges: DataFrame, ranks: DataFrame, p: float, spread: float = 1.0, seed: int = 1) -> DataFrame:
    """Edges between vertices whose ranks differ by less than ``spread`` deviations stay, others are sampled with p."""
    d = mean_and_deviation(ranks, "rank").select("deviation")  # one row
    a, b = ranks.select(F.col("v").alias("s"), F.col("rank").alias("a")).hint("shuffle_hash"), ranks.select(F.col("v").alias("o"), F.col("rank").alias("b")).hint("shuffle_hash")
    both = edges.join(a, "s").join(b, "o").crossJoin(F.broadcast(d))
    return both.where((F.abs(F.col("a") - F.col("b")) < spread * F.col("deviation")) | (_draw(seed) < p)).select(*edges.columns)


def rank_range_sample(edges: DataFrame, percent: float, p: float, q: float, seed: int = 1) -> DataFrame:
    """Sample and hold at the vertices of lowest and highest degree rank."""
    return sample_and_hold(edges, rank_band(degrees(edges), "degree", percent, "v"), p, q, seed)


def degree_accelerated(edges: DataFrame, percent: float, acceleration: float, seed: int = 1) -> DataFrame:
    """Edges drop out with probability degree / (2 |E|) * acceleration of their ends in the rank band, the greater one."""
    band = rank_band(degrees(edges), "degree", percent, "v").select("v", "degree")
    n = edges.agg(F.count(F.lit(1)).alias("edges"))
    a, b = band.select(F.col("v").alias("s"), F.col("degree").alias("da")), band.select(F.col("v").alias("o"), F.col("degree").alias("db"))
    all_ = edges.join(a, "s", "left").join(b, "o", "left").crossJoin(F.broadcast(n))
    drop = F.greatest(F.coalesce("da", F.lit(0)), F.coalesce("db", F.lit(0))) / (2 * F.col("edges")) * acceleration
    return all_.where(_draw(seed) >= drop).select(*edges.columns)


FRACTIONS = {0: 0.0, 1: 0.05, 2: 0.05, 3: 0.1, 4: 0.2, 5: 0.2, 6: 0.2, 7: 0.075, 8: 0.075, 9: 0.05}


def stratified(values: DataFrame, column: str, key: str, fractions: dict[int, float] | None = None, seed: int = 1) -> DataFrame:
    """Rows by decile of their value's share of the greatest value, each with its decile's fraction; 10 counts as 9."""
    most = values.agg(F.max(column).alias("most"))
    decile = F.least(F.lit(9), F.floor(10 * F.col(column) / F.col("most"))).cast("int")
    f = F.lit(0.0)
    for d, x in (fractions or FRACTIONS).items():
        f = F.when(F.col("decile") == d, x).otherwise(f)
    return values.crossJoin(F.broadcast(most)).withColumn("decile", decile).where(uniform(F.col(key), seed=seed) < f).drop("most")


def grid(edges: DataFrame, percents=(10, 20, 30, 40, 50), qs=(0.2, 0.4, 0.6, 0.8, 1.0), ps=(0.2, 0.4, 0.6, 0.8, 1.0), seed: int = 1) -> DataFrame:
    """(percent, q, p, kept): sizes of the rank-range samples over a grid of parameters, from one pass over the edges."""
    ranked = rank_band(degrees(edges), "degree", 100, "v").select("v", "rank0")
    n = ranked.agg(F.max("rank0").alias("top"))
    share = ranked.crossJoin(F.broadcast(n)).select("v", F.least(F.col("rank0"), F.col("top") - F.col("rank0")).alias("edge_rank"), (F.col("top") + 1).alias("total"))
    a, b = share.select(F.col("v").alias("s"), F.col("edge_rank").alias("ra"), "total").hint("shuffle_hash"), share.select(F.col("v").alias("o"), F.col("edge_rank").alias("rb")).hint("shuffle_hash")
    drawn = edges.select("s", "o", _draw(seed).alias("x"), _draw(seed + 1).alias("y")).join(a, "s").join(b, "o").select(F.least("ra", "rb").alias("r"), "total", "x", "y")
    # edges are counted by how many bounds of each kind they are not under; the cases are sums of these counts
    over = lambda value, bounds: sum((F.when(value < x, 0).otherwise(1) for x in bounds), F.lit(0))
    at = drawn.groupBy(over(F.col("r"), [F.col("total") * r / 100 for r in sorted(percents)]).alias("r"), over(F.col("x"), qs).alias("x"), over(F.col("y"), ps).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    names = [(r, q, p) for r in percents for q in qs for p in ps]
    below = lambda c, bounds, bound: F.col(c) <= sorted(bounds).index(bound)
    row = at.agg(*[F.coalesce(F.sum(F.when(below("r", percents, r) & (below("x", qs, q) | below("y", ps, p)), F.col("n"))), F.lit(0)).alias(f"k{i}") for i, (r, q, p) in enumerate(names)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(r).alias("percent"), F.lit(q).alias("q"), F.lit(p).alias("p"), F.col(f"k{i}").alias("kept")) for i, (r, q, p) in enumerate(names)])).alias("x")).select("x.*")
