"""The graph model: triples (s, p, o, ts) and what is derived from them.

A KG is a lazy DataFrame of labelled, optionally timed triples; type triples have the predicate ``rdf:type``.
Labels stay columns, so no hash of a label can merge two vertices.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPE = "rdf:type"
YEAR_MS = 31_556_952_000


@dataclass(frozen=True)
class KG:
    triples: DataFrame

    @property
    def edges(self) -> DataFrame:
        """(s, p, o, ts) without type triples; parallel edges stay."""
        return self.triples.where(F.col("p") != TYPE)

    @property
    def types(self) -> DataFrame:
        """(v, types): all types of each typed vertex, sorted."""
        return self.triples.where(F.col("p") == TYPE).groupBy(F.col("s").alias("v")).agg(F.array_sort(F.collect_set("o")).alias("types"))

    @property
    def main_type(self) -> DataFrame:
        """(v, type): the alphabetically first type."""
        return self.triples.where(F.col("p") == TYPE).groupBy(F.col("s").alias("v")).agg(F.min("o").alias("type"))

    def only(self, *predicates: str) -> KG:
        """The graph of these predicates and all type triples."""
        return KG(self.triples.where(F.col("p").isin(TYPE, *predicates)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batch_id(ts, size_ms: int = YEAR_MS):
    """Whole batches since the epoch; ``ts`` may be a timestamp with or without a time zone."""
    return F.expr("cast(null as bigint)") if ts is None else F.floor(F.unix_millis(ts.cast("timestamp")) / F.lit(size_ms)).cast("long")


def relational_kg(spark: SparkSession, sf_dir: str) -> KG:
    """The graph of the relational tables: customers place orders, orders contain parts and are shipped by
    suppliers, both lie in nations and these in regions; users act on days."""
    t = lambda name: table(spark, sf_dir, name)
    none = F.lit(None).cast("timestamp")

    def rows(df, s, p, o, ts=none):
        return df.select(s.alias("s"), p.alias("p"), o.alias("o"), ts.cast("timestamp").alias("ts"))

    def name(kind, column):
        return F.concat(F.lit(kind + ":"), F.col(column).cast("string"))

    c, o, l, p, s, n, r, e = (t(x) for x in ("customer", "orders", "lineitem", "part", "supplier", "nation", "region", "events"))
    is_a = F.lit(TYPE)
    parts = [
        rows(c, name("c", "c_custkey"), is_a, F.col("c_mktsegment")),
        rows(o, name("o", "o_orderkey"), is_a, F.col("o_orderpriority")),
        rows(p, name("p", "p_partkey"), is_a, F.col("p_type")),
        rows(s, name("s", "s_suppkey"), is_a, F.lit("supplier")),
        rows(n, name("n", "n_nationkey"), is_a, F.lit("nation")),
        rows(r, name("r", "r_regionkey"), is_a, F.lit("region")),
        rows(o, name("c", "o_custkey"), F.lit("placed"), name("o", "o_orderkey"), F.col("o_orderdate")),
        rows(l, name("o", "l_orderkey"), F.lit("contains"), name("p", "l_partkey"), F.col("l_shipdate")),
        rows(l, name("o", "l_orderkey"), F.lit("shippedBy"), name("s", "l_suppkey"), F.col("l_shipdate")),
        rows(c, name("c", "c_custkey"), F.lit("inNation"), name("n", "c_nationkey")),
        rows(s, name("s", "s_suppkey"), F.lit("inNation"), name("n", "s_nationkey")),
        rows(n, name("n", "n_nationkey"), F.lit("inRegion"), name("r", "n_regionkey")),
        rows(e, name("u", "user_id"), F.col("event_type"), F.concat(F.lit("d:"), F.date_format("ts", "yyyy-MM-dd")), F.col("ts")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionAll(x)
    return KG(out)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local session gets one that goes with the process; a cluster must name one."""
    import atexit
    import shutil
    import tempfile

    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="weftgraph-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``checkpointed``, in Parquet: for large tables, of which a checkpoint would keep every row as it is in memory."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int = 1000) -> DataFrame:
    """Broadcast if it has so few rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def both_ways(edges: DataFrame, *more: str) -> DataFrame:
    """(v, p, nbr, out): every edge from either end."""
    return edges.select(F.col("s").alias("v"), "p", F.col("o").alias("nbr"), F.lit(True).alias("out"), *more).unionAll(
        edges.select(F.col("o").alias("v"), "p", F.col("s").alias("nbr"), F.lit(False).alias("out"), *more)
    )
