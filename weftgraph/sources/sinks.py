"""Writers. Text is rendered by column expressions and written by the executors; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.paths import rendered


def lines(df: DataFrame, path: str, *columns: str, separator: str = "\t", mode: str = "overwrite") -> None:
    df.select(F.concat_ws(separator, *[F.col(c).cast("string") for c in columns or df.columns]).alias("value")).write.mode(mode).text(path)


def patterns(df: DataFrame, path: str) -> None:
    """``pattern <tab> support``."""
    lines(df, path, "pattern", "support")


def batch_patterns(df: DataFrame, path: str) -> None:
    """``batch <tab> pattern <tab> support``."""
    lines(df, path, "batch", "pattern", "support")


def dependencies(df: DataFrame, path: str) -> None:
    """``small=>joined``."""
    lines(df, path, "small", "joined", separator="=>")


def paths_by_pair(df: DataFrame, path: str) -> None:
    """A folder for each pair with one rendered path a line."""
    rendered(df).select("src", "dst", F.col("line").alias("value")).write.mode("overwrite").partitionBy("src", "dst").text(path)


def labelled_paths(df: DataFrame) -> DataFrame:
    """(src, dst, value): one edge a line, ``Outgoing ; s ; p ; o`` or ``Incoming ; ...``, and an empty line behind each path."""
    before = F.expr("concat(array(src), transform(slice(path, 1, size(path) - 1), x -> x.v))")
    edge = F.zip_with(before, "path", lambda a, e: F.concat_ws(" ; ", F.when(e["out"], "Outgoing").otherwise("Incoming"), F.when(e["out"], a).otherwise(e["v"]), e["p"], F.when(e["out"], e["v"]).otherwise(a)))
    return df.select("src", "dst", F.concat(F.array_join(edge, "\n"), F.lit("\n")).alias("value"))


def decoded_paths(df: DataFrame, vertices: DataFrame, predicates: DataFrame) -> DataFrame:
    """Paths (src, dst, length, path) of ids as paths of labels, by dictionaries (id, label); equal paths stay apart."""
    df = df.groupBy("src", "dst", "length", "path").agg(F.count(F.lit(1)).alias("copies"))
    key = F.xxhash64("src", "dst", F.to_json("path")).alias("k")
    step = df.select(key, "src", "dst", "length", "copies", F.posexplode("path").alias("pos", "e")).select("k", "src", "dst", "length", "copies", "pos", "e.*")
    name = lambda d, c: d.select(F.col("id").cast("string").alias(c), F.col("label").alias(c + "_label"))
    step = step.join(name(predicates, "p"), "p", "left").join(name(vertices, "v"), "v", "left")
    entry = F.struct("pos", F.coalesce("p_label", "p").alias("p"), "out", F.coalesce("v_label", "v").alias("v"))
    whole = step.groupBy("k", "src", "dst", "length", "copies").agg(F.array_sort(F.collect_set(entry)).alias("path"))
    for c in ("src", "dst"):
        whole = whole.join(name(vertices, c), c, "left").withColumn(c, F.coalesce(c + "_label", c)).drop(c + "_label")
    whole = whole.withColumn("copy", F.explode(F.expr("sequence(1, copies)")))
    return whole.select("src", "dst", "length", F.transform("path", lambda e: F.struct(e["p"].alias("p"), e["out"].alias("out"), e["v"].alias("v"))).alias("path"))


def labels_of_steps(df: DataFrame) -> DataFrame:
    """As ``decoded_paths``, of paths (a as src, b as dst) whose entries have their p_label and v_label already."""
    path = F.transform("path", lambda e: F.struct(F.coalesce(e["p_label"], e["p"]).alias("p"), e["out"].alias("out"), F.coalesce(e["v_label"], e["v"]).alias("v")))
    return df.select(F.col("a").alias("src"), F.col("b").alias("dst"), "length", path.alias("path"))


def dot(df: DataFrame, a: str = "small", b: str = "joined", label: str = "part_of", name: str = "dependencies") -> DataFrame:
    """(value): the lines of a Graphviz graph, loops left out; head and foot are rows of their own, ordered by ``nth``."""
    q = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', "'"), F.lit('"'))
    text = F.lit(label) if label not in df.columns else F.col(label)
    body = df.where(F.col(a) != F.col(b)).select(F.lit(1).alias("nth"), F.concat(F.lit("  "), q(a), F.lit(" -> "), q(b), F.lit(' [label="'), text, F.lit('"]')).alias("value"))
    spark = df.sparkSession
    ends = spark.range(2).select((F.col("id") * 2).cast("int").alias("nth"), F.when(F.col("id") == 0, f"digraph {name} {{").otherwise("}").alias("value"))
    return body.unionByName(ends)


def write_dot(df: DataFrame, path: str, **kw) -> None:
    """One file, as Graphviz wants it: for graphs small enough to be drawn."""
    dot(df, **kw).coalesce(1).sortWithinPartitions("nth", "value").select("value").write.mode("overwrite").text(path)


def pattern_table(df: DataFrame) -> DataFrame:
    """(key, support): patterns with ``_`` for everything that isn't a letter or digit."""
    return df.select(F.regexp_replace("pattern", r"[^\p{L}\p{N}]+", "_").alias("key"), "support")


def graph(df: DataFrame, path: str) -> None:
    """Row groups of 16 MB: a group is read by one task, and labels take several times as much in memory."""
    df.write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(path)


def turtle(df: DataFrame) -> DataFrame:
    """(value): ``<s>  <p>  <o>``."""
    return df.select(F.format_string("<%s>  <%s>  <%s>", "s", "p", "o").alias("value"))


def libsvm(df: DataFrame, path: str, label: str, features: list[str]) -> None:
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=features, outputCol="features").transform(df)
    v.select(F.col(label).cast("double").alias("label"), "features").write.format("libsvm").mode("overwrite").save(path)


def sampled_graph(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(value): ``v id label`` lines of all vertices (v, label) and ``e s o w`` lines of the sampled edges."""
    v = vertices.select(F.concat_ws(" ", F.lit("v"), "v", "label").alias("value"))
    return v.unionAll(edges.select(F.concat_ws(" ", F.lit("e"), "s", "o", F.lit("1")).alias("value")))


def features(df: DataFrame, path: str) -> None:
    """Vertex features, degrees, ranks or adjacency as CSV; arrays and maps as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def weighted_pairs(df: DataFrame, path: str) -> None:
    """``a , b , n``."""
    lines(df, path, "a", "b", "n", separator=" , ")


def clusters(df: DataFrame) -> DataFrame:
    """(cluster, members): members of each cluster, sorted, between commas."""
    return df.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list("v")), ",").alias("members"))


def gdf(counts: DataFrame, k: int = 20) -> DataFrame:
    """(nth, value): a GDF file of the bipartite graph of (topic, word, n): the k heaviest words of each topic."""
    from pyspark.sql import Window as W

    top = counts.withColumn("r", F.row_number().over(W.partitionBy("topic").orderBy(F.desc("n"), "word"))).where(F.col("r") <= k)
    node = top.select(F.explode(F.array("topic", "word")).alias("x")).distinct().select(F.lit(1).alias("nth"), F.col("x").alias("value"))
    edge = top.select(F.lit(3).alias("nth"), F.concat_ws(",", "topic", "word", F.col("n").cast("string")).alias("value"))
    heads = counts.sparkSession.range(2).select((F.col("id") * 2).cast("int").alias("nth"), F.when(F.col("id") == 0, "nodedef>name VARCHAR").otherwise("edgedef>node1 VARCHAR,node2 VARCHAR,weight DOUBLE").alias("value"))
    return node.unionAll(edge).unionByName(heads)


def commas_to_tabs(df: DataFrame, column: str = "value") -> DataFrame:
    return df.withColumn(column, F.translate(column, ",", "\t"))


def rows_of_groups(df: DataFrame, group: str, column: str, value) -> DataFrame:
    """All rows of the groups that have a row with this value."""
    return df.join(df.where(F.col(column) == value).select(group).distinct(), group, "left_semi")
