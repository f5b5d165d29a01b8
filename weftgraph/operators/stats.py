"""Counts over graphs: types, degrees, signatures of one and two edges, supports, co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..kg import KG, both_ways, stored

SIGNATURE = ["st", "p", "dt"]


def typed_edges(kg: KG) -> DataFrame:
    """(s, p, o, ts, st, dt): edges of which both ends have a type (triplet view). Types are few beside edges: these are hashed,
    so edges aren't sorted."""
    t = kg.main_type
    source, target = (t.select(F.col("v").alias(v), F.col("type").alias(k)).hint("shuffle_hash") for v, k in (("s", "st"), ("o", "dt")))
    return kg.edges.join(source, "s").join(target, "o").select("s", "p", "o", "ts", "st", "dt")


def signature_counts(typed: DataFrame, labelled: bool = False) -> DataFrame:
    """How many edges have each (source type, predicate, target type), or with ``labelled`` also these ends."""
    return typed.groupBy(*(["st", "s", "p", "dt", "o"] if labelled else SIGNATURE)).agg(F.count(F.lit(1)).alias("n"))


def _rendered(st, p, dt):
    return F.concat_ws("|", st, p, dt)


def star_counts(typed: DataFrame, at: str = "s") -> DataFrame:
    """(a, b, n): unordered pairs of edges that leave (``at='s'``) or enter (``at='o'``) one vertex, by the pair's signatures.

    Pairs are not formed: a vertex with x edges of one signature and y of another has x * y pairs of the two, and
    x * (x - 1) / 2 of the first alone, so a hub costs as much as any other vertex.
    """
    per = typed.groupBy(F.col(at).alias("v"), _rendered("st", "p", "dt").alias("sig")).agg(F.count(F.lit(1)).alias("k"))
    other = per.select("v", F.col("sig").alias("sig2"), F.col("k").alias("k2"))
    pairs = per.join(other, "v").where("sig <= sig2")
    n = F.when(F.col("sig") == F.col("sig2"), F.expr("k * (k - 1) div 2")).otherwise(F.col("k") * F.col("k2"))
    return pairs.groupBy(F.col("sig").alias("a"), F.col("sig2").alias("b")).agg(F.sum(n).cast("long").alias("n")).where("n > 0")


def labelled_star_counts(typed: DataFrame, at: str = "s") -> DataFrame:
    """(v, a, b, n): as ``star_counts``, for each centre and pair of (predicate, other end); these pairs are formed."""
    end = "o" if at == "s" else "s"
    per = typed.groupBy(F.col(at).alias("v"), F.concat_ws("|", "p", end).alias("a")).agg(F.count(F.lit(1)).alias("k"))
    other = per.select("v", F.col("a").alias("b"), F.col("k").alias("k2"))
    n = F.when(F.col("a") == F.col("b"), F.expr("k * (k - 1) div 2")).otherwise(F.col("k") * F.col("k2"))
    return per.join(other, "v").where("a <= b").select("v", "a", "b", n.alias("n")).where("n > 0")


def chain_counts(typed: DataFrame) -> DataFrame:
    """(a, b, n): pairs of an edge into a vertex and one out of it, by signatures, from the counts at that vertex."""
    sig = _rendered("st", "p", "dt")
    into = typed.groupBy(F.col("o").alias("v"), sig.alias("a")).agg(F.count(F.lit(1)).alias("k"))
    out = typed.groupBy(F.col("s").alias("v"), sig.alias("b")).agg(F.count(F.lit(1)).alias("k2"))
    return into.join(out, "v").groupBy("a", "b").agg(F.sum(F.col("k") * F.col("k2")).alias("n"))


def labelled_chain_counts(typed: DataFrame) -> DataFrame:
    """(s, p, v, p2, o, n): as ``chain_counts``, by the labels along the way."""
    into = typed.groupBy(F.col("o").alias("v"), "s", "p").agg(F.count(F.lit(1)).alias("k"))
    out = typed.groupBy(F.col("s").alias("v"), F.col("p").alias("p2"), "o").agg(F.count(F.lit(1)).alias("k2"))
    return into.join(out, "v").select("s", "p", "v", "p2", "o", (F.col("k") * F.col("k2")).alias("n"))


def distribution(counts: DataFrame, n: str = "n") -> DataFrame:
    """Each count's share of the total."""
    total = counts.agg(F.sum(n).alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col(n) / F.col("total")).drop("total")


def count_histogram(counts: DataFrame, n: str = "n") -> DataFrame:
    """(n, times): how often each count occurs."""
    return counts.groupBy(F.col(n).alias("n")).agg(F.count(F.lit(1)).alias("times"))


def degrees(edges: DataFrame) -> DataFrame:
    """(v, degree): edges in and out; a loop counts twice."""
    return edges.select(F.explode(F.array("s", "o")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("degree"))


def triple_counts(triples: DataFrame, most: int = 250_000) -> DataFrame:
    """(s, p, o, n): how often each triple occurs. Hardly any is repeated, so rows are shuffled before they are counted, into
    so many partitions that one has about ``most``: what a task holds doesn't grow with the graph."""
    parts = max(1, -(-triples.count() // most))
    return triples.select("s", "p", "o").repartition(parts, "s", "p", "o").groupBy("s", "p", "o").agg(F.count(F.lit(1)).alias("n"))


def diversity(edges: DataFrame) -> DataFrame:
    """(v, diversity): distinct targets."""
    return edges.groupBy(F.col("s").alias("v")).agg(F.countDistinct("o").alias("diversity"))


def neighbour_sets(edges: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """(v, nbrs): the sorted set of neighbours either way, but for those over excluded predicates."""
    kept = edges.where(~F.col("p").isin(excluded)) if excluded else edges
    return both_ways(kept).groupBy("v").agg(F.array_sort(F.collect_set("nbr")).alias("nbrs"))


def adjacency_strings(edges: DataFrame) -> DataFrame:
    """(v, adjacency): outgoing ``p->o`` entries, sorted, behind each other."""
    return edges.groupBy(F.col("s").alias("v")).agg(F.concat_ws(" ", F.array_sort(F.collect_list(F.concat_ws("->", "p", "o")))).alias("adjacency"))


ALIASES = ("rdfs:label", "skos:preflabel", "ispreferredmeaningof")


def aliases(triples: DataFrame, predicates=ALIASES) -> DataFrame:
    """(v, aliases): sorted set of objects of alias predicates, whatever their case."""
    return triples.where(F.lower("p").isin(*predicates)).groupBy(F.col("s").alias("v")).agg(F.array_sort(F.collect_set("o")).alias("aliases"))


def labelled_with_aliases(vertices: DataFrame, alias: DataFrame) -> DataFrame:
    """(v, label): the label, with ``<Alias>`` and the aliases joined by ``__`` behind it where there are any."""
    named = F.concat(F.col("v"), F.lit(" <Alias> "), F.concat_ws("__", "aliases"))
    return vertices.join(alias, "v", "left").select("v", F.when(F.col("aliases").isNotNull(), named).otherwise(F.col("v")).alias("label"))


def type_strings(kg: KG) -> DataFrame:
    """(v, type_string): all types joined by ``;;``."""
    return kg.types.select("v", F.concat_ws(";;", "types").alias("type_string"))


def edge_label_histogram(edges: DataFrame) -> DataFrame:
    """(v, histogram): how many outgoing edges have each predicate, as a map."""
    per = edges.groupBy(F.col("s").alias("v"), "p").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("v").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "n")))).alias("histogram"))


def predicate_counts(edges: DataFrame, damping: int = 1) -> DataFrame:
    """(p, n): edges by predicate, divided by ``damping`` and rounded down."""
    return edges.groupBy("p").agg(F.expr(f"count(1) div {damping}").alias("n"))


def multi_edge_pairs(edges: DataFrame, more_than: int = 1) -> DataFrame:
    """(a, b, n): unordered vertex pairs with more than so many distinct triples between them."""
    pair = edges.select(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b"), "s", "p", "o").distinct()
    return pair.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)


def cooccurrence(members: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b, n): in how many groups two items occur together, a < b."""
    m = members.select(F.col(group).alias("g"), F.col(item).alias("a")).distinct()
    return m.join(m.select("g", F.col("a").alias("b")), "g").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def ontology_stats(pairs: DataFrame, thresholds=(1, 1000)) -> DataFrame:
    """One row: how many pairs there are, and how many are heavier than each threshold."""
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), *[F.count_if(F.col("n") > t).alias(f"over_{t}") for t in thresholds])


def signature_sets(kg: KG, each: bool = False) -> DataFrame:
    """(sigs, n): the sorted outgoing signatures of a source, and how many sources have just these. With ``each`` a signature
    is listed once for every distinct triple.

    An edge is shuffled to its target, which adds its type, and to its source, which gathers what it has before it adds its own.
    """
    t = kg.main_type
    source, target = (t.select(F.col("v").alias(v), F.col("type").alias(k)).hint("shuffle_hash") for v, k in (("s", "st"), ("o", "dt")))
    edge = F.concat("p", F.coalesce(F.concat(F.lit("|"), "dt"), F.lit("")))
    # the same edge to the same target is the same triple
    out = kg.edges.select("s", "p", "o").join(target, "o").select("s", (F.struct("o", edge.alias("edge")) if each else edge).alias("edge"))
    per = out.repartition("s").groupBy("s").agg(F.collect_set("edge").alias("edges"))
    if each:
        per = per.withColumn("edges", F.col("edges.edge"))
    per = per.select("s", F.sort_array("edges").alias("edges"))
    sets = per.join(source, "s").groupBy("st", "edges").agg(F.count(F.lit(1)).alias("n"))
    return sets.select(F.transform("edges", lambda e: F.concat_ws("|", "st", e)).alias("sigs"), "n")


def set_pattern_stats(sets: DataFrame, least: int = 2, most: int = 5) -> DataFrame:
    """(size, patterns, support): sets of outgoing signatures by how many sources have them; only sets that more
    than ``least`` sources have are grown. ``sets`` is (sigs, n) of ``signature_sets``.

    Apriori: a set of k is a set of k - 1 and a greater signature of the same row, which is kept as the rest. Sources
    that have the same signatures are one row, so growth costs by different rows.
    """
    rows, out = stored(sets), None
    have = rows.select(F.lit("").alias("set"), F.col("sigs").alias("rest"), "n")
    for size in range(1, most + 1):
        at = have.select("set", "rest", "n", F.posexplode("rest").alias("i", "sig"))
        longer = F.col("sig") if size == 1 else F.concat("set", F.lit(" + "), "sig")
        have = at.select(longer.alias("set"), F.slice("rest", F.col("i") + 2, F.size("rest")).alias("rest"), "n")
        support = stored(have.groupBy("set").agg(F.sum("n").alias("support")).where(F.col("support") > least))
        row = support.agg(F.lit(size).alias("size"), F.count(F.lit(1)).alias("patterns"), F.coalesce(F.sum("support"), F.lit(0)).alias("support"))
        out = row if out is None else out.unionAll(row)
        have = have.join(support.select("set"), "set", "left_semi")
    return out


def rule_support(triples: DataFrame) -> DataFrame:
    """(rule, n): how often each (s type or word, p, o) rule ``s*p*o`` occurs."""
    return triples.groupBy(F.concat_ws("*", "s", "p", "o").alias("rule")).agg(F.count(F.lit(1)).alias("n"))


def url_hosts(pages: DataFrame, url: str = "url") -> DataFrame:
    """(host, n)."""
    return pages.groupBy(F.expr(f"parse_url({url}, 'HOST')").alias("host")).agg(F.count(F.lit(1)).alias("n"))


def query_keys(pages: DataFrame, url: str = "url") -> DataFrame:
    """(key, n): keys of the query strings."""
    pair = F.explode(F.split(F.expr(f"parse_url({url}, 'QUERY')"), "&"))
    return pages.select(pair.alias("pair")).groupBy(F.split_part("pair", F.lit("="), F.lit(1)).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def language_distribution(docs: DataFrame) -> DataFrame:
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def longest_object(triples: DataFrame) -> DataFrame:
    """(s, p, o): of the objects of a subject and predicate the longest, of equally long ones the last in order."""
    return triples.groupBy("s", "p").agg(F.max_by("o", F.struct(F.length("o"), "o")).alias("o"))


def category_members(triples: DataFrame, predicate: str = "rdf:type") -> DataFrame:
    """(category, members): sorted subjects of each object, joined by ``;;``."""
    return triples.where(F.col("p") == predicate).groupBy(F.col("o").alias("category")).agg(F.concat_ws(";;", F.array_sort(F.collect_set("s"))).alias("members"))


def mention_weights(triples: DataFrame, block: str) -> DataFrame:
    """(block, mention, weight): each distinct subject or object of a block weighs one over their number."""
    m = triples.select(block, F.explode(F.array("s", "o")).alias("mention")).distinct()
    return m.withColumn("weight", 1 / F.count(F.lit(1)).over(W.partitionBy(block)))


MENTION_TYPES = {"PER": "people", "LOC": "location", "ORG": "company", "MISC": ""}


def mention_type(column):
    """Type names of entity tags; other tags have none."""
    out = F.lit(None).cast("string")
    for tag, name in MENTION_TYPES.items():
        out = F.when(F.upper(column) == tag, name).otherwise(out)
    return out


def mean_and_deviation(values: DataFrame, column: str) -> DataFrame:
    return values.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("deviation"))


def image_support(instances: DataFrame) -> DataFrame:
    """(pattern, support): minimum-image support of rows (pattern, image, v).

    ``image`` is the role whose vertices are counted: by default a type, so roles of one type share their images.
    """
    per = instances.distinct().groupBy("pattern", "image").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("pattern").agg(F.min("n").alias("support"))


def edge_pattern_support(typed: DataFrame, image: str = "type") -> DataFrame:
    """Minimum-image support of the patterns of one edge; ``image='position'`` keeps source and target apart."""
    kind = {"type": ("st", "dt"), "position": (F.lit("source"), F.lit("target"))}[image]
    pattern = _rendered("st", "p", "dt").alias("pattern")
    ends = F.array(*[F.struct((F.col(k) if isinstance(k, str) else k).alias("image"), F.col(v).alias("v")) for k, v in zip(kind, ("s", "o"))])
    return image_support(typed.select(pattern, F.explode(ends).alias("x")).select("pattern", "x.*"))


def vertex_features(kg: KG) -> DataFrame:
    """(v, degree, type_string): every vertex, with degree 0 and type NONE where there is none."""
    everyone = kg.triples.select(F.col("s").alias("v")).unionAll(kg.edges.select(F.col("o").alias("v"))).distinct()
    return (
        everyone.join(degrees(kg.edges), "v", "left").join(type_strings(kg), "v", "left")
        .select("v", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("type_string", F.lit("NONE")).alias("type_string"))
    )


def top_k(counts: DataFrame, k: int, n: str, *ties: str) -> DataFrame:
    return counts.orderBy(F.desc(n), *ties).limit(k)


def top_k_trend(per_batch: DataFrame, k: int) -> DataFrame:
    """(pattern, trend): the k patterns of greatest total support, with their (batch, support) history as text."""
    total = per_batch.groupBy("pattern").agg(F.sum("support").alias("total"))
    best = F.broadcast(top_k(total, k, "total", "pattern"))  # k rows
    pair = F.format_string("%d:%d", "batch", "support")
    trend = F.transform(F.array_sort(F.collect_list(F.struct("batch", pair.alias("text")))), lambda x: x["text"])
    return per_batch.join(best, "pattern").groupBy("pattern").agg(F.concat_ws(" ", trend).alias("trend"))


def rank_band(values: DataFrame, column: str, percent: float, *ties: str) -> DataFrame:
    """Rows whose rank by ``column`` lies in the lowest or highest ``percent`` of all rows.

    The exact rank comes from range partitions: rows are sorted once and numbered from their partition's offset.
    """
    ranked = ranked_rows(values, column, *ties)
    n = ranked.agg(F.count(F.lit(1)).alias("total"))
    low = F.col("total") * percent / 100
    return ranked.crossJoin(F.broadcast(n)).where((F.col("rank0") < low) | (F.col("rank0") > F.col("total") * (100 - percent) / 100)).drop("total")


def ranked_rows(values: DataFrame, *order: str) -> DataFrame:
    """``values`` with ``rank0``, the number of rows before a row in this order; no task sees more than its range."""
    from ..kg import checkpointed

    placed = values.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = checkpointed(placed.withColumn("__part", F.shiftright("__at", 33)))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("__part", (F.sum("size").over(W.orderBy("__part")) - F.col("size")).alias("__before"))  # a row for each partition
    rank = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(before), "__part").withColumn("rank0", rank).drop("__at", "__part", "__before")
