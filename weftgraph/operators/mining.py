"""Frequent patterns: instances are grown by joins, counted by minimum-image support and pruned in between.

An instance is a sorted set of edges; its pattern is the sorted list of their signatures. Growth doubles: instances
that share a vertex (or, later, an edge) are united. Infrequent patterns never grow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import doublings
from ..kg import checkpointed, few, stored
from .filters import frequent_only
from .stats import ranked_rows

JOINER = " + "


def edge_instances(typed: DataFrame) -> DataFrame:
    """(id, edges, pattern, batch): each distinct typed edge as an instance of a one-edge pattern.

    ``typed`` is (s, p, o, st, dt) with a ``batch`` column, or -1 for all.
    """
    batch = F.col("batch") if "batch" in typed.columns else F.lit(-1).cast("long")
    sig = F.concat_ws("|", "st", "p", "dt")
    one = typed.groupBy("s", "p", "o", "st", "dt").agg(F.max(batch).alias("batch"))
    edge = F.struct(F.xxhash64("s", "p", "o").alias("id"), sig.alias("sig"), "s", "st", "o", "dt")
    return one.select(F.xxhash64("s", "p", "o").alias("id"), F.array(edge).alias("edges"), sig.alias("pattern"), "batch")


def support(instances: DataFrame) -> DataFrame:
    """(pattern, support): least number of distinct vertices of one type among a pattern's instances."""
    e = instances.select("pattern", F.explode("edges").alias("e"))
    image = e.select("pattern", F.explode(F.array(F.struct(F.col("e.st").alias("t"), F.col("e.s").alias("v")), F.struct(F.col("e.dt").alias("t"), F.col("e.o").alias("v")))).alias("x"))
    count = image.select("pattern", "x.*").distinct().groupBy("pattern", "t").agg(F.count(F.lit(1)).alias("n"))
    return count.groupBy("pattern").agg(F.min("n").alias("support"))


def grow(instances: DataFrame, shared: str = "vertex", current=None, edge_limit: int | None = None, fresh: bool = False) -> tuple[DataFrame, DataFrame]:
    """New instances, and (small, joined) pattern pairs.

    Unites any two instances that share a vertex or an edge. ``current`` asks for one of that batch in each pair, ``fresh``
    for one with that mark;
    ``edge_limit`` joins an instance only with so many that follow it at the shared place, in order of their edges.
    """
    place = {
        "vertex": lambda e: F.array_union(F.transform(e, lambda x: x["s"]), F.transform(e, lambda x: x["o"])),
        "edge": lambda e: F.transform(e, lambda x: x["id"].cast("string")),
    }[shared](F.col("edges"))
    mark = F.col("fresh") if fresh else F.lit(True)
    at = instances.select("id", "pattern", "batch", mark.alias("fresh"), F.explode(place).alias("at"))
    if edge_limit is not None:
        # ranks come from range partitions and followers by arithmetic, so a hub is sorted and joined in many tasks
        order = F.concat_ws(JOINER, F.transform("edges", lambda x: F.concat_ws("|", x["s"], x["sig"], x["o"])))
        at = ranked_rows(instances.select("id", "pattern", "batch", mark.alias("fresh"), order.alias("order"), F.explode(place).alias("at")), "at", "order").drop("order")
        after = at.select(*[F.col(c).alias(c + "_b") for c in ("id", "pattern", "batch", "fresh")], "at", F.explode(F.expr(f"transform(sequence(1, {edge_limit}), k -> rank0 - k)")).alias("rank0"))
        pair = at.join(after, ["rank0", "at"])
    else:
        pair = at.join(at.select(*[F.col(c).alias(c + "_b") for c in at.columns if c != "at"], "at"), "at").where("id < id_b")
    pair = pair.where("fresh or fresh_b")
    if current is not None:
        pair = pair.where((F.col("batch") == current) | (F.col("batch_b") == current))
    pair = pair.select(F.least("id", "id_b").alias("id"), F.greatest("id", "id_b").alias("id_b")).distinct()
    x = instances.select("id", F.col("edges").alias("ea"), F.col("pattern").alias("pa"), F.col("batch").alias("ba"))
    y = instances.select(F.col("id").alias("id_b"), F.col("edges").alias("eb"), F.col("pattern").alias("pb"), F.col("batch").alias("bb"))
    both = pair.join(x, "id").join(y, "id_b").select("pa", "pb", F.greatest("ba", "bb").alias("batch"), F.array_sort(F.array_union("ea", "eb")).alias("edges"))
    both = both.withColumn("pattern", F.concat_ws(JOINER, F.array_sort(F.transform("edges", lambda e: e["sig"]))))
    both = both.withColumn("id", F.xxhash64(F.transform("edges", lambda e: e["id"])))
    both = checkpointed(both)
    grown = both.groupBy("id").agg(F.first("edges").alias("edges"), F.first("pattern").alias("pattern"), F.max("batch").alias("batch"))
    links = both.select(F.explode(F.array("pa", "pb")).alias("small"), F.col("pattern").alias("joined")).distinct().where("small != joined")
    return grown, links


def _ends(instances: DataFrame) -> DataFrame:
    """(at, sig, s, st, o, dt): the edge of each one-edge instance at either of its vertices."""
    e = instances.select(F.col("edges")[0].alias("e"), "batch").select("e.sig", "e.s", "e.st", "e.o", "e.dt", "batch")
    return e.withColumn("at", F.explode(F.array_distinct(F.array("s", "o"))))


def _pair_pattern(a: str, b: str):
    return F.concat_ws(JOINER, F.array_sort(F.array(a, b)))


def pair_counts(instances: DataFrame, current=None) -> DataFrame:
    """(pattern, n): how many pairs of one-edge instances share a vertex, from counts a vertex; no pair is formed.

    With ``current``, (pattern, batch, n) of the pairs of which one is of that batch, by the later batch of the two.
    """
    kind = ["sig"] if current is None else ["sig", "batch"]
    now = F.lit(True) if current is None else F.col("x.batch") == current
    # an edge is shuffled once to either end, where all of its counts are taken
    other = F.when(F.col("at") == F.col("s"), F.col("o")).otherwise(F.col("s"))
    ends = _ends(instances).select("at", other.alias("other"), *kind).repartition("at")
    k = ends.groupBy("at", *kind).agg(F.count(F.lit(1)).alias("k"))
    # edges between the same two vertices meet at both
    twice = ends.where("at < other").groupBy("at", "other").agg(F.collect_list(F.struct(*kind, F.lit(1).cast("long").alias("k"))).alias("all")).where("size(all) > 1")

    def of(groups: DataFrame, one: bool) -> DataFrame:
        """Pairs within each list; an entry that stands for many edges (``one`` False) has pairs of its own."""
        x = groups.select("all", F.posexplode("all").alias("i", "x")).where(now).select("i", "x", F.posexplode("all").alias("j", "y"))
        # of two entries that both are current, the first in the list is x
        x = x.where((F.col("i") < F.col("j")) | (F.lit(False) if current is None else F.col("y.batch") != current) | (F.lit(not one) & (F.col("i") == F.col("j"))))
        n = F.when(F.col("i") == F.col("j"), F.expr("x.k * (x.k - 1) div 2")).otherwise(F.col("x.k") * F.col("y.k"))
        later = [] if current is None else [F.greatest("x.batch", "y.batch").alias("batch")]
        return x.select(F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b"), *later, n.alias("n"))

    n = of(k.groupBy("at").agg(F.collect_list(F.struct(*kind, "k")).alias("all")), False).unionByName(of(twice, True).withColumn("n", -F.col("n")))
    n = n.groupBy("a", "b", *kind[1:]).agg(F.sum("n").alias("n")).where("n > 0")
    return n.select(_pair_pattern("a", "b").alias("pattern"), *kind[1:], "n")


def _pair_images(edges: DataFrame) -> DataFrame:
    """(a, b, support): of the pairs of edges (sig, s, st, o, dt) that share a vertex, by their signatures, a <= b.

    An edge is in an instance of a pair if another edge of the other signature is at one of its vertices. So each vertex
    gathers the signatures it has, edges hand those at one end to the other, and what a vertex is given is made distinct
    there, before patterns are counted: neither pairs nor images of patterns are shuffled.
    """
    at = F.explode(F.array_distinct(F.array("s", "o"))).alias("at")
    ends = edges.select("sig", "s", "st", "o", "dt", at)
    own = F.when(F.col("at") == F.col("s"), F.col("st")).otherwise(F.col("dt"))
    there = ends.groupBy("at", "sig").agg((F.count(F.lit(1)) > 1).alias("many"), F.first(own).alias("t"))
    there = there.groupBy("at").agg(F.collect_list(F.struct("sig", "many", "t")).alias("all"))
    met = lambda sig: F.transform(F.filter("all", lambda x: (x["sig"] != F.col(sig)) | x["many"]), lambda x: x["sig"]).alias("met")
    given = ends.where("s != o").join(there, "at").select(
        F.when(F.col("at") == F.col("s"), F.col("o")).otherwise(F.col("s")).alias("v"), F.when(F.col("at") == F.col("s"), F.col("dt")).otherwise(F.col("st")).alias("t"), "sig", met("sig")
    )
    kept = there.select("at", "all", F.explode("all").alias("x")).select(F.col("at").alias("v"), F.col("x.t").alias("t"), F.col("x.sig").alias("sig"), "all")
    image = given.unionByName(kept.select("v", "t", "sig", met("sig"))).where(F.size("met") > 0).repartition("v")
    image = image.select("v", "t", "sig", F.explode("met").alias("other")).select("v", "t", F.least("sig", "other").alias("a"), F.greatest("sig", "other").alias("b"))
    count = image.distinct().groupBy("a", "b", "t").agg(F.count(F.lit(1)).alias("n"))
    return count.groupBy("a", "b").agg(F.min("n").alias("support"))


def pair_support(instances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pattern, support) of pairs of one-edge instances that share a vertex, and (small, joined) pattern pairs, as
    ``grow`` and ``support`` give them."""
    pairs = _pair_images(instances.select(F.col("edges")[0].alias("e")).select("e.sig", "e.s", "e.st", "e.o", "e.dt"))
    pairs = pairs.select(_pair_pattern("a", "b").alias("pattern"), "support", "a", "b")
    return pairs.select("pattern", "support"), pairs.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("small"), F.col("pattern").alias("joined"))


def _mined_pairs(typed: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(pattern, support) of single edges, (a, b, pattern, support) of pairs, (pattern, k) the numbers of the frequent
    signatures, and the edges (sig, s, st, o, dt) by these numbers. Edges are kept without instances around them."""
    edges = stored(typed.select("s", "o", F.concat_ws("|", "st", "p", "dt").alias("sig"), "p", "st", "dt").distinct().drop("p"))
    ends = F.array(F.struct(F.col("st").alias("t"), F.col("s").alias("v")), F.struct(F.col("dt").alias("t"), F.col("o").alias("v")))
    image = edges.select("sig", F.explode(ends).alias("x")).select("sig", "x.*").distinct()
    one = image.groupBy("sig", "t").agg(F.count(F.lit(1)).alias("n")).groupBy("sig").agg(F.min("n").alias("support"))
    one = checkpointed(one.where(F.col("support") >= least).select(F.col("sig").alias("pattern"), "support"))
    code = few(checkpointed(ranked_rows(one.select("pattern"), "pattern").select("pattern", F.col("rank0").cast("int").alias("k"))), 20_000)
    coded = edges.join(code.withColumnRenamed("pattern", "sig"), "sig").select(F.col("k").alias("sig"), "s", "st", "o", "dt")
    two = _pair_images(coded).where(F.col("support") >= least)
    for c in "ab":
        two = two.withColumnRenamed(c, "k").join(code.withColumnRenamed("pattern", c), "k").drop("k")
    return one, checkpointed(two.select("a", "b", F.concat_ws(JOINER, "a", "b").alias("pattern"), "support")), code, coded


def _found(one: DataFrame, two: DataFrame) -> tuple[DataFrame, DataFrame]:
    found = one.select("pattern", F.lit(1).alias("size"), "support").unionByName(two.select("pattern", F.lit(2).alias("size"), "support"))
    return found, two.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("small"), F.col("pattern").alias("joined"))


def _mine_pairs(typed: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """``mine`` up to two edges."""
    return _found(*_mined_pairs(typed, least)[:2])


def _bits(rows: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.packbits(rows, axis=-1)]


def _unpacked(data: bytes, k: int) -> np.ndarray:
    """Rows of ``k`` bits."""
    return np.unpackbits(np.frombuffer(data, np.uint8).reshape(-1, -(-k // 8)), axis=1, count=k)


def _dense(lists: pd.Series, k: int) -> np.ndarray:
    """Rows of counts from lists of signature * 8 + count; null is an empty list."""
    out = np.zeros((len(lists), k), np.int8)
    lists = [() if x is None else x for x in lists]
    at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    if len(at):
        x = np.concatenate([np.asarray(y, np.int64) for y in lists if len(y)])
        out[at, x >> 3] = x & 7
    return out


def _dense_rows(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"at": x["at"], "x": [r.tobytes() for r in _dense(x.x, k)]})

    return run


def _around(k: int, friends: np.ndarray):
    """Per edge: which signatures it has around it, once and twice, of those that are frequent beside its own."""
    none = bytes(k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            sig, row = x.sig.to_numpy(np.int64), np.arange(len(x))
            n = sum(np.frombuffer(b"".join(none if y is None else y for y in x[c]), np.int8).reshape(-1, k) for c in ("at_s", "at_o"))
            more = np.flatnonzero(x.twice.notna())
            if len(more):
                n[more] -= _dense(x.twice.iloc[more], k)
            n[row, sig] -= np.where(x.alone, 2, 1).astype(np.int8)
            n[friends[sig] == 0] = 0
            yield x[["s", "st", "o", "dt", "sig"]].assign(around=_bits(np.stack([n >= 1, n >= 2], 1)))

    return run


def _beyond(k: int, friends: np.ndarray):
    """Per vertex and kind (sig, around) of its edges: for each signature, what the other edges of that signature at the
    vertex have around them, which is what an edge of that kind shares with the vertex at its other end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out: list[tuple] = []
            for at, sigs, arounds, ns in zip(x["at"], x["sigs"], x["arounds"], x["ns"]):
                sig, row = np.asarray(sigs, np.int32), np.arange(len(sigs))
                bits = _unpacked(b"".join(arounds), k).reshape(-1, 2, k).astype(np.int64)
                center, of = np.unique(sig, return_inverse=True)
                have = np.zeros((len(center), 2, k), np.int64)
                np.add.at(have, of, bits * np.asarray(ns)[:, None, None])
                # a block of kinds at a time bounds what is held for a vertex of many
                for lo in range(0, len(sig), 64):
                    r, s, o = row[lo : lo + 64], sig[lo : lo + 64], of[lo : lo + 64]
                    i = np.arange(len(r))
                    m = np.repeat(have[None], len(r), 0)
                    m[i, o] -= bits[r]
                    got = m[:, :, 0] > 0
                    got[i, :, s] = m[i, :, 1, s] > 0
                    got &= friends[s][:, center, None] > 0
                    keep, packed = got.any(2), np.packbits(got, axis=-1)
                    for j in np.flatnonzero(keep.any(1)):
                        out.append((at, int(s[j]), arounds[r[j]], center[keep[j]].tobytes(), packed[j, keep[j]].tobytes()))
            yield pd.DataFrame(out, columns=["at", "sig", "around", "centers", "given"])

    return run


def _triples_around(sig: int, around: bytes, k: int) -> np.ndarray:
    """Codes of the sorted triples that an edge is the middle of."""
    once, twice = _unpacked(around, k)
    g = np.flatnonzero(once)
    a, b = np.triu_indices(len(g))
    keep = (a != b) | (twice[g[a]] > 0)
    return _codes(np.full(keep.sum(), sig), g[a[keep]], g[b[keep]], k)


def _codes(a, b, c, k: int) -> np.ndarray:
    x = np.sort(np.stack([a, b, c]).astype(np.int64), axis=0)
    return np.unique((x[0] * k + x[1]) * k + x[2])


def _images(k: int, cells: int = 1 << 23):
    """Per task: (t, code, n), how many of its vertices of type t are in an instance of each triple. So many vertices at a time
    have a row of bits, one for each possible triple; of more triples than ``cells`` those that occur are sorted."""
    size = k * (k + 1) * (k + 2) // 6
    step = max(1, cells // size) if size <= cells else 64

    def triples(x: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of each row's triples. A part has a signature, and others each with a bit set of thirds."""
        n = [len(y) for y in x["sigs"]]
        row, sig = np.repeat(np.arange(len(x)), n), np.concatenate([np.asarray(y, np.int64) for y in x["sigs"]])
        center, data = [c for y in x["centers"] for c in y], [c for y in x["datas"] for c in y]
        own, far = (np.array([i for i, c in enumerate(center) if (c is None) == is_own], np.int64) for is_own in (True, False))
        around = _unpacked(b"".join(data[i] for i in own), k).reshape(-1, 2, k)
        part, second = np.nonzero(around[:, 0])
        thirds = around[part, 0]
        thirds[np.arange(len(part)), second] = around[part, 1, second]
        far_part = np.repeat(far, [len(center[i]) // 4 for i in far])
        at = np.concatenate([own[part], far_part])
        second = np.concatenate([second, np.frombuffer(b"".join(center[i] for i in far), np.int32)])
        line, third = np.nonzero(np.concatenate([thirds, _unpacked(b"".join(data[i] for i in far), k)]))
        a, b = sig[at][line], second[line]
        low, high = np.minimum(a, b), np.maximum(a, b)
        most, mid = np.maximum(high, third), np.maximum(low, np.minimum(high, third))
        least = np.minimum(low, third)
        return row[at][line], most * (most + 1) * (most + 2) // 6 + mid * (mid + 1) // 2 + least

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count: dict[str, np.ndarray] = {}
        more: dict[str, pd.Series] = {}
        for batch in batches:
            for lo in range(0, len(batch), step):
                x = batch.iloc[lo : lo + step]
                row, place = triples(x)
                types = x["t"].to_numpy()
                if size <= cells:
                    marks = np.zeros((len(x), size), bool)
                    marks[row, place] = True
                    for t in set(types):
                        count[t] = count.get(t, 0) + marks[types == t].sum(0)
                else:
                    row, place = np.divmod(np.unique(row * size + place), size)
                    for t in set(types):
                        more[t] = more.get(t, pd.Series(dtype=np.int64)).add(pd.Series(place[types[row] == t]).value_counts(), fill_value=0)
        for t, got in [*count.items(), *more.items()]:
            at = np.flatnonzero(got) if size <= cells else got.index.to_numpy()
            yield pd.DataFrame({"t": t, "place": at, "n": np.asarray(got)[at] if size <= cells else got.to_numpy().astype(np.int64)})

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        triangle, tetra = (np.array([n * (n + 1) // 2 for n in range(k + 1)]), np.array([n * (n + 1) * (n + 2) // 6 for n in range(k + 1)]))
        for x in run(batches):
            rest = x.place.to_numpy(np.int64)
            most = np.searchsorted(tetra, rest, "right") - 1
            rest = rest - tetra[most]
            mid = np.searchsorted(triangle, rest, "right") - 1
            yield pd.DataFrame({"t": x.t, "code": ((rest - triangle[mid]) * k + mid) * k + most, "n": x.n})

    return coded


def _mine_triples(typed: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """``mine`` up to three edges: two growths, where an edge, the middle, is in a frequent pair with either of two others.

    No instance is formed. An edge is the middle of (sig, f, g) if it has such edges around it; a vertex is in one as an end of
    the middle, or through an edge f whose other end has a middle other than f with g around it. What is around an edge, and
    what a vertex hands on, are bit sets of signatures, made distinct at vertices before they are handed on and counted.
    """
    one, two, code, coded = _mined_pairs(typed, least)
    found, links = _found(one, two)
    names = code.orderBy("k").toPandas()  # the frequent signatures and, below, their frequent pairs
    k, number = len(names), {p: i for i, p in enumerate(names.pattern)}
    friends = np.zeros((k, k), np.uint8)
    for a, b in two.select("a", "b").toPandas().itertuples(index=False):
        friends[number[a], number[b]] = friends[number[b], number[a]] = 1
    if not friends.any():
        return found, links
    edges = stored(coded)
    # no more than two edges of a signature lie between two vertices, so four at a vertex are as good as more
    listed = lambda df, *at: df.groupBy(*at, "sig").agg((F.col("sig") * 8 + F.least(F.count(F.lit(1)), F.lit(4))).cast("int").alias("x")).groupBy(*at)
    at = F.explode(F.array_distinct(F.array("s", "o"))).alias("at")
    there = listed(edges.select("sig", at), "at").agg(F.collect_list("x").alias("x"))
    there = stored(there.mapInPandas(_dense_rows(k), "at string, x binary"))
    between = listed(edges.where("s != o").select("sig", F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")), "a", "b").agg(F.collect_list("x").alias("twice"))
    between = few(checkpointed(between.where("size(twice) > 1 or twice[0] % 8 > 1")))
    x = edges.join(there.select(F.col("at").alias("s"), F.col("x").alias("at_s")), "s").join(there.select(F.col("at").alias("o"), F.col("x").alias("at_o")), "o")
    x = x.withColumn("a", F.least("s", "o")).withColumn("b", F.greatest("s", "o")).join(between, ["a", "b"], "left")
    # a loop's one vertex counts once; an edge without another beside it is counted at both ends
    x = x.select("s", "st", "o", "dt", "sig", "at_s", F.when(F.col("s") != F.col("o"), F.col("at_o")).alias("at_o"), "twice", (F.col("twice").isNull() & (F.col("s") != F.col("o"))).alias("alone"))
    around = stored(x.mapInPandas(_around(k, friends), "s string, st string, o string, dt string, sig int, around binary"))
    own = around.select("sig", "around", "s", "o", F.explode(F.array_distinct(F.array(F.struct(F.col("s").alias("v"), F.col("st").alias("t")), F.struct(F.col("o").alias("v"), F.col("dt").alias("t"))))).alias("e"))
    own = own.select(F.col("e.v").alias("at"), F.col("e.t").alias("t"), "sig", "around")
    kinds = stored(own.repartition("at").groupBy("at", "t", "sig", "around").agg(F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("n")))
    lists = lambda *cs: [F.col("all")[c].alias(c + "s") for c in cs]
    per = kinds.groupBy("at").agg(F.collect_list(F.struct("sig", "around", "n")).alias("all")).select("at", *lists("sig", "around", "n"))
    handed = per.mapInPandas(_beyond(k, friends), "at string, sig int, around binary, centers binary, given binary")
    to = lambda a, b, t: around.where("s != o").select(F.col(a).alias("at"), F.col(b).alias("v"), F.col(t).alias("t"), "sig", "around")
    got = to("o", "s", "st").unionByName(to("s", "o", "dt")).join(handed, ["at", "sig", "around"]).select("v", "t", "sig", "centers", F.col("given").alias("data"))
    part = got.unionByName(kinds.select(F.col("at").alias("v"), "t", "sig", F.lit(None).cast("binary").alias("centers"), F.col("around").alias("data")))
    whole = part.repartition("v").distinct().groupBy("v", "t").agg(F.collect_list(F.struct("sig", F.col("centers").alias("center"), "data")).alias("all"))
    count = whole.select("t", *lists("sig", "center", "data")).mapInPandas(_images(k), "t string, code long, n long")
    support = count.groupBy("t", "code").agg(F.sum("n").alias("n")).groupBy("code").agg(F.min("n").alias("support")).where(F.col("support") >= least)
    name = lambda c: F.col("names")[c.cast("int")]
    all_names = typed.sparkSession.createDataFrame([(names.pattern.tolist(),)], "names array<string>")  # one row
    digits = [F.floor(F.col("code") / (k * k)), F.floor(F.col("code") / k) % k, F.col("code") % k]
    three = support.crossJoin(F.broadcast(all_names)).select("code", F.concat_ws(JOINER, *[name(d) for d in digits]).alias("pattern"), F.lit(3).alias("size"), "support")
    three = checkpointed(three)

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for sig, data in zip(x.sig, x.around):
                codes = _triples_around(int(sig), bytes(data), k)
                digit = np.stack([codes // (k * k), codes // k % k, codes % k])
                # either of the two others is in a pair with the middle; where the middle occurs again, so is that
                for d in digit:
                    again = (digit == sig).sum(0) > 1
                    at = (d != sig) | again
                    yield pd.DataFrame({"a": np.minimum(d[at], sig).astype(np.int32), "b": np.maximum(d[at], sig).astype(np.int32), "code": codes[at]})

    small = around.select("sig", "around").distinct().mapInPandas(pairs, "a int, b int, code long").distinct()
    more = small.join(three.select("code", F.col("pattern").alias("joined")), "code").crossJoin(F.broadcast(all_names))
    more = more.select(F.concat_ws(JOINER, name(F.col("a")), name(F.col("b"))).alias("small"), "joined").distinct()
    return found.unionByName(three.select("pattern", "size", "support")), links.unionByName(more)


def followed(instances: DataFrame, limit: int) -> DataFrame:
    """(pattern, n): how many pairs of one-edge instances ``grow`` forms with this ``edge_limit``. Edges are sorted at each
    vertex and see those that follow; only pairs that meet at two vertices are kept to be made distinct."""
    e = _ends(instances)
    order = F.concat_ws("|", "s", "sig", "o")
    w = W.partitionBy("at").orderBy(order)
    after = [F.lead(F.struct("s", "sig", "o"), k).over(w).alias(f"x{k}") for k in range(1, limit + 1)]
    pair = e.select("s", "sig", "o", *after).select("s", "sig", "o", F.explode(F.array(*[f"x{k}" for k in range(1, limit + 1)])).alias("x")).where("x is not null")
    twice = (F.least("s", "o") == F.least("x.s", "x.o")) & (F.greatest("s", "o") == F.greatest("x.s", "x.o"))
    pair = pair.withColumn("twice", twice).select(_pair_pattern("sig", "x.sig").alias("pattern"), "twice", "s", "sig", "o", "x")
    count = F.count(F.lit(1)).alias("n")
    n = pair.where("not twice").groupBy("pattern").agg(count).unionByName(pair.where("twice").drop("twice").distinct().groupBy("pattern").agg(count))
    return n.groupBy("pattern").agg(F.sum("n").alias("n"))


def mine(typed: DataFrame, least: int, largest: int = 2, current=None, edge_limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pattern, size, support) of the frequent patterns of up to about ``largest`` edges, and (small, joined) pairs."""
    size = lambda c: F.size(F.split(c, " \\+ "))
    if doublings(largest) == 1 and current is None and edge_limit is None:
        return _mine_pairs(typed, least)
    if doublings(largest) == 2 and current is None and edge_limit is None:
        return _mine_triples(typed, least)
    now = checkpointed(edge_instances(typed))
    counted = support(now)
    now, found, links = frequent_only(now, counted, least), counted.where(F.col("support") >= least), None
    for turn in range(doublings(largest)):
        new, link = grow(now, "vertex" if turn == 0 else "edge", current, edge_limit)
        new = checkpointed(new)
        counted = checkpointed(support(new).where(F.col("support") >= least))
        known = found
        found = found.unionByName(counted.join(known.select("pattern"), "pattern", "left_anti"))
        link = link.join(counted.select(F.col("pattern").alias("joined")), "joined", "left_semi").select("small", "joined")
        links = link if links is None else links.unionByName(link)
        now = now.unionByName(frequent_only(new, counted, least).select(*now.columns))
    if links is None:
        links = found.limit(0).select(F.col("pattern").alias("small"), F.col("pattern").alias("joined"))
    return found.select("pattern", size("pattern").alias("size"), "support"), links.distinct()


def status(patterns: DataFrame, links: DataFrame) -> DataFrame:
    """(pattern, support, status): ``redundant`` if every frequent pattern it grows into has its support, ``closed`` if
    none has (or there is none), else ``promising``."""
    big = patterns.select(F.col("pattern").alias("joined"), F.col("support").alias("big"))
    small = patterns.select(F.col("pattern").alias("small"), "support")
    vote = links.join(small, "small").join(big, "joined").groupBy("small").agg(
        F.bool_and(F.col("support") == F.col("big")).alias("every"), F.bool_or(F.col("support") == F.col("big")).alias("some")
    )
    word = F.when(F.col("every"), "redundant").when(F.col("some"), "promising").otherwise("closed")
    return small.join(vote, "small", "left").select(F.col("small").alias("pattern"), "support", word.alias("status"))


def without_redundant(patterns: DataFrame, statuses: DataFrame) -> DataFrame:
    return patterns.join(statuses.where("status = 'redundant'").select("pattern"), "pattern", "left_anti")


def cumulative(history: DataFrame) -> DataFrame:
    """(pattern, support): supports summed over the batches."""
    return history.groupBy("pattern").agg(F.sum("support").alias("support"))


def per_batch_support(typed: DataFrame, window: int = 1) -> DataFrame:
    """(batch, pattern, support) of one-edge patterns, each batch with the ``window - 1`` before it.

    Images are made distinct at their vertex and spread over the windows there, so neither an edge nor an image is shuffled
    by its batch, of which there are few. The result, a row for each batch and pattern, is kept for who reads it twice.
    """
    sig = F.concat_ws("|", "st", "p", "dt")
    ends = F.array(F.struct(F.col("st").alias("t"), F.col("s").alias("v")), F.struct(F.col("dt").alias("t"), F.col("o").alias("v")))
    image = typed.where("batch is not null").select("batch", sig.alias("pattern"), F.explode(ends).alias("x")).select("batch", "pattern", "x.*")
    image = image.repartition("v").distinct()
    if window == 1:
        image = image.withColumn("own", F.lit(True))
    else:
        spread = image.select("*", F.explode(F.sequence(F.col("batch"), F.col("batch") + window - 1)).alias("at"))
        image = spread.groupBy("at", "pattern", "t", "v").agg(F.bool_or(F.col("at") == F.col("batch")).alias("own")).withColumnRenamed("at", "batch")
    count = image.groupBy("batch", "pattern", "t").agg(F.count(F.lit(1)).alias("n"), F.bool_or("own").alias("own"))
    out = checkpointed(count.groupBy("batch", "pattern").agg(F.min("n").alias("support"), F.bool_or("own").alias("own")))
    # a batch is there if it has edges of its own
    return out.join(few(out.where("own").select("batch").distinct()), "batch", "left_semi").select("batch", "pattern", "support")
