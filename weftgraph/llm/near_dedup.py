"""Near-duplicate detection with HyperMinHash registers.

A document is its set of lower-case three-word shingles (punctuation ignored; a document of one or two words is
one shingle). Each shingle's hash picks one of 128 buckets; a bucket keeps its least value as a 16-bit float:
the count of leading zeros and the 10 bits after the first one. Three neighbouring registers and the number of
their band are one 64-bit integer, so banding needs no further hashing. Empty registers borrow from others (optimal
densification) for banding only. Two sets of Jaccard similarity 0.5 share one of the 42 bands with probability 0.996.

All members of a bucket are compared with its most central member: first by the share of equal registers, corrected
by the collisions that two unrelated sets of these sizes would have, then by exact Jaccard similarity of their
shingle sets. Where members still lie in different components, the next central member is the leader of another
round; after ``STARS`` rounds all those members are compared with each other, in blocks of about ``BLOCK``. So any
two sets that share a band are compared or already lie in one component: no bucket is capped and no pair is skipped.
One of n copies costs n comparisons.

Sets that are equal are one node from the start, so thousands of exact copies are one row in all of this. Counts,
leaders and least roots of a bucket come from partial aggregates; a hot bucket is split by AQE in the joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE, NOT_ALNUM, cut, keyed, long_array, mix, packed, prefix, real_id, slices, span_hash, unpacked, words

REGISTERS, MANTISSA, BAND = 128, 10, 3
STARS, BLOCK = 2, 512
THRESHOLD = 0.5
MARGIN = 0.15  # over three standard deviations of the estimate with 128 registers
_EMPTY = np.uint16(0xFFFF)
_BITS = 57  # of a hash after the bucket's seven
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def lowered(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.set_column(batch.schema.get_field_index("text"), "text", pc.utf8_lower(batch.column("text")))


def shingle_sets(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    start, end, first = words(data, at, NOT_ALNUM)
    h = span_hash(prefix(BYTE[data]), start, end)
    tri = np.zeros(len(h), np.uint64)
    if len(h) > 2:
        tri[:-2] = mix(h[:-2] * _M[0] + h[1:-1] * _M[1] + h[2:] * _M[2])
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= 3:
            out.append(np.unique(tri[lo : hi - 2]))
        elif hi > lo:
            out.append(mix(np.array([np.sum(h[lo:hi] * np.array(_M[: hi - lo], np.uint64), dtype=np.uint64)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(rows, REGISTERS) of leading zeros and mantissa; _EMPTY where no shingle fell."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    least = np.full(len(sets) * REGISTERS, np.uint64(0xFFFFFFFFFFFFFFFF))
    bucket = (flat & np.uint64(REGISTERS - 1)).astype(np.int64)
    np.minimum.at(least, np.repeat(np.arange(len(sets)), sizes) * REGISTERS + bucket, flat >> np.uint64(7))
    empty = least == np.uint64(0xFFFFFFFFFFFFFFFF)
    value = np.where(empty, np.uint64(1), least)
    top = np.frexp(np.maximum(value >> np.uint64(26), np.uint64(1)).astype(np.float64))[1] - 1 + 26
    low = np.frexp(np.maximum(value, np.uint64(1)).astype(np.float64))[1] - 1
    top = np.where(value >> np.uint64(26) > 0, top, low)  # position of the first one; exact, as each part has under 53 bits
    zeros = np.minimum(_BITS - 1 - top, 62)
    shift = (top - MANTISSA).astype(np.int64)
    mantissa = np.where(shift >= 0, value >> np.maximum(shift, 0).astype(np.uint64), value << np.maximum(-shift, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    out = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    out[empty] = _EMPTY
    return out.reshape(len(sets), REGISTERS)


def densified(regs: np.ndarray) -> np.ndarray:
    """Each empty register takes over one at a place that depends on its own place and the attempt only."""
    out, attempt = regs.copy(), 0
    live = (regs != _EMPTY).any(axis=1)
    while (gap := (out[live] == _EMPTY)).any():
        attempt += 1
        at = np.random.default_rng(attempt).integers(0, REGISTERS, REGISTERS)
        part = out[live]
        out[live] = np.where(gap, regs[live][:, at], part)
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """(rows, bands): the registers of a band behind its number; what is left over after the last band isn't used."""
    many = REGISTERS // BAND
    part = regs[:, : many * BAND].reshape(len(regs), many, BAND).astype(np.uint64)
    key = np.broadcast_to(np.arange(many, dtype=np.uint64), part.shape[:2]).copy()
    for k in range(BAND):
        key = key << np.uint64(16) | part[:, :, k]
    return key


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers, without the collisions to be expected of unrelated sets."""
    some = (a != _EMPTY) | (b != _EMPTY)
    equal = ((a == b) & some).sum(axis=1)
    z = np.arange(0, 56)
    high, low = 2.0 ** -(z + 7), 2.0 ** -(z + 8)  # a register is at level z if the least value lies between these shares

    def level(k):
        k = k[:, None].astype(float)
        return np.exp(k * np.log1p(-low)) - np.exp(k * np.log1p(-high))

    chance = (level(n) * level(m)).sum(axis=1) * REGISTERS / 2**MANTISSA
    union = np.maximum(some.sum(axis=1), 1)
    return np.clip((equal - chance) / np.maximum(union - chance, 1), 0, 1)


def _signatures(batches):
    for batch in batches:
        for part, data, at in slices(lowered(batch)):
            sets = shingle_sets(data, at)
            regs = registers(sets)
            bands = band_keys(densified(regs))
            width = bands.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("tag"),
                    long_array(_node(sets)),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([r.tobytes() for r in regs], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * width, pa.int32()), long_array(bands.reshape(-1))),
                ],
                ["doc_id", "tag", "node", "n", "regs", "bands"],
            )


def _estimated(batches):
    for b in batches:
        if len(b):
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(len(b), REGISTERS) for c in ("regs", "leader_regs"))
            e = estimate(x, y, b.column("n").to_numpy(), b.column("leader_n").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("leader"), pa.array(e)], ["node", "leader", "estimate"])


def _verified(batches):
    for b in batches:
        out = np.zeros(len(b))
        for i in range(len(b)):  # one pair of sets at a time, straight from the batch
            x, y = (np.frombuffer(b.column(c)[i].as_buffer(), np.uint32) for c in ("shingles", "leader_shingles"))
            both = len(np.intersect1d(x, y, assume_unique=True))
            out[i] = both / (len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([b.column("node"), b.column("leader"), pa.array(out)], ["node", "leader", "jaccard"])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the least node of each connected component, for every node with an edge.

    Alternates the large-star and small-star steps, so the number of rounds is logarithmic whatever the shape. The
    least neighbours come from partial aggregates and have a shuffle of their own, so AQE can split a hub in the join.
    """
    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    def least(e: DataFrame) -> DataFrame:
        return e.join(cut(e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))), "u")

    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    was = state(e)
    while True:
        large = least(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))).where("v > u")
        small = least(cut(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()))
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = cut(small.select("x.*").where("u != v").distinct())
        if (now := state(e)) == was:
            break
        was = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _compared(threshold: float, at_once: int = 100_000):
    """Pairs of each group that lie in different components and may be similar; rows come by group, of two blocks at most."""

    def compare(rows: list) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        key, i, j, mine, node, root, n = (t.column(c).to_numpy() for c in ("key", "i", "j", "mine", "node", "root", "n"))
        x = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        head = np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
        start = np.flatnonzero(head)
        end = np.repeat(np.append(start[1:], len(key)), np.diff(np.append(start, len(key))))
        many = end - np.arange(len(key)) - 1  # partners that follow
        upto = np.append(0, np.cumsum(many))
        out, lo = [[np.zeros(0, np.int64)] * 2 + [np.zeros(0)]], 0
        while lo < len(key):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + at_once, "right")) - 1)
            a = np.repeat(np.arange(lo, hi), many[lo:hi])
            b = a + 1 + np.arange(len(a)) - (upto[a] - upto[lo])
            k = (root[a] != root[b]) & ((i[a] == j[a]) | (mine[a] != mine[b]))
            a, b = a[k], b[k]
            if len(a):
                e = estimate(x[a], x[b], n[a], n[b])
                k = e >= threshold - MARGIN
                out.append([node[a[k]], node[b[k]], e[k]])
            lo = hi
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["node", "leader", "estimate"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            n += len(b)
            last = np.stack([b.column(c).to_numpy() for c in ("key", "i", "j")])
            change = np.flatnonzero((last[:, 1:] != last[:, :-1]).any(axis=0))
            if n >= 4 * BLOCK and len(change):
                done = int(change[-1]) + 1
                held[-1] = b.slice(0, done)
                yield compare(held)
                held, n = [b.slice(done)], len(b) - done
        if n:
            yield compare(held)

    return run


def _edges(nodes: DataFrame, shingles, threshold: float) -> DataFrame | None:
    """Verified (node, leader) pairs; ``shingles`` gives the sets of the nodes it is handed."""
    rows = nodes.select("node", F.explode("bands").alias("key"))
    shared = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("mates")).where("mates > 1"))
    rows = cut(rows.join(shared, "key"))
    if rows.isEmpty():
        return None
    # central members first: the original of many copies has the most mates
    central = rows.groupBy("node").agg(F.sum("mates").alias("weight"))
    left = cut(rows.select("node", "key").join(central, "node"))
    sets = cut(shingles(central.select("node")))
    other = sets.select(F.col("node").alias("leader"), F.col("shingles").alias("leader_shingles"))
    ends = nodes.select("node", "n", "regs")
    lead = ends.select(F.col("node").alias("leader"), F.col("n").alias("leader_n"), F.col("regs").alias("leader_regs"))

    def verified(near: DataFrame) -> DataFrame:
        both = near.select("node", "leader").distinct().join(sets, "node").join(other, "leader")
        return cut(both.mapInArrow(_verified, "node long, leader long, jaccard double").where(F.col("jaccard") >= threshold))

    edges, roots = None, None
    for turn in range(STARS):
        if roots is not None:
            left = _still_open(left, roots)
        best = cut(left.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("best")).select("key", F.col("best.node").alias("leader")))
        led = left.join(best, "key")
        pairs = led.where("node != leader")
        if roots is not None:
            own = roots.select(F.col("node").alias("leader"), F.col("root").alias("leader_root"))
            pairs = pairs.join(own, "leader", "left").where("root != coalesce(leader_root, leader)")
        pairs = pairs.select("node", "leader").distinct().join(ends, "node").join(lead, "leader")
        found = verified(pairs.mapInArrow(_estimated, "node long, leader long, estimate double").where(F.col("estimate") >= threshold - MARGIN))
        edges = found if edges is None else edges.unionByName(found)
        roots = cut(components(edges, "node", "leader"))
        left = cut(led.where("node != leader").select("node", "key", "weight"))  # a leader has been compared with its whole bucket
        if left.isEmpty():
            return edges
    open_ = _still_open(left, roots)
    size = cut(open_.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")))
    open_ = open_.join(size, "key").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")))
    open_ = open_.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    open_ = open_.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "root").join(ends, "node")
    open_ = open_.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    near = open_.select("key", "i", "j", "mine", "node", "root", "n", "regs").mapInArrow(_compared(threshold), "node long, leader long, estimate double")
    return edges.unionByName(verified(near))


def _still_open(left: DataFrame, roots: DataFrame) -> DataFrame:
    """The members, with their roots, of the buckets whose members lie in different components."""
    rooted = cut(left.select("node", "key", "weight").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    mixed = cut(rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key"))
    return cut(rooted.join(mixed, "key"))


def _node(sets: list[np.ndarray]) -> np.ndarray:
    """Names a shingle set by the sum of its hashes and its size."""
    return mix(np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64) + np.array([len(s) for s in sets], np.uint64))


def _small_sets(batches):
    for batch in batches:
        for _, data, at in slices(lowered(batch)):
            sets = shingle_sets(data, at)
            small = [np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([long_array(_node(sets)), pa.array(small, pa.binary())], ["node", "shingles"])


def near_groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, tag, root struct<doc_id, tag>): every document with words and the least one of its group."""
    text = keyed(docs)
    made = text.mapInArrow(_signatures, "doc_id long, tag long, node long, n int, regs binary, bands array<long>")
    signed = cut(made.where("n > 0"))
    least = F.min(F.struct("doc_id", "tag")).alias("least")
    nodes = cut(signed.groupBy("node").agg(least, *[F.first(c).alias(c) for c in ("n", "regs", "bands")]))

    def shingles(wanted: DataFrame) -> DataFrame:
        mine = text.join(nodes.join(wanted, "node").select("least.*"), ["doc_id", "tag"], "left_semi").select("text")
        return mine.mapInArrow(_small_sets, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))

    edges = _edges(nodes, shingles, threshold)
    rooted = nodes.select("node", F.col("least").alias("root"))
    if edges is not None:
        comp = cut(components(edges, "node", "leader").join(nodes.select("node", "least"), "node"))
        shared = cut(comp.groupBy("root").agg(F.min("least").alias("shared")))
        comp = comp.select("node", F.col("root").alias("of")).join(shared.withColumnRenamed("root", "of"), "of").select("node", "shared")
        rooted = rooted.join(comp, "node", "left").select("node", F.coalesce("shared", "root").alias("root"))
    return signed.select("doc_id", "tag", "node").join(cut(rooted), "node").select("doc_id", "tag", "root")


def _others(docs: DataFrame, threshold: float) -> DataFrame:
    return cut(near_groups(docs, threshold).where(F.struct("doc_id", "tag") != F.col("root")).distinct())


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, duplicate_of): every document of a group of near-duplicates but the one with the least doc_id.

    Texts without a letter or digit (null and empty ones too) are near nothing. Equal texts are near each other, and
    similarity of just ``threshold`` is near. Texts of any length are read whole.
    Rows that repeat doc_id and text are one document; rows that share only the doc_id are different documents.
    A null doc_id sorts first and stays null. An empty table gives no rows; further columns are not read.
    """
    return _others(docs, threshold).select(real_id(), F.col("root.doc_id").alias("duplicate_of")).select("doc_id", real_id("duplicate_of"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that ``near_duplicates`` lists; the columns are those of ``docs``, whatever their names.

    Null and empty texts stay. Rows that repeat doc_id and text share their fate. Texts of any length are read whole.
    An empty table stays empty.
    """
    rows = keyed(docs, packed(docs).alias("row")).select("doc_id", "tag", "row")
    gone = _others(docs, threshold).select("doc_id", "tag")
    return unpacked(rows.join(gone, ["doc_id", "tag"], "left_anti"), "row", docs.columns)
