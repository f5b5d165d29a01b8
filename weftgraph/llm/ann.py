"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

The graph holds every row and starts from rows that lie side by side along a few random directions. Each round joins
every vertex's neighbours, forward and backward, with each other: whatever two of them are closer than what either
has so far becomes a candidate, and the best ``width`` of old and new neighbours stay. Only pairs with a neighbour
that is new since the last round are looked at, and the rounds end when few entries still change.

A vertex is one row: its vector as 8-bit codes under a scale of its own, and its list as packed bytes. A round is two
shuffles of lists and one of codes: vertices are hashed to blocks, and a block is sent each code its vertices refer to
once, instead of one for each edge. A block's memory is bounded by its vertices' lists and the length of vectors.

Search starts from a query's own list and is greedy: the nearest vertices not yet expanded are expanded, a block of
queries at a time, until the best ``pool`` of each query have been. Distances of codes guide both; the best
``RERANK * k`` of a query are measured again by the vectors themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, cut

K, WIDTH, POOL = 10, 20, 600
DIRECTIONS, CHUNK, BLOCK, RERANK = 4, 256, 8192, 4
STILL = 0.25  # NN-descent ends when at most this share of all entries is new; the search finds the rest
AT_ONCE = 96
LARGEST = 1e17  # a component beyond it has no square in 32 bits that could be summed
ENTRY = np.dtype([("nbr", "<i8"), ("dist", "<f4"), ("new", "u1")])
LINK = np.dtype([("u", "<i8"), ("new", "u1")])
_LIST = "id long, code binary, blob binary"


def _packed(col, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a binary column, one after the other, and how many each row has; null has none."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.binary())
    if not len(col):
        return np.zeros(0, dtype), np.zeros(0, np.int64)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]].view(dtype), np.diff(at) // dtype.itemsize


def _blobs(entries: np.ndarray, counts: np.ndarray) -> pa.Array:
    at = np.append(0, np.cumsum(counts * entries.dtype.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(entries).tobytes())])


def _lists(ids: np.ndarray, nbr: np.ndarray, dist: np.ndarray) -> pa.RecordBatch:
    """Candidates as packed lists, one row a run of equal ids."""
    start = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
    entries = np.empty(len(ids), ENTRY)
    entries["nbr"], entries["dist"], entries["new"] = nbr, dist, 1
    rows = [pa.array(ids[start].astype(np.int64)), pa.nulls(len(start), pa.binary()), _blobs(entries, np.diff(np.append(start, len(ids))))]
    return pa.RecordBatch.from_arrays(rows, ["id", "code", "blob"])


def encode(x: np.ndarray) -> np.ndarray:
    """Rows of a scale (four bytes) and one signed byte a component."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-30).astype(np.float32) / 127
    code = np.rint(x / scale[:, None]).astype(np.int8).view(np.uint8)
    return np.hstack([scale.view(np.uint8).reshape(-1, 4), code])


def _decode(col) -> np.ndarray:
    raw, n = _packed(col, np.dtype(np.uint8))
    raw = raw.reshape(len(n), -1) if len(n) else np.zeros((0, 4), np.uint8)
    scale = np.ascontiguousarray(raw[:, :4]).view(np.float32)
    return raw[:, 4:].view(np.int8).astype(np.float32) * scale


def vectors(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, vec, code): one row an id, the vector as float32 bytes and as codes.

    Left out: null ids, and vectors that are null or empty, hold a null, NaN, infinity or a component beyond 1e17, or
    have another length than most have (of lengths that as many have, the least).
    """
    rows = table.select(column(id_column).cast("long").alias("id"), column(vector_column).cast("array<float>").alias("v"))
    rows = rows.where(f"id is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) > {LARGEST:.0e})")
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").select("n").first()
    rows = rows.where(F.size("v") == F.lit(usual[0] if usual else 0)).groupBy("id").agg(F.min("v").alias("v"))

    def run(batches):
        for b in batches:
            if len(b):
                v = b.column("v")
                x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(b), -1)
                raw, code = np.ascontiguousarray(x).view(np.uint8), encode(x)
                rows = [_blobs(y.reshape(-1), np.full(len(b), y.shape[1])) for y in (raw, code)]
                yield pa.RecordBatch.from_arrays([b.column("id"), *rows], ["id", "vec", "code"])

    return rows.mapInArrow(run, "id long, vec binary, code binary")


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of stacks of matrices."""
    xx, yy = (x * x).sum(-1), (y * y).sum(-1)
    return np.maximum(xx[..., :, None] + yy[..., None, :] - 2 * np.matmul(x, np.swapaxes(y, -1, -2)), 0)


def _neighbours_in_order(width: int, size: int):
    """The nearest of each ``size`` rows that lie side by side."""

    def pairs(ids, x):
        d = _squares(x, x)
        np.fill_diagonal(d, np.inf)
        k = min(width, len(ids) - 1)
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        return _lists(np.repeat(ids, k), ids[near].reshape(-1), np.take_along_axis(d, near, 1).reshape(-1))

    def run(batches):
        ids, x = np.zeros(0, np.int64), None
        for b in batches:
            if not len(b):
                continue
            more = _decode(b.column("code"))
            ids, x = np.append(ids, b.column("id").to_numpy()), more if x is None else np.concatenate([x, more])
            lo = 0
            while len(ids) - lo >= 2 * size:
                yield pairs(ids[lo : lo + size], x[lo : lo + size])
                lo += size
            ids, x = ids[lo:], x[lo:]
        if len(ids) > 1:
            yield pairs(ids, x)

    return run


def _project(direction: int):
    def run(batches):
        for b in batches:
            if len(b):
                x = _decode(b.column("code"))
                p = x @ np.random.default_rng(direction).standard_normal(x.shape[1]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("code"), pa.array(p)], ["id", "code", "at"])

    return run


def _nearest(ids: np.ndarray, e: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest ``width`` distinct neighbours of each id, by id; an entry that was there stays old."""
    o = np.lexsort((e["new"], e["nbr"], ids))
    ids, e = ids[o], e[o]
    first = np.append(True, (ids[1:] != ids[:-1]) | (e["nbr"][1:] != e["nbr"][:-1]))[: len(ids)]
    ids, e = ids[first], e[first]
    o = np.lexsort((e["nbr"], e["dist"], ids))
    ids, e = ids[o], e[o]
    start = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))[: len(ids)]
    k = np.arange(len(ids)) - np.repeat(start, np.diff(np.append(start, len(ids)))) < width
    return ids[k], e[k]


def _keep(width: int, flush_rows: int = 20_000):
    """Unites the lists of an id; rows come by id, one of them with the code."""

    def best(rows):
        table = pa.Table.from_batches(rows)
        ids = table.column("id").to_numpy()
        e, n = _packed(table.column("blob"), ENTRY)
        own, e = _nearest(np.repeat(ids, n), e, width)
        coded = table.filter(table.column("code").is_valid())
        who = coded.column("id").to_numpy()
        lo, hi = np.searchsorted(own, who), np.searchsorted(own, who, "right")
        full = hi - lo >= width
        limit = np.full(len(who), np.inf, np.float32)
        limit[full] = e["dist"][hi[full] - 1]
        fresh = np.append(0, np.cumsum(e["new"], dtype=np.int64))
        return pa.RecordBatch.from_arrays(
            [pa.array(who), pa.concat_arrays(coded.column("code").chunks), _blobs(e, hi - lo), pa.array(limit), pa.array((fresh[hi] - fresh[lo]).astype(np.int32))],
            ["id", "code", "blob", "limit", "fresh"],
        )

    def run(batches):
        held, n = [], 0
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            n += len(b)
            if n >= flush_rows:
                ids = b.column("id").to_numpy()
                done = int(np.searchsorted(ids, ids[-1]))
                if done:
                    held[-1] = b.slice(0, done)
                    yield best(held)
                    held, n = [b.slice(done)], len(b) - done
        if n:
            yield best(held)

    return run


def _kept(codes: DataFrame, lists: DataFrame, width: int) -> DataFrame:
    """(id, code, blob, limit, fresh): every vertex with its list, the distance to beat, and how many entries are new."""
    rows = codes.select("id", "code", F.lit(None).cast("binary").alias("blob")).unionByName(lists) if codes is not lists else lists
    return cut(rows.repartition("id").sortWithinPartitions("id").mapInArrow(_keep(width), _LIST + ", limit float, fresh int"))


def _adjacent(width: int, turn: int):
    """Both directions of each edge, by vertex; of the backward ones the new before the old and then in a random order."""

    def run(batches):
        for b in batches:
            ids = b.column("id").to_numpy()
            e, n = _packed(b.column("blob"), ENTRY)
            src = np.repeat(ids, n)
            out = np.empty(len(e), LINK)
            out["u"], out["new"] = e["nbr"], e["new"]
            back, dst = np.empty(len(e), LINK), e["nbr"].copy()
            back["u"], back["new"] = src, e["new"]
            dst, back = _some(dst, back, width, turn)
            start = np.flatnonzero(np.append(True, dst[1:] != dst[:-1]))[: len(dst)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), _blobs(out, n), pa.nulls(len(ids), pa.binary())], ["v", "out", "back"])
            blobs = _blobs(back, np.diff(np.append(start, len(dst))))
            yield pa.RecordBatch.from_arrays([pa.array(dst[start]), pa.nulls(len(start), pa.binary()), blobs], ["v", "out", "back"])

    return run


def _some(v: np.ndarray, links: np.ndarray, width: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each v the first ``width`` links in an order that doesn't depend on how they are split over tasks."""
    mark = (links["u"].astype(np.uint64) ^ np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    o = np.lexsort((mark ^ (mark >> np.uint64(31)), 1 - links["new"].astype(np.int8), v))
    v, links = v[o], links[o]
    start = np.flatnonzero(np.append(True, v[1:] != v[:-1]))[: len(v)]
    k = np.arange(len(v)) - np.repeat(start, np.diff(np.append(start, len(v)))) < width
    return v[k], links[k]


def _members(width: int, turn: int, flush_rows: int = 50_000):
    """One row a vertex with all its members; rows come by block and vertex."""

    def best(rows):
        table = pa.Table.from_batches(rows)
        v = table.column("v").to_numpy()
        out, n = _packed(table.column("out"), LINK)
        back, m = _packed(table.column("back"), LINK)
        at, back = _some(np.repeat(v, m), back, width, turn)
        at, both = np.concatenate([np.repeat(v, n), at]), np.concatenate([out, back])
        o = np.lexsort((-both["new"].astype(np.int8), both["u"], at))  # a member that comes twice counts once, as new if it is
        at, both = at[o], both[o]
        first = np.append(True, (at[1:] != at[:-1]) | (both["u"][1:] != both["u"][:-1]))[: len(at)]
        at, both = at[first], both[first]
        start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))[: len(at)]
        return pa.RecordBatch.from_arrays([pa.array(at[start]), _blobs(both, np.diff(np.append(start, len(at))))], ["v", "blob"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            n += len(b)
            v = b.column("v").to_numpy()
            change = np.flatnonzero(v[1:] != v[:-1])
            if n >= flush_rows and len(change):
                done = int(change[-1]) + 1
                held[-1] = b.slice(0, done)
                yield best(held)
                held, n = [b.slice(done)], len(b) - done
        if n:
            yield best(held)

    return run


def adjacency(graph: DataFrame, blocks: int, width: int, turn: int) -> DataFrame:
    """(block, v, blob): each vertex's neighbours and at most ``width`` of those whose neighbour it is."""
    rows = graph.mapInArrow(_adjacent(width, turn), "v long, out binary, back binary")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(blocks))).repartition("block").sortWithinPartitions("block", "v").drop("block")
    return cut(rows.mapInArrow(_members(width, turn), "v long, blob binary").select(F.pmod(F.xxhash64("v"), F.lit(blocks)).alias("block"), "v", "blob"))


def _referred(batches):
    """The distinct members in each batch of each block."""
    for b in batches:
        e, n = _packed(b.column("blob"), LINK)
        block, u = np.repeat(b.column("block").to_numpy(), n), e["u"]
        o = np.lexsort((u, block))
        block, u = block[o], u[o]
        first = np.append(True, (u[1:] != u[:-1]) | (block[1:] != block[:-1]))[: len(u)]
        yield pa.RecordBatch.from_arrays([pa.array(block[first]), pa.array(u[first])], ["to", "id"])


def _local_join(width: int, at_once: int = 256):
    """Per block: every pair of a vertex's members of which one is new, if it beats what one of them has."""

    def run(links: pa.Table, known: pa.Table) -> pa.Table:
        if not len(links) or not len(known):
            return pa.Table.from_batches([_lists(*[np.zeros(0, np.int64)] * 3)])
        ids = known.column("id").to_numpy()
        o = np.argsort(ids)
        ids, x, limit = ids[o], _decode(known.column("code"))[o], known.column("limit").to_numpy()[o]
        e, size = _packed(links.column("blob"), LINK)
        u, new = np.searchsorted(ids, e["u"]), e["new"].astype(bool)
        start = np.cumsum(size) - size
        by_size = np.argsort(size, kind="stable")
        out, held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))], 0
        for lo in range(0, len(size), at_once):
            mine = by_size[lo : lo + at_once]
            most = int(size[mine].max())
            place = np.arange(most)
            real = place < size[mine, None]
            at = np.where(real, start[mine, None] + place, start[mine, None])
            member, fresh = u[at], new[at] & real
            y = x[member]
            d = _squares(y, y)
            ok = d < limit[member][:, :, None]
            ok &= fresh[:, :, None] | fresh[:, None, :]
            ok &= real[:, :, None] & real[:, None, :]
            ok[:, place, place] = False
            g, i, j = np.nonzero(ok)
            out.append((member[g, i], member[g, j], d[g, i, j]))
            held += len(g)
            if held > 4_000_000:
                out, held = [_shorten(out, width, len(ids))], 0
        a, b, d = _shorten(out, width, len(ids))
        return pa.Table.from_batches([_lists(ids[a], ids[b], d)])

    return run


def _shorten(parts, width: int, n: int):
    """The nearest ``width`` distinct candidates of each vertex."""
    a, b, d = (np.concatenate(x) for x in zip(*parts))
    o = np.unique(a * n + b, return_index=True)[1]
    a, b, d = a[o], b[o], d[o]
    o = np.lexsort((d, a))
    a, b, d = a[o], b[o], d[o]
    start = np.flatnonzero(np.append(True, a[1:] != a[:-1]))[: len(a)]
    k = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a)))) < width
    return a[k], b[k], d[k]


def _send(links: DataFrame, known: DataFrame) -> DataFrame:
    """(to, id, ...): each row that a block's members refer to, once a block."""
    return links.select("block", "blob").mapInArrow(_referred, "to long, id long").distinct().join(known, "id")


def _aged(batches):
    for b in batches:
        e, n = _packed(b.column("blob"), ENTRY)
        e = e.copy()
        e["new"] = 0
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("code"), _blobs(e, n)], ["id", "code", "blob"])


def block_size(width: int, length: int) -> int:
    """Vertices a block, so that the vectors of all their members take 256 MB at most."""
    return int(np.clip((1 << 26) // (2 * width * max(length, 1)), 64, BLOCK))


def neighbour_graph(vecs: DataFrame, width: int = WIDTH, still: float = STILL) -> DataFrame:
    """(id, code, blob, limit, fresh): the ``width`` nearest neighbours found of each vector."""
    size = vecs.agg(F.count(F.lit(1)), F.max(F.length("code"))).first()
    n, blocks = size[0], -(-max(size[0], 1) // block_size(width, size[1] or 0))
    lists = None
    for direction in range(DIRECTIONS):
        line = vecs.mapInArrow(_project(direction), "id long, code binary, at float").repartitionByRange("at", "id").sortWithinPartitions("at", "id")
        found = line.mapInArrow(_neighbours_in_order(width, CHUNK), _LIST)
        lists = found if lists is None else lists.unionByName(found)
    graph, turn = _kept(vecs, lists, width), 0
    while True:  # lists only ever get better, so this ends
        links = adjacency(graph, blocks, width, turn)
        needed = _send(links, graph.select("id", "code", "limit"))
        found = links.groupBy("block").cogroup(needed.groupBy("to")).applyInArrow(_local_join(width), _LIST)
        both = graph.select("id", "code", "blob").mapInArrow(_aged, _LIST).unionByName(found)
        graph, turn = _kept(both, both, width), turn + 1
        if (graph.agg(F.sum("fresh")).first()[0] or 0) <= still * n * width:
            return graph


def _front(q: np.ndarray, e: np.ndarray, pool: int, at_once: int) -> np.ndarray:
    """Which entries are expanded next: the nearest ``at_once`` that haven't been, among a query's best ``pool``; lists are in order."""
    start = np.flatnonzero(np.append(True, q[1:] != q[:-1]))[: len(q)]
    size = np.diff(np.append(start, len(q)))
    nth = np.arange(len(q)) - np.repeat(start, size)
    can = (e["new"] > 0) & (nth < pool)
    before = np.cumsum(can) - can
    return can & (before - np.repeat(before[start], size) < at_once)


def _open(pool: int, at_once: int):
    def run(batches):
        for b in batches:
            e, n = _packed(b.column("blob"), ENTRY)
            row = np.repeat(np.arange(len(b)), n)
            k = _front(row, e, pool, at_once)
            yield pa.RecordBatch.from_arrays([b.column("block").take(pa.array(row[k])), b.column("q").take(pa.array(row[k])), pa.array(e["nbr"][k])], ["block", "q", "c"])

    return run


def _advance(pool: int, at_once: int, step: int = 100_000):
    """Per block of queries: takes the members that were met into the lists."""

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        state = rows.filter(rows.column("code").is_valid()).combine_chunks()
        met = rows.filter(rows.column("code").is_null()).combine_chunks()
        q = state.column("q").to_numpy()
        o = np.argsort(q)
        state, q = state.take(pa.array(o)), q[o]
        e, n = _packed(state.column("blob"), ENTRY)
        e, row = e.copy(), np.repeat(np.arange(len(q)), n)
        e["new"][_front(row, e, pool, at_once)] = 0
        ids = known.column("id").to_numpy()
        o = np.argsort(ids)
        ids, x, y = ids[o], _decode(known.column("code"))[o], _decode(state.column("code"))
        links, m = _packed(met.column("blob"), LINK)
        at, u = np.repeat(np.searchsorted(q, met.column("q").to_numpy()), m), np.searchsorted(ids, links["u"])
        pair = np.unique(at * len(ids) + u)
        at, u = pair // max(len(ids), 1), pair % max(len(ids), 1)
        there = np.minimum(np.searchsorted(ids, e["nbr"]), max(len(ids) - 1, 0))
        there = (row * len(ids) + there)[ids[there] == e["nbr"]] if len(ids) else np.zeros(0, np.int64)
        k = (ids[u] != q[at]) & ~np.isin(pair, there)
        at, u = at[k], u[k]
        more = np.empty(len(at), ENTRY)
        more["nbr"], more["new"] = ids[u], 1
        for lo in range(0, len(at), step):
            d = y[at[lo : lo + step]] - x[u[lo : lo + step]]
            more["dist"][lo : lo + step] = np.einsum("ij,ij->i", d, d)
        row, e = _nearest(np.concatenate([row, at]), np.concatenate([e, more]), pool)
        blobs = _blobs(e, np.bincount(row, minlength=len(q)))
        return pa.table([state.column("block"), state.column("q"), state.column("code"), blobs], ["block", "q", "code", "blob"])

    return run


def search(queries: DataFrame, graph: DataFrame, width: int = WIDTH, pool: int = POOL, at_once: int = AT_ONCE) -> DataFrame:
    """(block, q, code, blob): the nearest ``pool`` vertices met by each of ``queries`` (id), vertices of ``graph``."""
    size = graph.agg(F.count(F.lit(1)), F.max(F.length("code"))).first()
    block = block_size(width, size[1] or 0)
    links = adjacency(graph, -(-max(size[0], 1) // block), width, -1)
    asked = queries.select("id").distinct()
    blocks = -(-max(asked.count(), 1) // max(block // 16, 1))
    state = graph.select("id", "code", "blob").join(asked, "id", "left_semi")
    state = cut(state.mapInArrow(_renewed, _LIST).select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.col("id").alias("q"), "code", "blob"))
    codes = graph.select("id", "code")
    while True:
        front = cut(state.select("block", "q", "blob").mapInArrow(_open(pool, at_once), "block long, q long, c long"))
        if front.isEmpty():
            return state
        met = front.join(links.select(F.col("v").alias("c"), "blob"), "c").select("block", "q", F.lit(None).cast("binary").alias("code"), "blob")
        met = cut(met)
        rows = state.unionByName(met)
        state = cut(rows.groupBy("block").cogroup(_send(met, codes).groupBy("to")).applyInArrow(_advance(pool, at_once), "block long, q long, code binary, blob binary"))


def _renewed(batches):
    """All entries are yet to be expanded."""
    for b in batches:
        e, n = _packed(b.column("blob"), ENTRY)
        e = e.copy()
        e["new"] = 1
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("code"), _blobs(e, n)], ["id", "code", "blob"])


def _best(many: int):
    def run(batches):
        for b in batches:
            e, n = _packed(b.column("blob"), ENTRY)
            k = np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n) < many
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("q").to_numpy(), n)[k]), pa.array(e["nbr"][k])], ["q", "nbr"])

    return run


def _measured(batches):
    for b in batches:
        if len(b):
            x, y = (_packed(b.column(c), np.dtype(np.float32))[0].reshape(len(b), -1).astype(np.float64) for c in ("vec", "other"))
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("nbr"), pa.array(np.sqrt(((x - y) ** 2).sum(1)))], ["q", "nbr", "distance"])


def nearest(
    table: DataFrame, k: int = K, width: int = WIDTH, pool: int = POOL, queries=None, id_column: str = "vec_id", vector_column: str = "embedding", still: float = STILL
) -> DataFrame:
    """(vec_id, neighbour, rank, distance): the ``k`` nearest other rows of every query, by Euclidean distance.

    Queries are the rows for which the condition ``queries`` on ``id`` holds (all without one); the rows that are
    searched are all of the table. Ties in distance go by id among the rows found. Left out of both: null ids, vectors
    that are null or empty, hold a null, NaN, an infinity or a component beyond 1e17, or are of another length than
    most. Of rows that repeat an id the least vector counts; equal vectors are neighbours at distance 0. With fewer
    than k + 1 rows every other row is listed; an empty table gives no rows. Further columns are not read.
    """
    vecs = cut(vectors(table, id_column, vector_column))
    graph = neighbour_graph(vecs.select("id", "code"), width, still)
    asked = vecs.select("id") if queries is None else vecs.select("id").where(queries)
    found = search(asked, graph, width, max(pool, RERANK * k)).select("q", "blob").mapInArrow(_best(RERANK * k), "q long, nbr long")
    both = found.join(vecs.select(F.col("id").alias("q"), "vec"), "q").join(vecs.select(F.col("id").alias("nbr"), F.col("vec").alias("other")), "nbr")
    exact = both.mapInArrow(_measured, "q long, nbr long, distance double")
    best = exact.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("distance", "nbr"))).where(F.col("rank") <= k)
    return best.select(F.col("q").alias("vec_id"), F.col("nbr").alias("neighbour"), "rank", "distance")
