"""Repeated passages across documents, marked with run-compressed Burrows-Wheeler indexes.

A word window (``length`` words, by default 50) is a repeat if another document has the same window. Three
steps find all of them, exactly:

1. Winnowing names each window by the least hash of its 16-word grams, so equal windows have equal names, and
   neighbouring windows mostly share one: a document becomes short runs (name, first window, last window). Only
   runs whose name two documents have can hold repeats; partial aggregates over the names find them.
2. The words of those runs are cut out of their documents and gathered by name. Equal cut-outs are kept once.
3. Each task indexes the names it was given, some hundred thousand words at a time. Of the suffix array and the BWT
   only the runs stay: where each begins in the text, the sampled end of the run before it, and the length of the
   common prefix of the two. Matching statistics are streamed over the text from these samples: from one to the
   next, the preceding suffix moves along with the position and the match shrinks by one a word. Positions whose
   match has ``length`` words form chains, and a chain that spans two documents is a repeat.

Words are compared by 32-bit hashes, ``length`` of them per window. No cap is set on copies or candidates: of a name
that more than ``HOT`` runs have, the windows are matched by two 64-bit hashes of all their words, in partial aggregates
instead of one task's index, and with the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BYTE, cut, keyed, long_array, mix, packed, prefix, real_id, slices, span_hash, unpacked, words

LENGTH, GRAM = 50, 16
INDEX_WORDS = 400_000
HOT = 50_000


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, first = words(data, at)
    return span_hash(prefix(BYTE[data]), start, end), first


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by running minima from both ends of blocks."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    padded = np.concatenate([x, np.full(-len(x) % width, x.max(), x.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(padded, axis=1).reshape(-1)
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def seeds(h: np.ndarray, first: np.ndarray, length: int, gram: int, within: bool = False) -> tuple[np.ndarray, ...]:
    """Runs of windows of one name: name, row, first and last window (as word numbers in the row), and with ``within``
    whether the run has its name's gram in two places, without which no two of its windows are equal."""
    n = len(h) - gram + 1
    if n <= 0 or len(h) < length:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3, np.zeros(0, bool)
    sums = prefix(h)
    at = np.arange(n)
    grams = span_hash(sums, at, at + gram)
    least = sliding_min(grams, length - gram + 1)
    count = np.maximum(np.diff(first) - length + 1, 0)  # windows of each row
    row = np.repeat(np.arange(len(count)), count)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    name = least[first[:-1][row] + inner]
    if not len(name):
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3, np.zeros(0, bool)
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(name)) - 1
    again = np.zeros(len(start), bool)
    if within:
        begin, size = first[:-1][row[start]] + inner[start], last - start + 1 + length - gram
        of = np.repeat(np.arange(len(start)), size)
        place = begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        again = np.bincount(of, grams[place] == name[start][of], len(start)) > 1
    return name[start], row[start], inner[start], inner[last], again


def _seeder(length: int, gram: int, within: bool):
    def run(batches):
        for batch in batches:
            for part, data, at in slices(batch):
                name, row, a, b, again = seeds(*word_hashes(data, at), length, gram, within)
                ids = [part.column(c).to_numpy(zero_copy_only=False)[row] for c in ("doc_id", "tag")]
                rows = [long_array(name), *map(pa.array, ids), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(again)]
                yield pa.RecordBatch.from_arrays(rows, ["name", "doc_id", "tag", "a", "b", "again"])

    return run


def _cutter(length: int):
    """The words of each run of a document as 32-bit hashes."""

    def run(batches):
        for batch in batches:
            for part, data, at in slices(batch):
                h, first = word_hashes(data, at)
                h = (h >> np.uint64(32)).astype(np.uint32)
                out = [[], [], [], [], []]
                for lo, doc, tag, names, a, b in zip(first.tolist(), *[part.column(c).to_pylist() for c in ("doc_id", "tag", "names", "firsts", "lasts")]):
                    out[0] += names
                    out[1] += [doc] * len(names)
                    out[2] += [tag] * len(names)
                    out[3] += a
                    out[4] += [h[lo + x : lo + y + length].tobytes() for x, y in zip(a, b)]
                yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.int32()), pa.array(out[4], pa.binary())], ["name", "doc_id", "tag", "a", "words"])

    return run


def _window_hashes(length: int):
    """Two 64-bit hashes of all words of every window in a document's runs."""

    def run(batches):
        for batch in batches:
            for part, data, at in slices(batch):
                h, first = word_hashes(data, at)
                one, two = prefix(h), prefix(mix(h + np.uint64(1)))
                for lo, doc, tag, a, b in zip(first.tolist(), *[part.column(c).to_pylist() for c in ("doc_id", "tag", "firsts", "lasts")]):
                    w = np.unique(np.concatenate([np.arange(x, y + 1) for x, y in zip(a, b)]))
                    both = [long_array(span_hash(p, lo + w, lo + w + length)) for p in (one, two)]
                    ids = [pa.array(np.full(len(w), x, np.int64)) for x in (doc, tag)]
                    yield pa.RecordBatch.from_arrays([*both, *ids, pa.array(w.astype(np.int64))], ["one", "two", "doc_id", "tag", "a"])

    return run


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; the text ends with a symbol that occurs once."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    t = text[order]
    rank[order] = np.cumsum(np.append(False, t[1:] != t[:-1]))
    k = 1
    while rank[order[-1]] < n - 1:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        # only suffixes whose rank isn't settled are sorted again
        count = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(count[rank[order]] > 1)
        part = order[open_]
        part = part[np.argsort(key[part], kind="stable")]
        order[open_] = part
        s = key[order]
        rank[order] = _ranks(s, rank[order])
        k *= 2
    return order


def _ranks(key: np.ndarray, old: np.ndarray) -> np.ndarray:
    """Dense ranks of sorted keys."""
    return np.cumsum(np.append(False, (key[1:] != key[:-1]) | (old[1:] != old[:-1])))


class RunIndex:
    """Run-length BWT of an integer text that ends with a symbol that occurs once.

    Kept of it: for each run, in the order of the text, where its first suffix begins (``where``), where the suffix
    before it begins, which is the last of the run before (``ends``; -1 for none), and how many symbols the two share.
    Neither the suffix array nor the text stays.
    """

    def __init__(self, text: np.ndarray):
        order = suffix_array(text)
        bwt = text[order - 1]
        start = np.flatnonzero(np.append(True, bwt[1:] != bwt[:-1]))
        where, ends = order[start], np.where(start > 0, order[start - 1], -1)
        shared = np.zeros(len(start), np.int64)
        live, depth = np.flatnonzero(start > 0), 0
        x, y = where[live], ends[live]
        while len(live):
            ok = (x + depth < len(text)) & (y + depth < len(text))
            ok[ok] = text[x[ok] + depth] == text[y[ok] + depth]
            shared[live[~ok]] = depth
            live, x, y, depth = live[ok], x[ok], y[ok], depth + 1
        o = np.argsort(where)
        self.n, self.where, self.ends, self.shared = len(text), where[o], ends[o], shared[o]

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each position the suffix before it in order and how much they match, streamed from the samples."""
        at = np.arange(self.n)
        near = np.repeat(np.arange(len(self.where)), np.diff(np.append(self.where, self.n)))
        # the text begins with a sample only if its BWT symbol begins a run; before the first sample, the last one's stream goes on
        near = np.concatenate([np.full(self.where[0], len(self.where) - 1), near])
        moved = (at - self.where[near]) % self.n
        return (self.ends[near] + moved) % self.n, np.maximum(self.shared[near] - moved, 0)


def repeats(names: np.ndarray, docs: list[tuple[int, int]], firsts: list[int], cuts: list[bytes], length: int, within: bool = False):
    """Spans of windows that another document has: (doc, tag, first window, last window, source doc, its first window).

    The source is the least (doc_id, tag, position) with the same words; spans of the source itself are left out.
    With ``within``, windows that one document has in two places count too.
    """
    distinct: dict[tuple[int, bytes], int] = {}
    members: list[set[tuple[int, int, int]]] = []
    for name, doc, a, c in zip(names, docs, firsts, cuts):
        k = distinct.setdefault((name, c), len(members))
        if k == len(members):
            members.append(set())
        members[k].add((*doc, a))
    arrays = [np.frombuffer(c, np.uint32) for _, c in distinct]
    size = np.array([len(a) for a in arrays])
    group = {n: i for i, n in enumerate(dict.fromkeys(n for n, _ in distinct))}
    tagged = np.concatenate(arrays).astype(np.int64) + np.repeat(np.array([group[n] for n, _ in distinct], np.int64) << 32, size)
    symbols = np.unique(tagged, return_inverse=True)[1] + len(arrays)
    begin = np.cumsum(size + 1) - size - 1
    text = np.empty(int(size.sum()) + len(arrays), np.int64)
    text[begin + size] = np.arange(len(arrays))[::-1]  # a separator of its own ends each cut-out
    inner = np.ones(len(text), bool)
    inner[begin + size] = False
    text[inner] = symbols
    before, match = RunIndex(text).statistics()
    head = np.where(match >= length, before, np.arange(len(text)))  # chains of equal windows, by doubling to their heads
    while (head[head] != head).any():
        head = head[head]
    owner = np.searchsorted(begin, np.arange(len(text)), "right") - 1
    offset = np.arange(len(text)) - begin[owner]
    window = offset + length <= size[owner]
    owner, offset, group_of = owner[window], offset[window], head[window]
    # least and greatest document of each group of equal windows
    low = [min(m) for m in members]
    many = np.array([len(m if within else {x[:2] for x in m}) > 1 for m in members])
    ids = sorted({x[:2] for m in members for x in m})
    number = {d: i for i, d in enumerate(ids)}
    least_doc = np.array([number[x[:2]] for x in low])
    least_at = np.array([x[2] for x in low])
    d, p = least_doc[owner], least_at[owner] + offset
    o = np.lexsort((p, d, group_of))
    owner, offset, group_of, d, p = (x[o] for x in (owner, offset, group_of, d, p))
    head = np.append(True, group_of[1:] != group_of[:-1])
    g = np.cumsum(head) - 1
    start = np.flatnonzero(head)
    last = np.append(start[1:], len(head)) - 1
    across = (d[start] != d[last]) | (within & ((start != last) & (p[start] != p[last]))) | np.logical_or.reduceat(many[owner], start) if len(start) else np.zeros(0, bool)
    keep = across[g]
    source, source_at = d[start][g][keep], p[start][g][keep]
    owner, offset = owner[keep], offset[keep]
    o = np.lexsort((offset, owner))
    owner, offset, source, source_at = (x[o] for x in (owner, offset, source, source_at))
    new = np.append(True, (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1) | (source[1:] != source[:-1]) | (source_at[1:] != source_at[:-1] + 1))[: len(owner)]
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(owner)) - 1
    for k, x, y, s, q in zip(owner[start].tolist(), offset[start].tolist(), offset[last].tolist(), source[start].tolist(), source_at[start].tolist()):
        for doc, tag, a in members[k]:
            if (doc, tag) != ids[s] or a + x != q:
                yield doc, tag, a + x, a + y, *ids[s], q


def _indexer(length: int, size: int, within: bool):
    """Takes rows in the order of their names; indexes whole names, about ``size`` words at a time."""

    def run(batches):
        held: list[list] = [[], [], [], []]
        total, last = 0, None

        def flush():
            got = list(zip(*repeats(*held, length, within))) or [[]] * 7
            for x in held:
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], ["doc_id", "tag", "a", "b", "source", "source_tag", "source_a"])

        for batch in batches:
            for name, doc, tag, a, w in zip(*[batch.column(c).to_pylist() for c in ("name", "doc_id", "tag", "a", "words")]):
                if name != last and total >= size:
                    yield flush()
                    total = 0
                last, total = name, total + len(w) // 4
                for x, v in zip(held, (name, (doc, tag), a, w)):
                    x.append(v)
        if held[0]:
            yield flush()

    return run


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, within: bool = False) -> DataFrame:
    """(doc_id, tag, a, b, source, source_tag, source_a): windows a..b of a document equal those of the source from source_a on."""
    text = keyed(docs).where("text is not null")
    runs = text.mapInArrow(_seeder(length, gram, within), "name long, doc_id long, tag long, a int, b int, again boolean")
    doc = F.xxhash64("doc_id", "tag")
    names = runs.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(doc).alias("low"), F.max(doc).alias("high"), F.max("again").alias("again"))
    names = cut(names.where("n > 1 or again" if within else "low != high").select("name", (F.col("n") > HOT).alias("hot")))
    runs = runs.join(names, "name")
    # repeated rows go before the shuffle, so that one document many times over is no hot key
    once = text.groupBy("doc_id", "tag").agg(F.first("text").alias("text"))

    def of(hot: bool) -> DataFrame:
        chosen = runs.where(F.col("hot") == hot).groupBy("doc_id", "tag").agg(F.collect_set(F.struct("name", "a", "b")).alias("runs"))
        chosen = chosen.select("doc_id", "tag", *[F.col(f"runs.{c}").alias(as_) for c, as_ in (("name", "names"), ("a", "firsts"), ("b", "lasts"))])
        return once.join(chosen, ["doc_id", "tag"])

    cuts = of(False).mapInArrow(_cutter(length), "name long, doc_id long, tag long, a int, words binary")
    found = "doc_id long, tag long, a long, b long, source long, source_tag long, source_a long"
    out = cuts.repartition("name").sortWithinPartitions("name").mapInArrow(_indexer(length, INDEX_WORDS, within), found)
    if names.where("hot").isEmpty():
        return out
    windows = cut(of(True).mapInArrow(_window_hashes(length), "one long, two long, doc_id long, tag long, a long"))
    place = F.struct("doc_id", "tag", "a")
    first = windows.groupBy("one", "two").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = cut(first.where("first != last" if within else "first.doc_id != last.doc_id or first.tag != last.tag").select("one", "two", "first"))
    again = windows.join(first, ["one", "two"]).where(place != F.col("first"))
    return out.unionByName(again.select("doc_id", "tag", "a", F.col("a").alias("b"), *[F.col(f"first.{c}").alias(x) for c, x in (("doc_id", "source"), ("tag", "source_tag"), ("a", "source_a"))]))


def repeated_passages(docs: DataFrame, length: int = LENGTH, within: bool = False) -> DataFrame:
    """(doc_id, start_word, n_words, source_doc_id, source_start_word): passages of at least ``length`` words that
    an earlier document (by doc_id) has too, as long as they go, with the place of their first occurrence.

    Words are split at ASCII white space and numbered from 0. Null, empty and shorter texts have no passages; texts of
    any length are read whole. Of occurrences the one of the least doc_id and place is the first (a tie in doc_id goes
    by a hash of the text). Rows that repeat doc_id and text are one document; rows that share only the doc_id are
    different documents. A passage that repeats within one document only is listed with ``within``. A null doc_id
    sorts first and stays null. An empty table gives no rows; further columns are not read.
    """
    in_doc = W.partitionBy("doc_id", "tag", "source", "source_tag", F.col("source_a") - F.col("a")).orderBy("a")
    spans = (
        repeated_windows(docs, length, within=within)
        .withColumn("new", F.coalesce((F.col("a") > F.lag("b").over(in_doc) + 1).cast("int"), F.lit(1)))
        .withColumn("part", F.sum("new").over(in_doc))
        .groupBy("doc_id", "tag", "source", "source_tag", (F.col("source_a") - F.col("a")).alias("shift"), "part")
        .agg(F.min("a").alias("start_word"), (F.max("b") - F.min("a") + length).alias("n_words"))
    )
    return spans.select(
        real_id(), "start_word", "n_words", F.col("source").alias("source_doc_id"), (F.col("start_word") + F.col("shift")).alias("source_start_word")
    ).select("doc_id", "start_word", "n_words", real_id("source_doc_id"), "source_start_word")


def _erased(text: str, spans: list[dict], length: int) -> str:
    raw = text.encode()
    start, end, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    gone = np.zeros(len(raw) + 1, np.int64)
    np.add.at(gone, start[[s["a"] for s in spans]], 1)
    np.add.at(gone, end[[s["b"] + length - 1 for s in spans]], -1)
    return np.frombuffer(raw, np.uint8)[np.cumsum(gone)[:-1] == 0].tobytes().decode().strip()


def _eraser(length: int, names: list[str]):
    """Changes the text, and n_chars, within the rows; a text that was wholly erased takes its row along."""

    def run(batches):
        for batch in batches:
            row, spans = batch.column("row"), batch.column("spans")
            fields = {c: row.field(i) for i, c in enumerate(names)}
            hit = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            if not len(hit):
                yield pa.RecordBatch.from_arrays([row], ["row"])
                continue
            text = fields["text"]
            new = [_erased(text[i].as_py(), spans[i].as_py(), length) for i in hit.tolist()]
            mask = np.zeros(len(batch), bool)
            mask[hit] = True
            fields["text"] = pc.replace_with_mask(text, pa.array(mask), pa.array(new, text.type))
            if "n_chars" in fields:
                size = pa.array([len(t) for t in new]).cast(fields["n_chars"].type)
                fields["n_chars"] = pc.replace_with_mask(fields["n_chars"], pa.array(mask), size)
            keep = np.ones(len(batch), bool)
            keep[hit] = [t != "" for t in new]
            kind = [pa.field(f.name, f.type) for f in row.type]
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(list(fields.values()), fields=kind)], ["row"]).filter(pa.array(keep))

    return run


def erase_repeats(docs: DataFrame, length: int = LENGTH, within: bool = False) -> DataFrame:
    """``docs`` with every passage erased from ``text`` that an earlier document has; the first occurrence stays.

    A document whose whole text goes is dropped; all others stay, null and empty texts too, with the columns of
    ``docs``, whatever their names. ``n_chars``, if there is such a column, is set to the new length where the text was
    changed. Rows that repeat doc_id and text share their fate. Texts of any length are read whole. An empty table stays
    empty. The text crosses to Python once more, within its row.
    """
    spans = repeated_windows(docs, length, within=within).groupBy("doc_id", "tag").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    spans = cut(spans)
    both = keyed(docs, packed(docs).alias("row")).select("doc_id", "tag", "row").join(spans, ["doc_id", "tag"], "left").select("row", "spans")
    done = both.mapInArrow(_eraser(length, docs.columns), both.select("row").schema)
    return unpacked(done, "row", docs.columns)
