"""Packing documents into sequences of a fixed number of words by cutting-stock column generation.

A text longer than ``capacity`` is cut into full pieces and a rest. The histogram of piece lengths, rounded up
to ``grain`` words, has a bounded number of classes; it is all the driver gets. There a linear program over
patterns (how many pieces of each class a sequence takes) is solved by column generation: knapsack dynamic
programming finds the pattern of least reduced cost, the revised simplex method takes it in. Pattern counts are
rounded down and the few pieces left over are packed greedily. Pieces are ranked within their class by
(doc_id, piece): they are sorted into range partitions once, numbered there, and shifted by the counts of the
partitions before. A piece's rank decides its pattern, sequence and place by arithmetic, without another shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NO_ID, cut, real_id, slices, words

CAPACITY, GRAIN = 2048, 16


def best_pattern(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fits = np.flatnonzero(sizes <= c)
        best[c] = best[c - 1]
        if len(fits):
            gain = best[c - sizes[fits]] + value[fits]
            if gain.max() > best[c] + 1e-12:
                best[c], took[c] = gain.max(), fits[gain.argmax()]
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= int(sizes[took[c]])
    return float(best[capacity]), pattern


def _inverse(basis: np.ndarray) -> np.ndarray:
    """By Gauss-Jordan steps over whole rows. A driver calls this, so no BLAS: its threads and Spark's can wait for each other."""
    m = len(basis)
    both = np.hstack([basis, np.eye(m)])
    for k in range(m):
        pivot = k + int(np.abs(both[k:, k]).argmax())
        both[[k, pivot]] = both[[pivot, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        both -= factor[:, None] * both[k]
    return both[:, m:]


def patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, refresh: int = 64) -> tuple[np.ndarray, np.ndarray, float]:
    """Patterns (rows), how often each is used, and the linear program's bound; the uses meet the demand exactly.

    The basis is kept as its inverse, which an exchanged column changes by one product; it is computed afresh every
    ``refresh`` exchanges. Columns are taken in until none has a lower cost, the bound is within half a sequence, or
    rounding leaves nothing to gain.
    """
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)  # columns are patterns
    inverse, bound, turn, stuck, least = np.diag(1 / np.diag(basis)), 0.0, 0, 0, np.inf
    while True:
        x = np.maximum((inverse * demand).sum(axis=1), 0)
        dual = inverse.sum(axis=0)
        gain, column = best_pattern(sizes, dual, capacity)
        bound = max(bound, float((dual * demand).sum()) / max(gain, 1.0))
        if gain <= 1 + 1e-9 or x.sum() - bound < 0.5:
            break
        stuck = 0 if x.sum() < least - 1e-9 else stuck + 1
        least = min(least, x.sum())
        if stuck > 4 * m:  # only exchanges of columns that aren't used: rounding holds it at an optimum
            break
        step = (inverse * column).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, x / step, np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        turn += 1
        if turn % refresh == 0:
            inverse = _inverse(basis)
        else:
            row = inverse[out] / step[out]
            inverse = inverse - step[:, None] * row
            inverse[out] = row
    x = np.maximum((_inverse(basis) * demand).sum(axis=1), 0)
    used, left = np.floor(x + 1e-9).astype(np.int64), demand.astype(np.int64).copy()
    table, times = [], []
    for k in np.flatnonzero(used):
        column = basis[:, k].round().astype(np.int64)
        n = min(int(used[k]), int((left[column > 0] // column[column > 0]).min()))
        if n:
            table.append(column)
            times.append(n)
            left -= n * column
    order = np.argsort(-sizes)
    while left.any():
        column, room = np.zeros(m, np.int64), capacity
        for k in order:
            column[k] = min(left[k], room // sizes[k])
            room -= column[k] * sizes[k]
        n = int((left[column > 0] // column[column > 0]).min())
        table.append(column)
        times.append(n)
        left -= n * column
    return np.array(table).reshape(-1, m), np.array(times, np.int64), bound


class Plan:
    """Turns (class, rank) into (sequence, place)."""

    def __init__(self, classes: np.ndarray, counts: np.ndarray, capacity: int):
        self.classes, self.counts = classes, counts
        self.table, self.times, self.bound = patterns(classes, counts, capacity) if len(classes) else (np.zeros((0, 0), int), np.zeros(0, int), 0.0)
        self.first = np.cumsum(self.times) - self.times
        taken = self.table[:, ::-1] * classes[::-1] if len(classes) else self.table
        self.place = (np.cumsum(taken, axis=1) - taken)[:, ::-1]  # long pieces come first
        self.upto = np.cumsum(self.table * self.times[:, None], axis=0)

    def assign(self, cls: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, place = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
        for k in np.unique(np.searchsorted(self.classes, cls)):
            mine = np.flatnonzero(cls == self.classes[k])
            p = np.searchsorted(self.upto[:, k], rank[mine], "right")
            a = self.table[p, k]
            r = rank[mine] - (self.upto[p, k] - a * self.times[p])
            sequence[mine] = self.first[p] + r // a
            place[mine] = self.place[p, k] + r % a * self.classes[k]
        return sequence, place


def _pieces(capacity: int, grain: int):
    def run(batches):
        for batch in batches:
            for part, data, at in slices(batch):
                n = np.diff(words(data, at)[2])
                many = np.maximum(-(-n // capacity), 1)
                row = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                size = np.minimum(n[row] - piece * capacity, capacity)
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)[row]
                columns = [ids, piece.astype(np.int64), size.astype(np.int32), (-(-size // grain)).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "piece", "n_words", "class"])

    return run


def _numbered(batches):
    """Numbers sorted rows within their class and partition."""
    from pyspark import TaskContext

    me, last, n = TaskContext.get().partitionId(), None, 0
    for b in batches:
        cls = b.column("class").to_numpy()
        if not len(cls):
            continue
        head = np.append(cls[0] != last, cls[1:] != cls[:-1])
        start = np.maximum.accumulate(np.where(head, np.arange(len(cls)), 0))
        nth = np.arange(len(cls)) - start
        if not head[0]:
            nth[: int(head.argmax()) if head.any() else len(cls)] += n
        last, n = cls[-1], int(nth[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(cls), me, np.int32)), pa.array(nth.astype(np.int64))], [*b.schema.names, "part", "nth"])


def pack(docs: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """(sequence, place, doc_id, piece, first_word, n_words): every piece of every row, its sequence and first word there.

    Words are split at ASCII white space. Null and empty texts take no room: one row with a null sequence and
    place. Repeated rows and doc_ids are packed row by row, a null doc_id stays null. An empty table gives no
    rows; further columns are not read.
    """
    assert capacity % grain == 0
    text = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = text.mapInArrow(_pieces(capacity, grain), "doc_id long, piece long, n_words int, class int")
    order = ["class", "doc_id", "piece"]
    sorted_ = cut(
        pieces.repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(_numbered, "doc_id long, piece long, n_words int, class int, part int, nth long")
    )
    counts = sorted_.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("shift", F.sum("n").over(W.partitionBy("class").orderBy("part")) - F.col("n")).drop("n")
    histogram = sorted_.where("class > 0").groupBy("class").count().orderBy("class").collect()  # capacity / grain rows at most
    plan = Plan(np.array([r[0] for r in histogram], np.int64), np.array([r[1] for r in histogram], np.int64), capacity // grain)

    def place(batches):
        for b in batches:
            cls, rank = b.column("class").to_numpy().astype(np.int64), b.column("rank").to_numpy()
            some = cls > 0
            sequence, at = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
            sequence[some], at[some] = plan.assign(cls[some], rank[some])
            yield pa.RecordBatch.from_arrays(
                [pa.array(sequence, mask=~some), pa.array((at * grain).astype(np.int32), mask=~some), *[b.column(c) for c in ("doc_id", "piece", "n_words")]],
                ["sequence", "place", "doc_id", "piece", "n_words"],
            )

    ranked = sorted_.join(before, ["class", "part"]).select("doc_id", "piece", "n_words", "class", (F.col("nth") + F.col("shift")).alias("rank"))
    placed = ranked.mapInArrow(place, "sequence long, place int, doc_id long, piece long, n_words int")
    return placed.select("sequence", "place", real_id(), "piece", (F.col("piece") * capacity).alias("first_word"), "n_words")
