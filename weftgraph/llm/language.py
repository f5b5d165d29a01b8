"""Languages of multilingual documents by expectation-maximisation over n-gram likelihoods.

Every language has a distribution over hashed byte trigrams of lower-case text, counted over all documents that
carry its label. A document is a mixture: its proportions are found by EM over the likelihoods of its trigrams,
which goes on for a document until none of them moves by more than ``settled`` in a round.
All languages start in the mixture; the least one is taken out again and again, and of these nested sets the one
of greatest penalised likelihood is selected. A trigram overlaps its neighbours, so the log likelihood is divided
by three; each further language costs ``penalty`` times the logarithm of the text's length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .near_dedup import lowered

GRAMS = 1 << 15
SMOOTH, PENALTY, SETTLED = 0.5, 2.0, 0.01  # EM ends for a document when no proportion moves by more than SETTLED


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # float32 (GRAMS, languages)


def trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed trigram, in the order of the text; trigrams don't cross rows."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = data.astype(np.uint32)
    g = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    g = (g * np.uint32(2654435761)) >> np.uint32(17)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[:-2]
    inside = np.arange(len(g)) + 2 < at[1:][row]
    return row[inside], g[inside].astype(np.int64)


def _counted(batches):
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for part, data, at in slices(lowered(batch)):
            names = part.column("lang").dictionary_encode()
            code = names.indices.to_numpy(zero_copy_only=False)
            row, g = trigrams(data, at)
            for k, name in enumerate(names.dictionary.to_pylist()):
                total.setdefault(name, np.zeros(GRAMS, np.int64))
                total[name] += np.bincount(g[code[row] == k], minlength=GRAMS)
    for name, t in total.items():
        some = np.flatnonzero(t)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(t[some])], ["lang", "gram", "n"])


def train(docs: DataFrame) -> Model:
    """Counts over all labelled documents; rows without a label or text are not read."""
    known = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    per = known.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = per.toArrow()  # languages x GRAMS rows at most
    names = sorted(set(got.column("lang").to_pylist()))
    count = np.full((GRAMS, max(len(names), 1)), SMOOTH)
    if names:
        code = {n: i for i, n in enumerate(names)}
        count[got.column("gram").to_numpy(), [code[x] for x in got.column("lang").to_pylist()]] += got.column("n").to_numpy()
    return Model(names, np.log(count / count.sum(axis=0)).astype(np.float32))


def _em(p: np.ndarray, weight: np.ndarray, start: np.ndarray, share: np.ndarray, settled: float) -> np.ndarray:
    """Proportions after EM; ``start`` bounds the trigrams of each row, none of which is empty. Rows that have settled are left out of further rounds."""
    share, size = share.copy(), np.diff(start)
    total = np.add.reduceat(weight, start[:-1])[:, None]
    rows, p, weight = np.arange(len(size)), p, weight
    at = start[:-1]
    while len(rows):
        joint = p * np.repeat(share[rows], size, axis=0)
        joint *= (weight / np.maximum(joint.sum(axis=1), 1e-30))[:, None]
        new = np.add.reduceat(joint, at, axis=0) / total
        moved = np.abs(new - share[rows]).max(axis=1) > settled
        share[rows] = new
        if moved.sum() <= 0.7 * len(rows):
            keep = np.repeat(moved, size)
            rows, size, total, p, weight = rows[moved], size[moved], total[moved], p[keep], weight[keep]
            at = np.cumsum(size) - size
    return share


def infer(model: Model, row: np.ndarray, gram: np.ndarray, n_rows: int, length: np.ndarray, settled: float = SETTLED, penalty: float = PENALTY) -> np.ndarray:
    """Proportions (rows, languages) under the selected set; rows without a trigram are zero."""
    L = len(model.languages)
    out = np.zeros((n_rows, L), np.float32)
    if not len(row):
        return out
    key, weight = np.unique(row * GRAMS + gram, return_counts=True)
    row, gram = key // GRAMS, key % GRAMS
    weight = weight.astype(np.float32) / 3
    start = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    some = row[start]  # the rows that have trigrams
    start = np.append(start, len(row))
    size, n = np.diff(start), len(some)
    log_p = model.log_p[gram]
    top = log_p.max(axis=1)
    p = np.exp(log_p - top[:, None])
    base = np.add.reduceat((weight * top).astype(np.float64), start[:-1])
    share = np.full((n, L), 1 / L, np.float32)
    best, chosen = np.full(n, -np.inf), np.zeros((n, L), np.float32)
    cost = penalty * np.log(np.maximum(length[some], 2))
    for k in range(L, 0, -1):
        if k == 1:
            like = np.add.reduceat(weight[:, None] * log_p, start[:-1], axis=0)
            # the single language is free to be any one; of equal ones the first by name
            one = like.argmax(axis=1)
            share = np.zeros((n, L), np.float32)
            share[np.arange(n), one] = 1
            fit = like[np.arange(n), one]
        else:
            share = _em(p, weight, start, share, settled)
            fit = base + np.add.reduceat(weight * np.log(np.maximum((p * np.repeat(share, size, axis=0)).sum(axis=1), 1e-30)), start[:-1])
        gain = fit - (k - 1) * cost
        better = gain >= best  # of equally good sets the smaller
        best[better], chosen[better] = gain[better], share[better]
        if k > 1:
            low = np.where(share > 0, share, np.inf).argmin(axis=1)
            share = share.copy()
            share[np.arange(n), low] = 0
            share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-30)
    out[some] = chosen
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, language, languages, proportions) for every row: the main language, all of them by descending
    proportion (ties by name), and their proportions.

    Null texts, texts under three bytes and a model without languages give a null language and empty arrays. Texts of
    any length are read whole; of sets that fit equally well the smaller is taken, of single languages the first by
    name. Null doc_ids and repeated rows pass through row by row; an empty table gives no rows; further columns are
    not read.
    """

    def run(batches):
        for batch in batches:
            for part, data, at in slices(lowered(batch)):
                row, gram = trigrams(data, at)
                if not model.languages:
                    row, gram = row[:0], gram[:0]
                share = infer(model, row, gram, len(part), np.diff(at)) if model.languages else np.zeros((len(part), 1), np.float32)
                order = np.argsort(-share, axis=1, kind="stable")
                ranked = np.take_along_axis(share, order, 1)
                some = ranked > 0
                n = np.append(0, np.cumsum(some.sum(axis=1))).astype(np.int32)
                names = np.array(model.languages or [""], object)[order]
                first = pa.array(names[:, 0], pa.string(), mask=~some[:, 0])
                lists = [pa.ListArray.from_arrays(pa.array(n), x) for x in (pa.array(names[some], pa.string()), pa.array(ranked[some].astype(np.float64)))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), first, *lists], ["doc_id", "language", "languages", "proportions"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(run, "doc_id long, language string, languages array<string>, proportions array<double>")
