"""Toxicity by non-negative positive-unlabelled learning.

The positives are documents confirmed as toxic, the unlabelled ones a sample of all documents. Words and their
beginnings of 3 to 6 bytes are hashed features; those that the positives show more often than the unlabelled by
as much as a mostly toxic feature would are kept, and a linear model over their presence is trained in numpy on the risk

    prior * R(positive as +) + max(0, R(unlabelled as -) - prior * R(positive as -))

with the logistic loss, until no weight moves by more than ``SETTLED`` a step. The prior is the toxic share of the
labelled rows. The two samples are bounded in documents and bytes by parameters; scoring is one pass over every whole
text, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BYTE, NOT_ALNUM, cut, packed, prefix, sampled, slices, span_hash, unpacked, within, words
from .near_dedup import lowered

FEATURES = 1 << 20
PREFIXES = (3, 4, 5, 6)
POSITIVES, UNLABELLED = 3000, 6000
SAMPLE_BYTES = 1 << 26  # of features, for each of the two
SIGMAS = 5.0
SETTLED = 1e-3


@dataclass
class Model:
    weights: np.ndarray  # float32[FEATURES], mostly zero
    bias: float

    def __getstate__(self):
        at = np.flatnonzero(self.weights)
        return at, self.weights[at], self.bias

    def __setstate__(self, state):
        at, w, self.bias = state
        self.weights = np.zeros(FEATURES, np.float32)
        self.weights[at] = w


def _features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of every word and word beginning."""
    start, end, first = words(data, at, NOT_ALNUM)
    sums = prefix(BYTE[data])
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    rows, found = [row], [span_hash(sums, start, end)]
    for k in PREFIXES:
        long = end - start > k
        rows.append(row[long])
        found.append(span_hash(sums, start[long], start[long] + k) + np.uint64(k))
    return np.concatenate(rows), (np.concatenate(found) & np.uint64(FEATURES - 1)).astype(np.int64)


_KEY = ["positive", "doc_id", "tag"]


def _sample(batches):
    for batch in batches:
        for part, data, at in slices(lowered(batch)):
            row, f = _features(data, at)
            both = np.unique(row * FEATURES + f)
            cuts = np.searchsorted(both, np.arange(len(part) + 1) * FEATURES)
            f = (both % FEATURES).astype(np.int32)
            rows = [f[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in _KEY], pa.array(rows, pa.binary())], [*_KEY, "features"])


def risk(w: np.ndarray, positive, unlabelled, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Both parts of the risk and their gradients; a set is (rows, features, number of rows), the last weight is the bias."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def scores(rows, feats, n):
        return np.bincount(rows, w[feats], n) + w[-1]

    def back(s, g):
        return np.append(np.bincount(s[1], g[s[0]], len(w) - 1), g.sum())

    zp, zu, p, u = scores(*positive), scores(*unlabelled), positive[2], unlabelled[2]
    plus = prior * np.logaddexp(0, -zp).mean()
    minus = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    return plus, minus, back(positive, -sigmoid(-zp)) * prior / p, back(unlabelled, sigmoid(zu)) / u - back(positive, sigmoid(zp)) * prior / p


def nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rate: float = 0.1, decay: float = 1e-4, settled: float = SETTLED) -> Model:
    """Adam on the non-negative risk; where its second part is negative, that part's gradient is reversed.

    The rate falls as 1 / (1 + step / 50), so the weights settle.
    """
    model = Model(np.zeros(FEATURES, np.float32), -10.0)
    if not positive or not unlabelled or prior <= 0:
        return model
    count = [np.bincount(np.concatenate(x), minlength=FEATURES) for x in (positive, unlabelled)]
    share = [(c + 0.5) / (len(x) + 1) for c, x in zip(count, (positive, unlabelled))]
    # kept: features of which at least half the bearers should be toxic, and not by chance
    expected = len(positive) * share[1]
    chosen = np.flatnonzero((prior * share[0] > 0.5 * share[1]) & (count[0] - expected > SIGMAS * np.sqrt(expected * (1 - share[1])) + 1))
    place = np.full(FEATURES, -1)
    place[chosen] = np.arange(len(chosen))

    def sparse(x):
        f = [place[r][place[r] >= 0] for r in x]
        return np.repeat(np.arange(len(x)), [len(r) for r in f]), np.concatenate(f).astype(np.int64), len(x)

    p, u = sparse(positive), sparse(unlabelled)
    w = np.zeros(len(chosen) + 1)
    w[-1] = -1.0
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    while True:
        step += 1
        _, rest, plus, minus = risk(w, p, u, prior)
        g = plus + minus if rest >= 0 else -minus
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate / (1 + step / 50) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move
        if np.abs(move).max() <= settled or not np.isfinite(move).all():
            break
    model.weights[chosen] = w[:-1]
    model.bias = float(w[-1])
    return model


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Draws both samples among the documents of ``docs`` in the order of a hash; an id with any toxic label is toxic.

    Without a toxic label nothing is toxic. Rows that repeat doc_id and text are drawn once, and of either sample no
    more documents are taken than ``sample_bytes`` of features hold.
    """
    toxic = labels.where("toxic = 1").select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    p = sampled(docs, toxic, positives, 0).withColumn("positive", F.lit(True))
    u = sampled(docs, None, unlabelled, 1).withColumn("positive", F.lit(False))
    drawn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    drawn = drawn.withColumn("tag", F.xxhash64("text")).join(F.broadcast(p.unionByName(u)), ["doc_id", "tag"])  # bounded by the two parameters
    made = drawn.select("text", *_KEY).mapInArrow(_sample, "positive boolean, doc_id long, tag long, features binary")
    made = cut(made.groupBy(*_KEY).agg(F.max("features").alias("features")))
    sets = []
    for want in (True, False):
        few = within(made.where(F.col("positive") == want), F.length("features"), sample_bytes, "doc_id", "tag")
        sets.append([np.frombuffer(f, np.int32) for f in few.select("features").toArrow().column(0).to_pylist()])
    prior = labels.where("toxic is not null").agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    return nnpu(sets[0], sets[1], float(prior))


def _scorer(model: Model, keep: list[str]):
    def run(batches):
        for batch in batches:
            for part, data, at in slices(lowered(batch)):
                row, f = _features(data, at)
                hit = np.flatnonzero(model.weights[f])
                both = np.unique(row[hit] * FEATURES + f[hit])
                z = np.bincount(both // FEATURES, model.weights[both % FEATURES], len(part)) + model.bias
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(score), pa.array(z > 0)], [*keep, "score", "is_toxic"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, is_toxic) for every row; null and empty texts get the score of a text without known words.

    Texts of any length are read whole; one whose score lies just at the bound (a tie) isn't toxic. Null doc_ids,
    repeated rows and repeated doc_ids pass through row by row; an empty table gives no rows; further columns are
    not read.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(_scorer(model, ["doc_id"]), "doc_id long, score double, is_toxic boolean")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that the model calls toxic, with the columns of ``docs``, whatever their names.

    Null and empty texts stay; texts of any length are read whole; repeated rows share their fate; an empty table
    stays empty. The text crosses to Python once, within its row.
    """
    row = docs.select(packed(docs).alias("row"))
    kind = docs.schema["text"].dataType

    def run(batches):
        for batch in batches:
            text = batch.column("row").field(docs_at)
            some = pa.RecordBatch.from_arrays([text if kind == T.StringType() else text.cast(pa.string()), pa.array(np.arange(len(batch)))], ["text", "at"])
            gone = [b.column("at").filter(b.column("is_toxic")) for b in _scorer(model, ["at"])([some])]
            keep = np.ones(len(batch), bool)
            for g in gone:
                keep[g.to_numpy()] = False
            yield batch.filter(pa.array(keep))

    docs_at = docs.columns.index("text")
    return unpacked(row.mapInArrow(run, row.schema), "row", docs.columns)
