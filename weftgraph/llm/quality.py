"""Quality by compression: one zstandard dictionary is built from good and one from bad labelled texts.

A text is compressed with each; (size with bad - size with good) / size of the text is large for texts that
resemble the good ones. Labelled texts that neither dictionary was built from calibrate this to a probability
(logistic regression on the difference). The labelled sample is bounded in documents and bytes by parameters;
scoring is one pass over every whole text, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sampled, slices, within

PER_CLASS, DICTIONARY, LEVEL = 2000, 1 << 16, 3
SAMPLE_BYTES = 1 << 26  # of text, for each class


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float = 0.0
    offset: float = 0.0


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; of too few texts to train one, as many of their last bytes as a dictionary may have."""
    try:
        return zstd.train_dictionary(DICTIONARY, texts, level=LEVEL).as_bytes()
    except zstd.ZstdError:
        return b"".join(texts)[-DICTIONARY:]


def _compressor(content: bytes) -> zstd.ZstdCompressor:
    if not content:
        return zstd.ZstdCompressor(level=LEVEL, write_content_size=False)
    d = zstd.ZstdCompressionDict(content)
    d.precompute_compress(level=LEVEL)
    return zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False)


def differences(model: Model, texts: list[bytes], pair: tuple | None = None) -> np.ndarray:
    good, bad = pair or (_compressor(model.good), _compressor(model.bad))
    return np.array([(len(bad.compress(t)) - len(good.compress(t))) / max(len(t), 1) for t in texts])


def fit(good: list[bytes], bad: list[bytes]) -> Model:
    """Every other text builds a dictionary, the rest calibrates. With one class only, every score is 0.5."""
    if not good or not bad:
        return Model(b"", b"")
    model = Model(_dictionary(good[::2]), _dictionary(bad[::2]))
    held = [good[1::2] or good, bad[1::2] or bad]
    x = np.concatenate([differences(model, h) for h in held])
    y = np.repeat([1.0, 0.0], [len(h) for h in held])
    weight = np.repeat([0.5 / len(h) for h in held], [len(h) for h in held])  # the classes count alike
    scale = max(float(np.abs(x).max()), 1e-9)
    X = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        grad = X.T @ (weight * (p - y)) + 1e-3 * w
        w -= np.linalg.solve((X * (weight * p * (1 - p))[:, None]).T @ X + 1e-3 * np.eye(2), grad)
    return Model(model.good, model.bad, float(w[0] / scale), float(w[1]))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Draws up to ``per_class`` documents of either label, and no more than ``sample_bytes`` of their text, among
    those of ``docs`` in the order of a hash. Rows that repeat doc_id and text are drawn once; an id with both labels
    has none.
    """
    label = F.col("quality").cast("int")
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("low"), F.max(label).alias("high"))
    known = known.where("low = high")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").withColumn("tag", F.xxhash64("text"))
    sets = []
    for q in (1, 0):
        drawn = sampled(docs, known.where(F.col("low") == q), per_class, q)
        got = text.join(F.broadcast(drawn), ["doc_id", "tag"]).dropDuplicates(["doc_id", "tag"])  # bounded by per_class
        got = within(cut(got), F.octet_length("text"), sample_bytes, "doc_id", "tag")
        sets.append([t.encode() for t in got.orderBy("tag", "doc_id").select("text").toArrow().column(0).to_pylist()])
    return fit(*sets)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, difference, score) for every row; a null text has null in both, an empty one a difference of the frame alone.

    Texts of any length are compressed whole. Null doc_ids and repeated rows pass through row by row, so equal texts
    have equal scores; an empty table gives no rows; further columns are not read.
    """

    def run(batches):
        pair = _compressor(model.good), _compressor(model.bad)
        for batch in batches:
            for part, data, at in slices(batch):
                d = differences(model, [data[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pair)
                p = 1 / (1 + np.exp(-np.clip(model.slope * d + model.offset, -30, 30)))
                null = part.column("text").is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(d, mask=null), pa.array(p, mask=null)], ["doc_id", "difference", "score"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(run, "doc_id long, difference double, score double")
