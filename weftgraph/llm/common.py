"""Helpers that the corpus operators share: keys, lineage cuts, and words of UTF-8 batches as numpy arrays.

A word is a maximal run of bytes that are not ASCII white space. Words are hashed to 64 bits with a
polynomial over random byte values, so a whole batch is hashed by one cumulative sum.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

NO_ID = -(1 << 63)  # stands for a null doc_id inside the operators
SLICE_BYTES = 1 << 19


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local session gets one that goes with the process; a cluster must name one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="weftgraph-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that this session wrote."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def column(name: str):
    """The column of exactly this name, whatever signs it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame):
    """All columns of ``df`` as one struct."""
    return F.struct(*[column(c) for c in df.columns])


def unpacked(df: DataFrame, row: str, names: list[str]) -> DataFrame:
    return df.select(*[F.col(row).getField(c).alias(c) for c in names])


def in_order(df: DataFrame) -> list:
    """Sort keys by all columns of ``df``, in their order; a column without an order is compared by its JSON."""
    def ordered(t: T.DataType) -> bool:
        if isinstance(t, T.StructType):
            return all(ordered(f.dataType) for f in t.fields)
        return ordered(t.elementType) if isinstance(t, T.ArrayType) else isinstance(t, T.AtomicType) or isinstance(t, T.NullType)

    return [column(f.name) if ordered(f.dataType) else F.to_json(F.struct(column(f.name))) for f in df.schema.fields]


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder that all executors share."""
    spark = df.sparkSession
    shared_folder(spark)
    rows = df.checkpoint(eager=True)._jdf.queryExecution().toRdd()
    # a checkpoint keeps the size that was estimated for its plan; over rounds of joins that estimate is squared again and again
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, df._jdf.schema(), False), spark)


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` (null as NO_ID), ``tag`` (hash of the text) and ``text``: rows that repeat both
    doc_id and text are one document, rows that share only the doc_id are different ones.

    Ids must be integers of at most 64 bits; the least of all, -2**63, is taken for null."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.xxhash64("text").alias("tag"),
        F.col("text").cast("string").alias("text"),
        *more,
    )


def real_id(column: str = "doc_id"):
    return F.when(F.col(column) != NO_ID, F.col(column)).alias(column)


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def sampled(docs: DataFrame, wanted: DataFrame | None, many: int, seed: int) -> DataFrame:
    """(doc_id, tag) of ``many`` distinct documents with a text at most, in the order of a hash; of those in ``wanted`` (doc_id) if given.

    They are drawn among the documents that are there, so ids of ``wanted`` that ``docs`` lacks take no place."""
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tag"), F.col("text").isNotNull().alias("there"))
    keys = keys.where("there and doc_id is not null").select("doc_id", "tag")
    if wanted is not None:
        keys = keys.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    return keys.distinct().orderBy(F.xxhash64("doc_id", "tag", F.lit(seed)), "doc_id", "tag").limit(many)


def within(df: DataFrame, size, bound: int, *order: str) -> DataFrame:
    """The first rows of a bounded number of rows, in order, whose sizes add up to ``bound`` at most."""
    upto = F.sum(size).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("upto", upto).where(F.col("upto") <= bound).drop("upto")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- numpy text


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


BYTE = _table(7)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\r\x0b\x0c")] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((BASE, BASE_INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix(values: np.ndarray) -> np.ndarray:
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span of the sequence that ``prefix`` has summed."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of about ``size`` bytes of text at a time, so memory doesn't follow Spark's batch size."""
    data, at = utf8(batch.column(column))
    lo, n = 0, len(batch)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield batch.slice(lo, hi - lo), data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(data: np.ndarray, at: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row its first word (one more at the end)."""
    inside = ~breaks[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, at)


def long_array(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64, copy=False))
