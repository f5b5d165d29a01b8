"""Exact deduplication by deterministic block naming.

Every text is cut into blocks of a fixed number of characters. The blocks of all documents are sorted
within hash partitions, and equal blocks get the same integer name: the partition's number and the block's
ordinal in it, so names are unique without a central counter. Adjacent pairs of names are then named in the
same way, which halves a document's sequence, until one name is left. (level, name) is equal for two
documents exactly if their texts are equal; no hash takes part in the comparison.

The text itself is shuffled once; all later rounds move integers only. The number of rounds is the logarithm
of the longest document's number of blocks.

Blocks and pairs that many rows share are salted: such a key gets as many salts as it has shares of a quarter
partition, its rows are named under each salt apart, and the names of one key are unified. Which keys are hot is
decided by counts of a 64-bit hash, which takes no part in the names. At most ``2 * SHARES`` keys and salts a
partition come of this, so the two small tables that are broadcast have a proven bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_order, keyed, packed, real_id, unpacked

BLOCK_CHARS = 2048
SHARES = 4
_OUT = "doc_id long, tag long, pos int, most int, name long, first boolean"


def _namer(keys: list[str]):
    """Names sorted rows; ``first`` marks one row of each name of a salted key, and only that one carries the key."""

    def run(batches):
        from pyspark import TaskContext

        name, last = (TaskContext.get().partitionId() << 33) - 1, None
        by = [*keys, "salt"]
        for b in batches:
            if not len(b):
                continue
            change = np.zeros(len(b), bool)
            for k in by:
                c = b.column(k)
                if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
                    c = c.dictionary_encode().indices
                x = c.to_numpy(zero_copy_only=False)
                change[1:] |= x[1:] != x[:-1]
            change[0] = last != tuple(b.column(k)[0].as_py() for k in by)
            names = name + np.cumsum(change)
            name, last = int(names[-1]), tuple(b.column(k)[-1].as_py() for k in by)
            first = pa.array(change & (b.column("salt").to_numpy() > 0))
            shown = [pc.if_else(first, b.column(k), pa.scalar(None, b.column(k).type)) for k in keys]
            rest = [b.column(c) for c in ("doc_id", "tag", "pos", "most")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(names), first, *shown], ["doc_id", "tag", "pos", "most", "name", "first", *keys])

    return run


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(doc_id, tag, pos, most, name): equal keys come to lie side by side in one partition and get one name."""
    spark = rows.sparkSession
    near = F.xxhash64(*keys)
    counts = cut(rows.groupBy(near.alias("near")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(total // (SHARES * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)), 1000)
    hot = counts.where(F.col("n") > least).select("near", F.expr(f"cast(n div {least} as int) + 1").alias("salts"))
    some = not hot.isEmpty()
    if some:
        salt = F.coalesce(F.expr("cast(pmod(xxhash64(doc_id, tag, pos, spark_partition_id()), salts) as int) + 1"), F.lit(0))
        salted = rows.withColumn("near", near).join(F.broadcast(hot), "near", "left").withColumn("salt", salt)
    else:
        salted = rows.withColumn("salt", F.lit(0))
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    named = salted.select("doc_id", "tag", "pos", "most", *keys, "salt").repartition(*keys, "salt").sortWithinPartitions(*keys, "salt")
    named = cut(named.mapInArrow(_namer(keys), f"{_OUT}, {kinds}"))
    if not some:
        return named.select("doc_id", "tag", "pos", "most", "name")
    one = named.where("first").groupBy(*keys).agg(F.min("name").alias("one"), F.collect_set("name").alias("names")).where("size(names) > 1")
    one = one.select("one", F.explode("names").alias("name")).where("one != name")  # no more than salts
    return named.join(F.broadcast(one), "name", "left").select("doc_id", "tag", "pos", "most", F.coalesce("one", "name").alias("name"))


def identities(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, tag, level, name), one row for each distinct (doc_id, text); null texts have none.

    An empty text is one empty block. A null doc_id is NO_ID here.
    """
    cuts = F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % block_chars), F.lit(0))
    blocks = keyed(docs).where("text is not null").select("doc_id", "tag", F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(cuts).alias("blocks"))
    rows = blocks.select("doc_id", "tag", (F.size("blocks") - 1).alias("most"), F.posexplode("blocks").alias("pos", "block"))
    named, done, level = _named(rows, ["block"]), [], 0
    while True:
        doc = ["doc_id", "tag"]
        done.append(named.where("most = 0").select(*doc, F.lit(level).alias("level"), "name").distinct())
        rest = named.where("most > 0").groupBy(*doc, F.expr("cast(pos div 2 as int)").alias("pos"), F.expr("cast(most div 2 as int)").alias("most")).agg(
            F.coalesce(F.max(F.when(F.expr("pos % 2 = 0"), F.col("name"))), F.lit(-1)).alias("a"),
            F.coalesce(F.max(F.when(F.expr("pos % 2 = 1"), F.col("name"))), F.lit(-1)).alias("b"),
        )
        rest = cut(rest)
        if rest.isEmpty():
            break
        named, level = _named(rest, ["a", "b"]), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return cut(out)


def _groups(ids: DataFrame) -> DataFrame:
    """(level, name, least, tag, copies) of each text, from partial aggregates."""
    return ids.groupBy("level", "name").agg(F.min("doc_id").alias("least"), F.min("tag").alias("tag"), F.count(F.lit(1)).alias("copies"))


def exact_duplicates(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, duplicate_of, copies): every document whose text another with a smaller doc_id has, that
    smallest doc_id, and how many documents have the text.

    Null texts equal nothing. Empty texts equal each other. Texts of any length are compared whole. Rows that repeat
    doc_id and text count once; a null doc_id sorts first and stays null. An empty table gives no rows; further
    columns are not read.
    """
    ids = identities(docs, block_chars)
    groups = cut(_groups(ids).where("copies > 1").drop("tag"))  # its own shuffle, so that AQE can split a hot group in the join
    both = ids.join(groups, ["level", "name"]).where("doc_id != least")
    return both.select(real_id(), F.col("least").alias("duplicate_of"), "copies").select("doc_id", real_id("duplicate_of"), "copies")


def drop_exact_duplicates(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with one row of each text: that of the smallest doc_id. Of rows that share doc_id and text the one
    that is least in its columns, taken in the order of ``docs`` (nulls first), stays.

    Rows with a null text all stay; empty texts equal each other; texts of any length are compared whole. The columns
    are those of ``docs``, whatever their names. An empty table stays empty.
    """
    keep = _groups(identities(docs, block_chars)).select(F.col("least").alias("doc_id"), "tag")
    rows = keyed(docs, packed(docs).alias("row"), F.struct(*in_order(docs.drop("text"))).alias("rank"))
    # repeated rows go before the shuffle, so that one row many times over is no hot key
    one = rows.where("text is not null").groupBy("doc_id", "tag").agg(F.min_by("row", "rank").alias("row"))
    kept = one.join(keep, ["doc_id", "tag"]).select("row")
    return unpacked(kept.unionByName(rows.where("text is null").select("row")), "row", docs.columns)
