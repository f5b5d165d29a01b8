"""Streams of timed triples: sliding windows by batch number, event-time counts, and state kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kg import YEAR_MS, batch_id, checkpointed
from ..operators.filters import recent
from ..operators.mining import edge_instances, grow, support

TRIPLE = "s string, p string, o string, st string, dt string, ts timestamp"


def with_batch(triples: DataFrame, size_ms: int = YEAR_MS) -> DataFrame:
    """The batch comes from the event's time, not from the order in which files arrive."""
    return triples.withColumn("batch", F.coalesce(batch_id(F.col("ts"), size_ms), F.lit(-1)))


def in_window(triples: DataFrame, current: int, window: int) -> DataFrame:
    return triples.where(recent(F.col("batch"), current, window))


def windowed_signatures(stream: DataFrame, length: str = "1095 days", slide: str = "365 days", late: str = "30 days") -> DataFrame:
    """Signature counts of a stream in sliding event-time windows; rows later than the watermark are dropped."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", length, slide), "st", "p", "dt").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "st", "p", "dt", "n")


class SlidingMiner:
    """``foreachBatch`` target: frequent patterns of one and two edges over the last ``window`` batches of event time.

    State is what the mining needs and no more: the edges of the window, and the instances that were grown from edges of
    frequent patterns. A micro-batch adds its edges, and only pairs are grown that have an edge which is new, or whose
    pattern has become frequent; instances with an edge that left the window go. So each result is that of mining the whole
    window anew. The window ends with the latest batch seen so far: late rows within it count, rows before it don't, and it
    never moves back. The state of an epoch is read from the epoch before and written as a table of its own, so a repeated
    micro-batch overwrites its own files and results are exactly once.
    """

    def __init__(self, folder: str, window: int = 3, least: int = 2, size_ms: int = YEAR_MS):
        self.folder, self.window, self.least, self.size_ms = folder, window, least, size_ms

    def _state(self, spark, kind: str, epoch: int) -> DataFrame | None:
        path = f"{self.folder}/{kind}/epoch={epoch}"
        at = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
        return spark.read.parquet(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None

    def __call__(self, micro: DataFrame, epoch: int) -> None:
        spark = micro.sparkSession
        new = checkpointed(edge_instances(with_batch(micro, self.size_ms)).withColumn("fresh", F.lit(True)))
        edges, grown = self._state(spark, "edges", epoch - 1), self._state(spark, "grown", epoch - 1)
        all_ = new if edges is None else new.unionByName(edges)
        current = all_.agg(F.max("batch")).first()[0]
        held = all_ if current is None else in_window(all_, current, self.window)
        # an edge that comes again counts once, in its latest batch
        held = held.groupBy("id").agg(F.first("edges").alias("edges"), F.first("pattern").alias("pattern"), F.max("batch").alias("batch"), F.min("fresh").alias("fresh"))
        counted = support(held).where(F.col("support") >= self.least)
        held = held.join(counted.select("pattern", F.lit(True).alias("now")), "pattern", "left").withColumn("now", F.coalesce("now", F.lit(False)))
        held = checkpointed(held)
        # ``fresh`` stays until an edge's pattern has been frequent once and its pairs were grown
        found, _ = grow(held.where("now").select("id", "edges", "pattern", "batch", "fresh"), fresh=True)
        if grown is not None:
            parts = grown.select("id", F.explode("edges").alias("e")).select("id", F.col("e.id").alias("part"))
            gone = parts.join(held.where("now").select(F.col("id").alias("part")), "part", "left_anti").select("id").distinct()
            found = found.unionByName(grown.join(gone, "id", "left_anti"))
            found = found.groupBy("id").agg(F.first("edges").alias("edges"), F.first("pattern").alias("pattern"), F.max("batch").alias("batch"))
        found = checkpointed(found)
        held.select("id", "edges", "pattern", "batch", (F.col("fresh") & ~F.col("now") | ~F.col("now")).alias("fresh")).write.mode("overwrite").parquet(f"{self.folder}/edges/epoch={epoch}")
        found.write.mode("overwrite").parquet(f"{self.folder}/grown/epoch={epoch}")
        result = counted.unionByName(support(found).where(F.col("support") >= self.least))
        result.withColumn("batch", F.lit(current).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/patterns/epoch={epoch}")
        for kind in ("edges", "grown"):  # the epoch before may be asked for again, older ones aren't
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}/epoch={epoch - 2}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    def history(self, spark) -> DataFrame:
        """(pattern, support, batch, epoch) of all windows so far."""
        return spark.read.parquet(f"{self.folder}/patterns")

    def cumulative(self, spark) -> DataFrame:
        """(pattern, support): the supports of the last window of each batch together; a pattern counts in every window that holds it."""
        h = self.history(spark)
        last = h.groupBy("batch").agg(F.max("epoch").alias("epoch"))
        return h.join(last, ["batch", "epoch"]).groupBy("pattern").agg(F.sum("support").alias("support"))


def start(stream: DataFrame, miner: SlidingMiner, checkpoint: str, trigger: dict | None = None):
    return stream.writeStream.foreachBatch(miner).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
