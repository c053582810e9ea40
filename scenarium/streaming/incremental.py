"""Incremental work and ring buffers as Structured Streaming; the windowed aggregate is an extension of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Folders of the results, which a batch can read one by one.
PARTS = 64


def process_new(stream: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Each batch leaves out what ``out`` already has, so that a restart or a repeated input does no work twice.

    ``out`` is in PARTS folders by a hash of the key, of which a batch reads those that it has keys of. ``work`` keeps the key.
    """
    part = "_part"

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        fresh = fresh.withColumn(part, F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int"))
        try:
            done = spark.read.parquet(out)
        except AnalysisException:  # nothing is there yet
            done = None
        if done is not None:
            # only the parts that the batch falls into are read
            parts = [r[0] for r in fresh.select(part).distinct().collect()]
            fresh = fresh.join(done.where(F.col(part).isin(parts)).select(key), key, "left_anti")
        work(fresh.drop(part)).withColumn(part, F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")).write.mode("append").partitionBy(part).parquet(out)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_n(rows: DataFrame, key: str, order: list[str], value: str, n: int, aggregate: Callable[[Column], Column] = F.avg) -> DataFrame:
    """The aggregate over the last ``n`` observations up to each one, null until there are ``n``."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(1 - n, 0)
    full = F.count(value).over(w) == n
    return rows.withColumn("last_n", F.when(full, aggregate(F.col(value)).over(w)))


def windowed_counts(events: DataFrame, late: str = "10 minutes", length: str = "5 minutes") -> DataFrame:
    """Extension: counts and sums in tumbling event-time windows behind a watermark; works on streams and tables."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
