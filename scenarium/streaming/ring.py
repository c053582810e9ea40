"""Ring buffers as keyed state of a stream: a percentile once the buffer is full, and a line refitted now and then; the same over tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "seen long, slope double, intercept double, xs array<double>, ys array<double>"


def _finite(rows: DataFrame, x: str, y: str) -> Column:
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    return ok(x) & ok(y)


def ring_over_table(rows: DataFrame, key: str, order: list[str], x: str, y: str, size: int, every: int, percentile: float) -> DataFrame:
    """``rows`` of finite x and y with ``limit``, ``slope`` and ``intercept``.

    ``limit`` is the percentile of the last ``size`` y of the key, null until there are as many. The line of y over x through the
    last ``size`` observations is refitted at each ``every``-th and kept in between; null before the first fit, or where all x are equal.
    """
    whole = W.partitionBy(key).orderBy(*order)
    last = whole.rowsBetween(1 - size, 0)
    x_, y_ = F.col(x).cast("double"), F.col(y).cast("double")
    out = rows.where(_finite(rows, x, y)).withColumn("_n", F.row_number().over(whole))
    out = out.withColumn("limit", F.when(F.col("_n") >= size, F.percentile(y_, F.lit(percentile)).over(last)))
    fit = F.struct(F.regr_slope(y_, x_).over(last).alias("slope"), F.regr_intercept(y_, x_).over(last).alias("intercept"))
    out = out.withColumn("_fit", F.when(F.col("_n") % every == 0, fit))
    out = out.withColumn("_fit", F.last("_fit", ignorenulls=True).over(whole.rowsBetween(W.unboundedPreceding, 0)))
    return out.select(*rows.columns, "limit", F.col("_fit.slope").alias("slope"), F.col("_fit.intercept").alias("intercept"))


class _Ring(StatefulProcessor):
    def __init__(self, order: list[str], x: str, y: str, size: int, every: int, percentile: float) -> None:
        self.order, self.x, self.y, self.size, self.every, self.percentile = order, x, y, size, every, percentile

    def init(self, handle) -> None:
        self.ring = handle.getValueState("ring", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, slope, intercept, xs, ys = self.ring.get() if self.ring.exists() else (0, None, None, [], [])
        xs, ys = list(xs), list(ys)
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        limits, lines = [], []
        for x, y in zip(batch[self.x].astype(float), batch[self.y].astype(float), strict=True):
            xs, ys, seen = [*xs, x][-self.size :], [*ys, y][-self.size :], seen + 1
            if seen % self.every == 0:
                d = np.array(xs) - np.mean(xs)
                spread = float(d @ d)
                slope = float(d @ np.array(ys)) / spread if spread else None
                intercept = float(np.mean(ys) - slope * np.mean(xs)) if spread else None
            limits.append(float(np.percentile(ys, 100 * self.percentile)) if len(ys) == self.size else None)
            lines.append((slope, intercept))
        self.ring.update((seen, slope, intercept, xs, ys))
        yield batch.assign(limit=pd.array(limits, dtype="Float64"), slope=pd.array([s for s, _ in lines], dtype="Float64"), intercept=pd.array([i for _, i in lines], dtype="Float64"))

    def close(self) -> None:
        pass


def ring_over_stream(stream: DataFrame, key: str, order: list[str], x: str, y: str, size: int, every: int, percentile: float) -> DataFrame:
    """The same of a stream: a key's ``size`` last observations, count and line are its state, so that a restarted query goes on where it was.

    Rows of a batch are taken by ``order``, batches as they come: what comes late counts when it comes. The state of a key is as large as its buffer. Keyed
    state needs the RocksDB store, which is set on the session.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    ring = _Ring(order, x, y, size, every, percentile)
    rows = stream.where(_finite(stream, x, y)).groupBy(key)
    return rows.transformWithStateInPandas(statefulProcessor=ring, outputStructType=f"{kinds}, limit double, slope double, intercept double", outputMode="Append", timeMode="None")
