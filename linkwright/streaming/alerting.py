"""Alerts in the order of event time: the same ones in however many batches the hits arrive.

Hits wait in the state of their rule, a packed sorted array, until the watermark has
passed them; a timer at the first of them hands over all that are final, which are
then judged in the order of their times, each at least a cooldown after the last
alert.  A hit that comes after its time was handed over is dropped.  State and work
of a rule stay with its key: name rules by group (host, user) so that none is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Settings of stateful queries with timers; a store is closed with its task, as each start makes new ones.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "true",
}
#: Milliseconds to which timers are rounded up, so that a busy rule sets few.
SLICE = 60_000


@contextmanager
def settings(spark: SparkSession) -> Iterator[None]:
    """SETTINGS while queries start."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def spaced(times: np.ndarray, last: int | None, cooldown: int) -> list[int]:
    """Places of the sorted times that are at least a cooldown after the one before, or after last."""
    out, k = [], 0
    while (k := k if last is None else max(k, int(np.searchsorted(times, last + cooldown)))) < len(times):
        out.append(k)
        last, k = int(times[k]), k + 1
    return out


class Cooling(StatefulProcessor):
    """Pending hits of a rule (microseconds and values), the last alert, and the time up to which hits were handed over."""

    def __init__(self, cooldown: float):
        self.cooldown = round(cooldown * 1e6)

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("rule", "times binary, values binary, last long, done long, timer long")

    def _read(self) -> tuple[np.ndarray, np.ndarray, int | None, int | None, int | None]:
        got = self.state.get()
        if not got:
            return np.zeros(0, np.int64), np.zeros(0), None, None, None
        return np.frombuffer(got[0], np.int64), np.frombuffer(got[1], np.float64), *got[2:]

    def _write(self, times: np.ndarray, values: np.ndarray, last: int | None, done: int | None, timer: int | None) -> None:
        due = (int(times[0]) // 1000 // SLICE + 1) * SLICE if len(times) else None
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.state.update((times.tobytes(), values.tobytes(), last, done, due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times, values, last, done, timer = self._read()
        if key[0] is None:  # the end mark
            return
        parts = [(df["us"].to_numpy(np.int64), df["value"].to_numpy(np.float64)) for df in rows]
        t, v = (np.concatenate([own, *[p[k] for p in parts]]) for k, own in enumerate((times, values)))
        kept = slice(None) if done is None else t > done
        t, v = t[kept], v[kept]
        order = np.lexsort((v, t))
        self._write(t[order], v[order], last, done, timer)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times, values, last, _, timer = self._read()
        done = timerValues.getCurrentWatermarkInMs() * 1000
        n = int(np.searchsorted(times, done, "right"))
        at = spaced(times[:n], last, self.cooldown)
        self._write(times[n:], values[n:], int(times[at[-1]]) if at else last, done, None if timer == expiredTimerInfo.getExpiryTimeInMs() else timer)
        yield pd.DataFrame({"rule": [key[0]] * len(at), "us": times[at], "value": values[at]})


def alerts(hits: DataFrame, cooldown: float = 300.0, late: str = "1 hour") -> DataFrame:
    """Alerts of a stream of (rule, ts, value): in each rule's order of time, at least cooldown seconds apart; hits more than late behind are dropped.

    Start it within settings().  Hits younger than late behind the newest one wait;
    end_mark() behind the last of them moves the watermark past all.
    """
    rows = hits.select("rule", F.col("ts").cast("timestamp").alias("at"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").cast("double").alias("value"))
    found = rows.withWatermark("at", late).groupBy("rule").transformWithStateInPandas(Cooling(cooldown), "rule string, us long, value double", "append", "EventTime")
    return found.select("rule", F.timestamp_micros("us").alias("ts"), "value")


def end_mark(spark: SparkSession, ts: Column) -> DataFrame:
    """A row that is no hit and only moves the watermark."""
    return spark.range(1).select(F.lit(None).cast("string").alias("rule"), ts.alias("ts"), F.lit(None).cast("double").alias("value"))
