"""Streaming: look-back statistics, alerts with a cooldown, latest progress, and a message queue as a table.

Event time stands in for processing time; results are updated as windows fill.  A
watermark (an hour, or whatever is given) drops rows that are later than that and
bounds the state; without one (None) every row counts and the state of all
windows stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..storage import new_path, stored

WATERMARK = "1 hour"


def _bounded(events: DataFrame, late: str | None) -> DataFrame:
    return events if late is None else events.withWatermark("ts", late)


def sliding_counts(events: DataFrame, key: str, length: str = "60 minutes", slide: str = "1 minute", late: str | None = WATERMARK) -> DataFrame:
    """Counts by key in sliding windows (columns ts and the key)."""
    g = _bounded(events, late).groupBy(F.window("ts", length, slide).alias("w"), key)
    return g.agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def window_stats(events: DataFrame, key: str, value: str, length: str = "5 minutes", late: str | None = WATERMARK) -> DataFrame:
    g = _bounded(events, late).groupBy(F.window("ts", length).alias("w"), key)
    return g.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("highest")).select(F.col("w.start").alias("window_start"), key, "n", "total", "highest")


def cooled(key: Any, frames: Iterator[pd.DataFrame], state: GroupState, cooldown: float) -> Iterator[pd.DataFrame]:
    """Alerts of one rule, at least cooldown seconds apart; the last one's time is the state."""
    last = state.get[0] if state.exists else float("-inf")
    # one sorted array of times and values a batch of the rule: 16 bytes a hit, no frames kept
    parts = [(frame["ts"].to_numpy("datetime64[ns]"), frame["value"].to_numpy(float)) for frame in frames]
    ts, value = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    order = np.argsort(ts, kind="stable")
    ts, value = ts[order], value[order]
    at, kept, k = ts.astype(np.int64) / 1e9, [], 0
    while (k := max(k, int(np.searchsorted(at, last + cooldown)))) < len(at):
        kept.append((key[0], pd.Timestamp(ts[k]), float(value[k])))
        last, k = float(at[k]), k + 1
    if last > float("-inf"):
        state.update((last,))
    yield pd.DataFrame(kept, columns=["rule", "ts", "value"])


def alerts(hits: DataFrame, cooldown: float = 300.0) -> DataFrame:
    """Alerts from rows (rule, ts, value) where the rule's condition holds, once a cooldown."""

    def run(key, frames, state):
        yield from cooled(key, frames, state, cooldown)

    return hits.groupBy("rule").applyInPandasWithState(run, "rule string, ts timestamp, value double", "last double", "append", GroupStateTimeout.NoTimeout)


#: States that end an operation; updates after them don't count.
FINAL = ("completed", "error", "cancelled")


def progress(updates: DataFrame) -> DataFrame:
    """The state of each operation: its first final update, else the latest (columns operation, ts, status, done)."""
    final = F.col("status").isin(*FINAL)
    state = F.struct("status", "done", "ts")
    return updates.groupBy("operation").agg(F.coalesce(F.min_by(F.when(final, state), F.when(final, F.col("ts"))), F.max_by(state, "ts")).alias("s")).select("operation", "s.*")


def run_once(df: DataFrame, mode: str = "update", checkpoint: str | None = None) -> DataFrame:
    """Process what has arrived; a table of the rows that came out, with the number of their batch.

    Each micro-batch is a folder of its own that a repeated batch writes anew, so
    nothing passes through the driver and nothing comes twice.
    """
    spark = df.sparkSession
    path = new_path(spark, "stream")

    def write(frame: DataFrame, number: int) -> None:
        frame.write.mode("overwrite").parquet(f"{path}/batch={number}")

    df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint or new_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    schema = df.schema.add("batch", "long")
    try:
        return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/batch=*")
    except Exception as e:  # no batch has come
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def each_batch(df: DataFrame, handle, checkpoint: str) -> None:
    """handle(frame, batch number) for every micro-batch that has arrived."""
    df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


# ---- a message queue as a table (job_id, priority, created_at, status, retries)


def queue_order(jobs: DataFrame) -> DataFrame:
    """Jobs in the order in which they are taken."""
    return jobs.orderBy(F.desc("priority"), "created_at", "job_id")


def put(jobs: DataFrame) -> DataFrame:
    """New messages: queued, not tried yet."""
    return jobs.withColumns({"status": F.lit("queued"), "retries": F.lit(0)})


def take(messages: DataFrame, n: int) -> DataFrame:
    """The next n queued messages."""
    return queue_order(messages.where("status = 'queued'")).limit(n)


def after_attempt(messages: DataFrame, max_retries: int = 3) -> DataFrame:
    """Messages (retries, acknowledged) after a try: done, queued again with one more retry, or dead."""
    again = F.col("retries") + 1
    status = F.when(F.col("acknowledged"), "done").when(again > max_retries, "dead").otherwise("queued")
    return messages.withColumns({"status": status, "retries": F.when(F.col("acknowledged"), F.col("retries")).otherwise(again)})


def settle(messages: DataFrame, tried: DataFrame, max_retries: int = 3) -> DataFrame:
    """The queue after some of its messages were tried (job_id, acknowledged); the others stay as they are."""
    both = messages.join(tried.select("job_id", "acknowledged"), "job_id", "left")
    again = F.col("retries") + 1
    status = F.when(F.col("acknowledged"), "done").when(~F.col("acknowledged"), F.when(again > max_retries, "dead").otherwise("queued")).otherwise(F.col("status"))
    retries = F.when(~F.col("acknowledged"), again).otherwise(F.col("retries"))
    return both.withColumns({"status": status, "retries": retries}).select(*messages.columns)


def work(messages: DataFrame, handle: Callable[[DataFrame], DataFrame], max_retries: int = 3) -> DataFrame:
    """Try all queued messages until each is done or dead; handle adds the column acknowledged.

    All messages of a round are handled side by side.  A message is tried max_retries
    + 1 times at most, so there are as many rounds, each stored.
    """
    left, out = stored(messages.where("status = 'queued'"), "queue"), messages.where("status != 'queued'")
    for _ in range(max_retries + 1):
        if left.isEmpty():
            break
        tried = stored(after_attempt(handle(left), max_retries).select(*messages.columns), "queue")
        out, left = out.unionByName(tried.where("status != 'queued'")), tried.where("status = 'queued'")
    return out


def dead_letters(messages: DataFrame) -> DataFrame:
    return messages.where("status = 'dead'")


def queue_stats(messages: DataFrame) -> DataFrame:
    """By status: messages, and how often they were tried again."""
    return messages.groupBy("status").agg(F.count("*").alias("n"), F.sum("retries").alias("retries"))
