"""Expiring click deduplication: a stateful stream that keeps open windows of clicks in packed blobs.

A click opens a window; copies of the same click_id up to WINDOW hours after the
window's start are repeats of it, a later one closes it and opens another.  Windows
that no admissible copy can reach any more close by themselves.

The stream.  Copies arrive in batches; the watermark is the greatest hour of
earlier batches less LATE hours, and what lies before it is dropped.  Copies that are
alike are counted when the batches are cut, in part before any shuffle, and come as
one row with their number.  The state isn't kept by click but by shard, a hash range
of click ids whose number follows the input: one Arrow-packed blob of sorted arrays
holds the open windows of a shard.  A shard's rows of a batch are sorted once, met
with the blob by a merge join of sorted ids, and folded in rounds: each round extends
the present windows of all clicks at once and opens the next ones.  One event-time
timer a shard stands at its earliest deadline; when it fires, the expired windows are
masked out and the blob is rewritten.

A start of the query runs one micro-batch.  Its watermark is the one after the batch
before, in whose name what has expired is closed first, and by which late copies are
dropped (Spark's own filter would lag a micro-batch behind without empty ones
between).  The last batch has an end mark for each shard, whose rows so are all
called, and what is open then closes in it: no micro-batch follows.

Batches are written once and moved one by one into the folder that the stream
watches; the query is started anew for each on one checkpoint, so a failed start is
repeated from the checkpoint.  Nothing of the rows passes through the driver (it
sees extremes and a count).

Defined results.  A null click_id is an id of its own with one copy (so is a negative
one's only copy j = 0).  A row without arrived_at has no hour and is in no batch.
Null fields are empty in the hash; a value that isn't a number counts as 0 there.
Repeated rows are copies that repeat the window's opener.  Ties of hour and hash are
equal copies.  Extra columns aren't read.  An empty table has no windows.  Long
props only enter the hash.  Copies of one click_id that differ meet in one task with
their shard; equal ones of a batch are one row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..storage import delete, new_path
from . import textbatch as tb

WINDOW, LATE, BATCHES = 72, 48, 12
#: Rows of the input for a shard.
SHARD_ROWS = 50_000
#: Fixed values of the copies: hours between them, spread of lateness in hours.
STEP, SPREAD, DELAY = 6, 10, 200

COPY = "shard int, known boolean, click_id long, hour long, at timestamp, hash binary, n long"
RESULT = "known boolean, click_id long, start_hour long, closed_batch long, n_repeats long, n_conflicts long, conflict_crc long, hash binary"
_HOUR = 3_600_000
CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    # a store holds a few blobs: its buffers needn't be those of a large database
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    "spark.sql.streaming.stateStore.rocksdb.blockCacheSizeMB": "4",
    # a store is opened for its task and closed again: each start of the query makes new ones, of some MB of disk each
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    # each commit of a store writes a small file: a second one with its checksum costs as much again, and file systems keep their own
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
}


# --- copies and batches -------------------------------------------------------


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 in UTC; a timestamp without a zone counts as UTC, whatever the session's zone."""
    c = F.col(f"`{column}`")
    if dict(df.dtypes)[column] != "timestamp_ntz":
        return F.unix_micros(c)
    days, seconds = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long"), F.expr(f"cast(extract(SECOND FROM `{column}`) * 1000000 AS long)")
    return days * 86_400_000_000 + F.hour(c).cast("long") * 3_600_000_000 + F.minute(c).cast("long") * 60_000_000 + seconds


def copies(clicks: DataFrame) -> DataFrame:
    """known, click_id (0 if null), hour, late (the hour of arrival) and hash of every copy of every row that has an hour."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    last = F.greatest(F.coalesce(F.col("click_id") % 3, F.lit(0)), F.lit(0)).cast("int")
    cents = F.floor(F.lit(100.0) * F.col("value") + F.lit(0.5))
    fields = [F.col("client_id"), F.col("kind"), cents, micros(clicks, "ts"), F.col("props")]
    rows = clicks.select("click_id", F.floor(micros(clicks, "arrived_at") / F.lit(3_600_000_000)).cast("long").alias("h"), F.concat_ws("|", *[text(c) for c in fields], F.lit("")).alias("row"), last.alias("last"))
    each = rows.where("h IS NOT NULL").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("last"))))
    each = each.withColumn("c", F.crc32(F.concat(text(F.col("click_id")), F.lit(":"), F.col("j").cast("string")).cast("binary")))
    hour = F.col("h") + STEP * F.col("j") * (F.col("c") % SPREAD)
    digest = F.unhex(F.sha2(F.concat("row", (F.col("c") % 3).cast("string")).cast("binary"), 256))
    late = hour + F.floor(F.col("c") / SPREAD) % DELAY
    return each.select(F.col("click_id").isNotNull().alias("known"), F.coalesce("click_id", F.lit(0)).alias("click_id"), hour.cast("long").alias("hour"), late.cast("long").alias("late"), digest.alias("hash"))


def batch_of(late: Column, least: int, most: int, batches: int) -> Column:
    return F.floor((late - F.lit(least)) * batches / F.lit(most - least + 1)).cast("int")


# --- the fold -------------------------------------------------------------------


class Windows:
    """Sorted struct of arrays: known, id, start, repeats, conflicts, crc, and hash as four big-endian words."""

    KINDS = {"known": np.bool_, "id": np.int64, "start": np.int64, "repeats": np.int64, "conflicts": np.int64, "crc": np.int64}

    def __init__(self, **columns: np.ndarray):
        self.columns = columns

    def __getattr__(self, name: str) -> np.ndarray:
        try:
            return self.__dict__["columns"][name]
        except KeyError:
            raise AttributeError(name) from None

    def __len__(self) -> int:
        return len(self.id)

    @classmethod
    def none(cls) -> Windows:
        return cls(**{k: np.zeros(0, t) for k, t in cls.KINDS.items()}, hash=np.zeros((0, 4), np.uint64))

    def where(self, which: np.ndarray) -> Windows:
        return Windows(**{k: x[which] for k, x in self.columns.items()})

    def joined(self, other: Windows) -> Windows:
        both = Windows(**{k: np.concatenate([x, other.columns[k]]) for k, x in self.columns.items()})
        return both.where(np.lexsort((both.id, both.known)))

    def packed(self) -> bytes:
        arrays = [pa.array(self.columns[k]) for k in self.KINDS] + [pa.array(self.hash[:, k]) for k in range(4)]
        sink = pa.BufferOutputStream()
        table = pa.RecordBatch.from_arrays(arrays, names=[*self.KINDS, "h0", "h1", "h2", "h3"])
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_batch(table)
        return sink.getvalue().to_pybytes()

    @classmethod
    def unpacked(cls, blob: bytes | None) -> Windows:
        if not blob:
            return cls.none()
        table = pa.ipc.open_stream(blob).read_next_batch()
        read = lambda k: table.column(k).to_numpy(zero_copy_only=False)
        return cls(**{k: read(k) for k in cls.KINDS}, hash=np.stack([read(f"h{k}") for k in range(4)], axis=1))


def as_words(hashes: list[bytes]) -> np.ndarray:
    """32-byte hashes as rows of four words that sort like their bytes."""
    return np.frombuffer(b"".join(hashes), ">u8").astype(np.uint64).reshape(-1, 4)


def as_bytes(words: np.ndarray) -> list[bytes]:
    raw = words.astype(">u8").tobytes()
    return [raw[i : i + 32] for i in range(0, len(raw), 32)]


def counted(known: np.ndarray, ids: np.ndarray, hour: np.ndarray, words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows in the order of id, hour and hash, equal ones as one with their counts added."""
    order = np.lexsort((words[:, 3], words[:, 2], words[:, 1], words[:, 0], hour, ids, known))
    known, ids, hour, words, n = known[order], ids[order], hour[order], words[order], n[order]
    new = np.ones(len(ids), bool)
    new[1:] = (known[1:] != known[:-1]) | (ids[1:] != ids[:-1]) | (hour[1:] != hour[:-1]) | (words[1:] != words[:-1]).any(axis=1)
    head = np.flatnonzero(new)
    return known[head], ids[head], hour[head], words[head], np.add.reduceat(n, head) if len(head) else n[:0]


def fold(state: Windows, rows: tuple[np.ndarray, ...], window: int = WINDOW) -> tuple[Windows, Windows]:
    """(open, closed) windows after the rows, which are as counted() gives them."""
    known, ids, hour, words, n = rows
    if not len(ids):
        return state, Windows.none()
    new = np.ones(len(ids), bool)
    new[1:] = (known[1:] != known[:-1]) | (ids[1:] != ids[:-1])
    head, group = np.flatnonzero(new), np.cumsum(new) - 1
    stop = np.r_[head[1:], len(ids)]
    # merge join with the state: the null id, if any, stands first in both
    nulls = int((~state.known).sum())
    at = nulls + np.searchsorted(state.id[nulls:], ids[head])
    at[~known[head]] = 0
    there = np.minimum(at, max(len(state) - 1, 0))
    have = (state.known[there] == known[head]) & (state.id[there] == ids[head]) if len(state) else np.zeros(len(head), bool)

    # windows so far: those of the state that rows meet, then new ones as the rounds open them
    met = state.where(at[have])
    owner, first_row, opener = [np.flatnonzero(have)], [head[have]], [np.full(int(have.sum()), -1)]
    starts = [met.start]
    fresh = np.flatnonzero(~have)
    owner.append(fresh), first_row.append(head[fresh]), opener.append(head[fresh]), starts.append(hour[head[fresh]])
    active, start, place = np.concatenate(owner), np.concatenate(starts), np.concatenate(first_row)
    low = int(hour.min())
    span = int(hour.max()) - low + 2
    key = group * span + (hour - low)
    while len(active):
        to = np.searchsorted(key, active * span + np.clip(start + window - low, -1, span - 1), "right")
        to = np.minimum(np.maximum(to, place), stop[active])
        more = to < stop[active]
        active, place = active[more], to[more]
        start = hour[place]
        owner.append(active), first_row.append(place), opener.append(place), starts.append(start)
    owner, first_row, opener, starts = (np.concatenate(x) for x in (owner, first_row, opener, starts))
    # in the order of rows; a state's window without rows of its own comes before the one that its first row opened
    order = np.lexsort((opener, first_row, owner))
    of_state = opener < 0
    number = np.cumsum(of_state) - 1  # among the met ones
    total = {k: np.where(of_state, met.columns[k][number] if len(met) else 0, 0) for k in ("repeats", "conflicts", "crc")}
    hashes = words[np.maximum(opener, 0)]
    if len(met):
        hashes[of_state] = met.hash
    owner, first_row, of_state, starts, hashes = owner[order], first_row[order], of_state[order], starts[order], hashes[order]
    total = {k: x[order] for k, x in total.items()}
    window_of = np.repeat(np.arange(len(owner)), np.diff(np.r_[first_row, len(ids)]))
    unlike = (words != hashes[window_of]).any(axis=1)
    add = lambda x: np.bincount(window_of, weights=x, minlength=len(owner)).astype(np.int64)
    crc = np.zeros(len(ids), np.int64)
    crc[unlike] = [zlib.crc32(x.hex().encode()) for x in as_bytes(words[unlike])]
    exact = np.zeros(len(owner), np.int64)
    np.add.at(exact, window_of, crc * n)
    out = Windows(known=known[head[owner]], id=ids[head[owner]], start=starts, repeats=total["repeats"] + add(n) - ~of_state, conflicts=total["conflicts"] + add(n * unlike), crc=total["crc"] + exact, hash=hashes)
    last = np.r_[owner[1:] != owner[:-1], True]
    rest = np.ones(len(state), bool)
    rest[at[have]] = False
    return state.where(rest).joined(out.where(last)), out.where(~last)


# --- the stream -----------------------------------------------------------------


class Expiring(StatefulProcessor):
    """Open windows of a shard in one blob; gives the windows that close.

    before: the last batch with rows before this one, after which the watermark was
    set; last: all windows close, of each shard that has rows.
    """

    def __init__(self, batch: int, before: int, offset: int, last: bool, window: int):
        self.batch, self.before, self.offset, self.last, self.window = batch, before, offset, last, window

    def init(self, handle) -> None:
        self.handle = handle
        self.blob = handle.getValueState("windows", "blob binary")

    def _state(self) -> Windows:
        got = self.blob.get()
        return Windows.unpacked(got[0] if got else None)

    def _deadline(self, state: Windows) -> int | None:
        return (int(state.start.min()) + self.window) * _HOUR + self.offset if len(state) else None

    def _keep(self, before: int | None, state: Windows) -> None:
        after = self._deadline(state)
        if before is not None and before != after:
            self.handle.deleteTimer(before)
        if after is not None and before != after:
            self.handle.registerTimer(after)
        if len(state):
            self.blob.update((state.packed(),))
        else:
            self.blob.clear()

    def _expired(self, state: Windows, watermark: int) -> np.ndarray:
        """Windows whose deadline has passed; it had after the batch before."""
        return (state.start + self.window) * _HOUR + self.offset < watermark

    def _result(self, closed: Windows, batch: int) -> pd.DataFrame:
        return pd.DataFrame({
            "known": closed.known, "click_id": closed.id, "start_hour": closed.start, "closed_batch": np.full(len(closed), batch, np.int64),
            "n_repeats": closed.repeats, "n_conflicts": closed.conflicts, "conflict_crc": closed.crc, "hash": pd.Series(as_bytes(closed.hash), dtype=object),
        })

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = []
        for df in rows:
            df = df[df["hash"].notna()]
            parts.append((df["known"].to_numpy(bool), df["click_id"].to_numpy(np.int64), df["hour"].to_numpy(np.int64), as_words(df["hash"].tolist()), df["n"].to_numpy(np.int64)))
        state, watermark = self._state(), timerValues.getCurrentWatermarkInMs()
        before = self._deadline(state)
        gone = self._expired(state, watermark)
        known, ids, hour, words, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        early = hour * _HOUR + self.offset >= watermark
        after, closed = fold(state.where(~gone), counted(known[early], ids[early], hour[early], words[early], n[early]), self.window)
        self._keep(before, Windows.none() if self.last else after)
        yield self._result(state.where(gone), self.before)
        yield self._result(closed, self.batch)
        if self.last:
            yield self._result(after, self.batch)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self._state()
        gone = self._expired(state, timerValues.getCurrentWatermarkInMs())
        before = self._deadline(state)
        self._keep(None if before == expiredTimerInfo.getExpiryTimeInMs() else before, state.where(~gone))
        yield self._result(state.where(gone), self.before)

    def close(self) -> None:
        tb.release()


def closed_windows(stream: DataFrame, batch: int, before: int, offset: int, last: bool, window: int = WINDOW, late: int = LATE) -> DataFrame:
    """The windows that close, of a stream of COPY rows whose `at` is their hour plus offset milliseconds; RESULT columns."""
    marked = stream.withWatermark("at", f"{late} hours 1 millisecond")
    return marked.groupBy("shard").transformWithStateInPandas(Expiring(batch, before, offset, last, window), RESULT, "append", "EventTime")


@contextmanager
def _settings(spark: SparkSession, **more: str) -> Iterator[None]:
    own = CONF | {f"spark.sql.streaming.{k}": v for k, v in more.items()}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def deduplicate(clicks: DataFrame, batches: int = BATCHES, window: int = WINDOW, late: int = LATE) -> DataFrame:
    """click_id, start_hour, closed_batch, n_repeats, n_conflicts, conflict_crc and hash (hex) of every window."""
    spark, each = clicks.sparkSession, copies(clicks)
    ends = each.agg(F.min("late").alias("least"), F.max("late").alias("most"), F.min("hour").alias("first"), F.max("hour").alias("last"), F.count("*").alias("n")).first()
    root = new_path(spark, "clicks")
    result = spark.read.schema(RESULT)
    if ends["n"]:
        shards = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-ends["n"] // SHARD_ROWS))
        offset = (1 - ends["first"]) * _HOUR  # all event times lie after 1970, where Spark's first watermark stands
        at = lambda hour: F.timestamp_millis(hour * _HOUR + F.lit(offset))
        shard = F.pmod(F.xxhash64("known", "click_id"), F.lit(shards)).cast("int")
        keys = ["batch", "shard", "known", "click_id", "hour", "hash"]
        dealt = each.withColumns({"batch": batch_of(F.col("late"), ends["least"], ends["most"], batches), "shard": shard}).groupBy(*keys).agg(F.count("*").alias("n"))
        dealt.select("shard", "known", "click_id", "hour", at(F.col("hour")).alias("at"), "hash", "n", "batch").write.partitionBy("batch").parquet(f"{root}/dealt")
        values = {"shard": F.col("id").cast("int"), "known": F.lit(False), "click_id": F.lit(0).cast("long"), "hour": F.lit(ends["last"]).cast("long"), "at": at(F.lit(ends["last"]).cast("long")), "hash": F.lit(None).cast("binary"), "n": F.lit(0).cast("long")}
        spark.range(0, shards, 1, 1).select(*[c.alias(k) for k, c in values.items()]).write.parquet(f"{root}/dealt/end")
        before = -1
        for batch in range(batches):
            last = batch == batches - 1
            some = _next(spark, f"{root}/dealt/batch={batch}", f"{root}/in/{batch}")
            if last:
                _next(spark, f"{root}/dealt/end", f"{root}/in/end")
            with _settings(spark, **{"noDataMicroBatches.enabled": "false"}):
                stream = spark.readStream.schema(COPY).option("recursiveFileLookup", "true").parquet(f"{root}/in")
                found = closed_windows(stream, batch, before, offset, last, window, late)
                sink = found.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
                sink.trigger(availableNow=True).start().awaitTermination()
            before = batch if some else before
        for folder in ("dealt", "in", "state"):
            delete(spark, f"{root}/{folder}")
        rows = result.parquet(f"{root}/out")
    else:
        rows = spark.createDataFrame([], RESULT)
    return rows.select(F.when(F.col("known"), F.col("click_id")).alias("click_id"), "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc", F.lower(F.hex("hash")).alias("hash"))


def _next(spark: SparkSession, source: str, target: str) -> bool:
    """Move a folder, if it is there, to where the stream looks; tells whether it was."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    at, to = path(source), path(target)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(to.getParent())
    if not fs.exists(at):
        return False
    if not fs.rename(at, to):
        raise OSError(f"{source} can't be moved to {target}")
    return True
