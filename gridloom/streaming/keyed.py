"""Keyed state over streams: processors with timers on event time, and tallies that a repeated batch does not change.

State lives in the RocksDB store, per key, and goes by timers of event time: a slow
or repeated read of the same events opens the same windows, as the wall clock has
no part in it.  Each processor has a batch twin in `stream` that gives the same rows
over the whole history.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocks(spark: SparkSession) -> None:
    """Keyed processors need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _times(frames: Iterator[pd.DataFrame], column: str) -> np.ndarray:
    """All times of a key in a batch, sorted, in microseconds."""
    return np.sort(np.concatenate([f[column].to_numpy().astype("datetime64[us]").astype(np.int64) for f in frames]))


class Limiter(StatefulProcessor):
    """One (opened, n) a key; the timer of a window's end removes it."""

    def __init__(self, window_us: int, limit: int, expire: bool):
        self.window_us, self.limit, self.expire = window_us, limit, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", "opened long, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        times = _times(rows, "ts")
        opened, n = self.state.get() if self.state.exists() else (None, 0)
        before = opened
        allowed = np.zeros(len(times), bool)
        at = 0
        while at < len(times):  # a window a round
            if opened is None or times[at] - opened >= self.window_us:
                opened, n = int(times[at]), 0
            end = int(np.searchsorted(times, opened + self.window_us))
            allowed[at : at + max(0, min(end - at, self.limit - n))] = True
            n, at = n + end - at, end
        self.state.update((opened, n))
        if self.expire and opened != before:
            if before is not None:
                self.handle.deleteTimer(_end(before, self.window_us))
            self.handle.registerTimer(_end(opened, self.window_us))
        yield pd.DataFrame({"key": [key[0]] * len(times), "ts": times.astype("datetime64[us]"), "allowed": allowed})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and _end(self.state.get()[0], self.window_us) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter([])


def _end(opened: int, window_us: int) -> int:
    """A window's end in milliseconds, rounded up."""
    return -(-(opened + window_us) // 1000)


def limiter_stream(events: DataFrame, key: str, ts: str, limit: int = 10, window_s: int = 60, expire: bool = True, late: str = "0 seconds") -> DataFrame:
    """The limiter over a stream of (key, ts): key, ts, allowed of each event; null keys are a key, null times go.

    A key's state is removed once the watermark (`late` behind the latest event) has
    passed its window's end, at which any further event opens a new window in any case.
    Events of one batch are taken in order of time; one that comes later than the
    watermark is dropped.
    """
    use_rocks(events.sparkSession)
    keyed = events.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts")).filter("ts is not null").withWatermark("ts", late)
    schema = f"key {keyed.schema['key'].dataType.simpleString()}, ts timestamp, allowed boolean"
    return keyed.groupBy("key").transformWithStateInPandas(Limiter(window_s * 1_000_000, limit, expire), schema, "append", "eventTime")


class Appender(StatefulProcessor):
    """What a file (session, name) holds: bytes staged, the size declared for them, and the stored file's size and hash."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("file", "staged long, declared long, size long, sha string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        staged, declared, size, sha = self.state.get() if self.state.exists() else (0, None, None, None)
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            whole = pd.isna(r.offset)
            said = "staged"
            done = False
            if whole:
                said, done = ("whole", True) if r.ok else ("failed", False)
            elif not 0 <= r.offset < r.size:
                said = "invalid"
            elif r.offset and r.offset != staged:
                said = "out of order"
            elif r.offset and declared != r.size:
                said = "other size"
            elif not r.ok:
                staged, declared, said = int(r.offset), int(r.size), "failed"
            elif r.offset + r.length > r.size:
                staged, declared, said = 0, None, "too long"
            else:
                staged, declared = int(r.offset + r.length), int(r.size)
                done = staged == declared
            if done:
                if not whole:
                    staged, declared = 0, None
                if size is None:
                    size, sha, said = int(r.size), r.sha, "stored"
                else:
                    said = "already present" if (size, sha) == (r.size, r.sha) else "conflict"
            out.append((*key, r.seq, said))
        self.state.update((staged, declared, size, sha))
        yield pd.DataFrame(out, columns=["session", "name", "seq", "outcome"])


def append_stream(chunks: DataFrame) -> DataFrame:
    """session, name, seq, outcome of a stream of chunks as `stream.appended` takes them; a batch's chunks of one file count in order of seq."""
    use_rocks(chunks.sparkSession)
    keys = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in ("session", "name", "seq"))
    return chunks.groupBy("session", "name").transformWithStateInPandas(Appender(), f"{keys}, outcome string", "append", "none")


def progress_stream(events: DataFrame) -> DataFrame:
    """stream.progress over a stream, for output mode `update`: each batch gives the rows that changed; done never falls."""
    return events.groupBy("job", "stage").agg(F.max("done").alias("done"), F.max_by("total", "seq").alias("total"), F.max_by("state", "seq").alias("state"))


def tally_stream(files: DataFrame) -> DataFrame:
    """upload, n, bytes of a stream of stored files (upload, bytes), for output mode `update`."""
    return files.groupBy("upload").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


def write_tally(path: str):
    """The foreachBatch function that keeps a tally's changes: one folder a batch, replaced whole when the batch comes again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def read_tally(spark: SparkSession, path: str) -> DataFrame:
    """upload, n, bytes as the last batch that named an upload left them."""
    last = Window.partitionBy("upload").orderBy(F.desc("batch"))
    rows = spark.read.parquet(path).withColumn("_r", F.row_number().over(last))
    return rows.filter("_r = 1").select("upload", "n", "bytes")
