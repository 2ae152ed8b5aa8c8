"""Incremental indexing and event streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def watch(events: DataFrame, index_pass: Callable[[list[str]], None], checkpoint: str, every: str = "1 second", once: bool = False, path: str = "path") -> StreamingQuery:
    """One pass for each micro-batch, with the distinct paths as hints; changes in between wait for the next.

    The pass itself compares a whole scan with the manifest. ``events`` are paths of any
    stream; ``sources.changes`` tells of deletions, ``coalesced`` waits for quiet.
    """

    def batch(df: DataFrame, _: int) -> None:
        hints = [r[0] for r in df.select(path).distinct().limit(1000).collect()]  # hints, not the work list
        if hints:
            index_pass(hints)

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def final_messages(events: DataFrame) -> DataFrame:
    """Assistant messages that are completed, and every other kind of event."""
    return events.where((F.col("event") != "message") | ((F.col("role") == "assistant") & F.col("completed").isNotNull()))


def append_events(events: DataFrame, path: str, checkpoint: str, every: str = "1 second", once: bool = False) -> StreamingQuery:
    """Append the final messages and all other events to a log of JSON lines, each exactly once."""
    writer = final_messages(events).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def windowed(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts and sums by event type and window, late events beyond ``late`` left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def _with_timers(df: DataFrame) -> None:
    """Timers and state that ends are kept by the RocksDB store alone."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Quiet(StatefulProcessor):
    """Holds a path's events until none has come for ``quiet_ms``: every event puts the path's one timer off."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "change string, events long, due long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        change, n, due = self.held.get() if self.held.exists() else (None, 0, None)
        for pdf in rows:
            change, n = pdf["change"].iloc[-1], n + len(pdf)
        if due is not None:
            self.handle.deleteTimer(due)
        due = timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms
        self.handle.registerTimer(due)
        self.held.update((change, n, due))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        change, n, _ = self.held.get()
        self.held.clear()
        yield pd.DataFrame({"path": [key[0]], "change": [change], "events": [n]})

    def close(self) -> None:
        pass


def coalesced(events: DataFrame, quiet_s: float = 0.3) -> DataFrame:
    """(path, change, events) of a stream of (path, change): a path once, when nothing has come of it for ``quiet_s``, with its last change and the number of its events.

    Time is that of the batches, so a path waits for a batch after its quiet time; batches go on
    without input until the query is stopped (a trigger of what is there now would never end). Of events of one path in one batch any may count as the last. State is held for
    waiting paths alone.
    """
    _with_timers(events)
    grouped = events.select("path", "change").groupBy("path")
    return grouped.transformWithStateInPandas(_Quiet(max(1, int(quiet_s * 1000))), "path string, change string, events long", "Append", "ProcessingTime")


class _Allowed(StatefulProcessor):
    """Decides on a signature's events by the last allowed one, their number and the latest event; ``idle_s`` after that a new session begins."""

    def __init__(self, cooldown_s: float, most: int, idle_s: float):
        self.cooldown_s, self.most, self.idle_s = cooldown_s, most, idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last double, n long, at double, due long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last, n, at, due = self.seen.get() if self.seen.exists() else (None, 0, None, None)
        ts = pd.concat([pdf["ts"] for pdf in rows]).sort_values()
        out = []
        for t in ts:
            s = t.timestamp()
            if at is not None and s - at > self.idle_s:
                last, n = None, 0
            ok = n < self.most and (last is None or s - last >= self.cooldown_s)
            if ok:
                last, n = s, n + 1
            at = s if at is None else max(at, s)
            out.append(ok)
        if due is not None:
            self.handle.deleteTimer(due)
        due = int((at + 2 * self.idle_s) * 1000) + 1  # whatever is not too late by then begins a new session
        self.handle.registerTimer(due)
        self.seen.update((last, n, at, due))
        yield pd.DataFrame({"signature": key[0], "ts": ts.to_numpy(), "allowed": out})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def allowed(events: DataFrame, cooldown_s: float, most: int, idle_s: float = 86400) -> DataFrame:
    """(signature, ts, allowed) of a stream of (signature, ts) without a watermark: at least ``cooldown_s`` since the last allowed one, ``most`` in a session.

    A session ends when a signature has no event for ``idle_s`` (never less than the cool-down); then
    it is forgotten, its budget with it, so state does not grow with all signatures that ever were.
    All times are those of the events, so the same events give the same rows whenever they are read;
    events more than ``idle_s`` behind the latest of earlier batches are left out.
    """
    _with_timers(events)
    idle_s = max(idle_s, cooldown_s)
    until = (F.col("ts") + F.expr(f"interval {int(idle_s * 1000)} milliseconds")).alias("until")  # a session's end if no event follows
    grouped = events.select("signature", "ts", until).withWatermark("until", f"{int(idle_s * 1000)} milliseconds").groupBy("signature")
    return grouped.transformWithStateInPandas(_Allowed(cooldown_s, most, idle_s), "signature string, ts timestamp, allowed boolean", "Append", "EventTime")
