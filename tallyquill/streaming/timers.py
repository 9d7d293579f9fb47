"""Debouncing and idle reports as streams with state and timers.

An event waits in its path's state until the watermark has passed it, and waiting events are taken in order
of time when a timer fires. So events may arrive in any order inside the watermark, and the
stream gives what the batch gives. State is a few numbers per path and one per waiting event; a path that has nothing
waiting and nothing left to decide is cleared.

Timers and state of this kind need Spark's RocksDB state store (``ROCKSDB``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyquill.operators import events as ev

#: The setting a session needs to start these streams.
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}


class _Waiting(StatefulProcessor):
    """Keeps (at, event_id) until the watermark has passed them, then hands them on in order."""

    state = "last bigint, count bigint, at array<bigint>, event_id array<bigint>"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", self.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, count, at, id = self._load()
        parts = [(at, id)]
        for batch in rows:
            parts.append((batch["at"].to_numpy(dtype=np.int64), batch["event_id"].to_numpy(dtype=np.int64)))
        at, id = (np.concatenate([part[i] for part in parts]) for i in (0, 1))
        yield self._turn(key, last, count, at, id, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._turn(key, *self._load(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _load(self) -> tuple:
        if not self.kept.exists():
            return ev.LONG_AGO, 0, np.empty(0, np.int64), np.empty(0, np.int64)
        last, count, at, id = self.kept.get()
        return last, count, np.array(at, dtype=np.int64), np.array(id, dtype=np.int64)

    def _turn(self, key, last, count, at, id, watermark: int) -> pd.DataFrame:
        order = np.lexsort((id, at))
        at, id = at[order], id[order]
        due = int(np.searchsorted(at, watermark * 1000, side="left"))
        out, last, count = self._take(key, last, count, at[:due], id[:due], watermark * 1000)
        at, id = at[due:], id[due:]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        wake = [int(at[0])] if len(at) else []
        wake += self._wake(last, count)
        if wake:
            self.kept.update((int(last), int(count), at.tolist(), id.tolist()))
            # The watermark must have passed the moment itself.
            self.handle.registerTimer(max(min(wake) // 1000 + 1, watermark + 1))
        else:
            self.kept.clear()
        return out


class _Debounce(_Waiting):
    """``last`` is the last accepted time; it is needed until the gap after it is over."""

    def __init__(self, gap: int):
        self.gap = gap

    def _take(self, key, last, count, at, id, now) -> tuple:
        taken, place = [], int(np.searchsorted(at, last + self.gap))
        while place < len(at):
            taken.append(place)
            last = int(at[place])
            place = int(np.searchsorted(at, last + self.gap))
        self.now = now
        return pd.DataFrame({"path": key[0], "event_id": id[taken], "at": at[taken]}), last, count

    def _wake(self, last, count) -> list[int]:
        return [last + self.gap] if last + self.gap > self.now else []


class _Idle(_Waiting):
    """``last`` is the last event that the watermark has passed, ``count`` how many reports it has had."""

    def __init__(self, threshold: int):
        self.threshold = threshold

    def _take(self, key, last, count, at, id, now) -> tuple:
        since, number = [], []

        def report(until: int) -> None:
            nonlocal count
            while last > ev.LONG_AGO and last + (count + 1) * self.threshold <= until:
                count += 1
                since.append(last)
                number.append(count)

        for moment in np.unique(at).tolist():
            report(moment)
            last, count = moment, 0
        report(now - 1)
        return pd.DataFrame({"path": key[0], "idle_from": since, "report": number}), last, count

    def _wake(self, last, count) -> list[int]:
        return [last + (count + 1) * self.threshold] if last > ev.LONG_AGO else []


def _rows(events: DataFrame, late: str) -> DataFrame:
    timed = events.where("path IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.select("path", "event_id", "ts", ev.micros("ts").alias("at")).groupBy("path")


def debounce_stream(events: DataFrame, gap_seconds: float = ev.DEBOUNCE_SECONDS, late: str = "1 hour") -> DataFrame:
    """Accepted events (path, event_id, ts) once the watermark has passed them, as ``events.debounce`` gives
    them, in whatever order they arrive. One that is later than ``late`` is dropped. The state of a
    path is cleared when the gap after its last accepted event is over."""
    path_type = events.schema["path"].dataType.simpleString()
    accepted = _rows(events, late).transformWithStateInPandas(
        _Debounce(int(gap_seconds * ev.SECOND)), f"path {path_type}, event_id bigint, at bigint", "Append", "EventTime"
    )
    return accepted.select("path", "event_id", F.timestamp_micros("at").alias("ts"))


def idle_stream(events: DataFrame, threshold_seconds: float = ev.IDLE_SECONDS, late: str = "1 hour") -> DataFrame:
    """A live monitor: (path, idle_from, report, at), a row whenever another threshold has gone by since the last
    event of a path. Reports come by timer, as the watermark moves, without an event of that path."""
    threshold = int(threshold_seconds * ev.SECOND)
    path_type = events.schema["path"].dataType.simpleString()
    reports = _rows(events, late).transformWithStateInPandas(
        _Idle(threshold), f"path {path_type}, idle_from bigint, report bigint", "Append", "EventTime"
    )
    at = F.timestamp_micros(F.col("idle_from") + F.col("report") * threshold)
    return reports.select("path", F.timestamp_micros("idle_from").alias("idle_from"), "report", at.alias("at"))
