"""Streaming admission window: exact accept/reject per key with bounded state.

``admission_in_order`` is exact for events that arrive in any order within the watermark: they wait in
a buffer per key until the watermark has passed them and are then folded in time order, as the batch
``burst_flags`` folds them. ``admission_flags`` answers at once, in the order of arrival:

``applyInPandasWithState`` keeps, per key, only the accepted event times of
the last window (at most ``limit`` values). Each micro-batch's events of a key
are folded in time order; a watermark lets Spark drop idle keys' state
through the event-time timeout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tillrec.operators.bursts import Admission

OUT_SCHEMA = "event_id long, user_id long, ts timestamp, accepted boolean"
STATE_SCHEMA = "accepted_us array<long>"


def _fold(limit: int, window_us: int):
    def fn(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        accepted = list(state.get[0]) if state.exists else []
        frames = [p for p in pdfs]
        if not frames:
            return
        pdf = pd.concat(frames).sort_values(["ts", "event_id"])
        us = (pdf["ts"].astype("int64") // 1000).to_numpy()
        flags = []
        for t in us:
            accepted = [a for a in accepted if a >= t - window_us]
            if len(accepted) >= limit:
                flags.append(False)
            else:
                accepted.append(int(t))
                flags.append(True)
        state.update((accepted,))
        state.setTimeoutTimestamp(int(us.max() // 1000) + window_us // 1000 + 1)
        yield pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "user_id": pdf["user_id"].to_numpy(),
                            "ts": pdf["ts"].to_numpy(), "accepted": flags})
    return fn


def admission_flags(events: DataFrame, window_seconds: int = 60, limit: int = 5,
                    watermark: str = "2 minutes") -> DataFrame:
    """events: streaming frame with event_id, user_id, ts (timestamp)."""
    return (events.withWatermark("ts", watermark)
                  .groupBy("user_id")
                  .applyInPandasWithState(_fold(limit, window_seconds * 1_000_000), OUT_SCHEMA, STATE_SCHEMA,
                                          "append", GroupStateTimeout.EventTimeTimeout))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ReorderedAdmission(StatefulProcessor):
    """Per key: the events that the watermark hasn't passed yet, the newest accepted times, and one timer
    for the earliest waiting event. The state of a key that waits for nothing and whose window has passed is dropped."""

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window_us = limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, event_id long")
        self.accepted = handle.getValueState("accepted", "us array<long>")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t.value) // 1000, int(i)) for pdf in rows for t, i in zip(pdf["ts"], pdf["event_id"])]
        if new:
            self.waiting.appendList(new)
            self._wake(min(t for t, _ in new) // 1000 + 1)
        return iter(())

    def _wake(self, at: int) -> None:
        """Keep the earlier of the timer's time and ``at`` (ms)."""
        now = self.timer.get()[0] if self.timer.exists() else None
        if now is None or at < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((int(t), int(i)) for t, i in self.waiting.get())
        ready = [w for w in waiting if w[0] < passed]
        rest = waiting[len(ready):]
        held = tuple(self.accepted.get()[0]) if self.accepted.exists() else ()
        if not ready:
            if not rest and not any(t >= passed - self.window_us for t in held):
                self.accepted.clear()
                return
            self._wake((rest[0][0] if rest else held[-1] + self.window_us) // 1000 + 1)
            return
        times = np.array([t for t, _ in ready], dtype=np.int64)
        admission = Admission(self.limit, self.window_us, 0, held)
        flags = admission.feed(np.zeros(len(times), dtype=np.int64), times)
        self.accepted.update(([int(t) for t in admission.accepted],))
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        self._wake((rest[0][0] if rest else int(times[-1]) + self.window_us) // 1000 + 1)
        yield pd.DataFrame({"event_id": [i for _, i in ready], "user_id": key[0], "ts": pd.to_datetime(times, unit="us"), "accepted": flags})

    def close(self) -> None:
        pass


def admission_in_order(events: DataFrame, window_seconds: int = 60, limit: int = 5, watermark: str = "2 minutes") -> DataFrame:
    """Flags of a streaming frame (event_id, user_id, ts), each once the watermark has passed the event;
    later arrivals than the watermark allows are dropped. State per key: its events within the watermark's
    delay and at most ``limit`` times. Needs the RocksDB state store, which is set for the session."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return (events.withWatermark("ts", watermark).groupBy("user_id")
            .transformWithStateInPandas(ReorderedAdmission(limit, window_seconds * 1_000_000), OUT_SCHEMA, "Append", "EventTime"))
