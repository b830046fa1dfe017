"""The login throttle on a stream of attempts: the same decisions as operators.throttle on ordered input."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docketspark.operators.throttle import NOTHING, decide

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTPUT = "key string, id long, t long, kind string, admitted boolean, retry_after_us long"
STATE = "n int, w long, l long, timer long"


class Throttle(StatefulProcessor):
    """State of a key, and when it ends: once its window and lock are over a timer clears it, so only keys of late are held."""

    def __init__(self, most: int, window_seconds: int, lockout_seconds: int):
        self.most, self.window, self.lockout = most, window_seconds * 1_000_000, lockout_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("throttle", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values(["t", "id"], ignore_index=True)
        *state, timer = self.state.get() if self.state.exists() else (*NOTHING, None)
        state, out = tuple(state), []
        for t, kind in zip(got["t"].tolist(), got["kind"], strict=True):
            state, *said = decide(state, t, kind == "success", self.most, self.window, self.lockout)
            out.append(said)
        _, w, lock = state
        # The first millisecond at which the state would be started afresh anyway.
        end = None if w is None else max(w + self.window, lock or 0) // 1000 + 1
        if timer is not None and timer != end:
            self.handle.deleteTimer(timer)
        if end is None:
            self.state.clear()
        else:
            if timer != end:
                self.handle.registerTimer(end)
            self.state.update((*state, end))
        got["admitted"] = pd.array([a for a, _ in out], dtype="boolean")
        got["retry_after_us"] = pd.array([r for _, r in out], dtype="Int64")
        yield got[["key", "id", "t", "kind", "admitted", "retry_after_us"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def throttle_stream(events: DataFrame, most: int, window_seconds: int, lockout_seconds: int, delay: str = "10 minutes") -> DataFrame:
    """events: a stream of key, id (long), t (microseconds) and kind. Within a micro-batch a key's events go by (t, id).

    A key's state is gone once the watermark, `delay` behind the latest event, has passed its window and lock. Events
    behind the watermark are dropped. The rows that a key has in one micro-batch are sorted in memory, so the source's
    options should bound a batch.
    """
    fold = Throttle(most, window_seconds, lockout_seconds)
    timed = events.withColumn("at", F.timestamp_micros("t")).withWatermark("at", delay)
    return timed.groupBy("key").transformWithStateInPandas(fold, OUTPUT, "Append", "EventTime")
