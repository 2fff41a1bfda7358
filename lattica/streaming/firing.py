"""Windows that fire early: a result every ``interval`` of event time, before the window is complete.

Rows are summed up in slices of the interval, one map entry and one timer a slice. When the watermark passes a slice with rows, the window's
result so far is emitted, so it doesn't hang on the order of arrival, and quiet intervals fire nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lattica.streaming.stateful import _key

#: Sums of a window are deleted so many ms after its end; less than an interval, so the two kinds of timers differ.
_GONE = 1
_OUT = ["key", "window_ms", "fired_ms", "n", "c", "s", "final"]


class _Early(StatefulProcessor):
    def __init__(self, size: int, interval: int):
        self.size, self.interval = size, interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slices = handle.getMapState("slices", "ms bigint", "n bigint, c bigint, s double")
        self.windows = handle.getMapState("windows", "ms bigint", "n bigint, c bigint, s double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            at = frame["in_ms"] - frame["in_ms"] % self.interval
            sums = frame.groupby(at)["in_value"].agg(["size", "count", "sum"])
            for ms, n, c, s in sums.itertuples():
                if self.slices.containsKey((int(ms),)):
                    held = self.slices.getValue((int(ms),))
                    n, c, s = n + held[0], c + held[1], s + held[2]
                else:
                    self.handle.registerTimer(int(ms) + self.interval)
                self.slices.updateValue((int(ms),), (int(n), int(c), float(s)))
        yield pd.DataFrame(columns=_OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fired = expiredTimerInfo.getExpiryTimeInMs()
        if fired % self.interval:  # a window whose last slice had no rows
            if self.windows.containsKey((fired - _GONE - self.size,)):
                self.windows.removeKey((fired - _GONE - self.size,))
            yield pd.DataFrame(columns=_OUT)
            return
        at = fired - self.interval
        n, c, s = self.slices.getValue((at,))
        self.slices.removeKey((at,))
        window = (at - at % self.size,)
        if self.windows.containsKey(window):
            held = self.windows.getValue(window)
            n, c, s = n + held[0], c + held[1], s + held[2]
        final = fired == window[0] + self.size
        if final:
            self.windows.removeKey(window)
        else:
            if not self.windows.containsKey(window):
                self.handle.registerTimer(window[0] + self.size + _GONE)
            self.windows.updateValue(window, (n, c, s))
        yield pd.DataFrame([(key[0], window[0], fired, n, c, s if c else None, final)], columns=_OUT)

    def close(self) -> None:
        pass


def early_windows(stream: DataFrame, key: str, ts: str, value: str, size_ms: int, interval_ms: int, delay: str = "0 seconds") -> DataFrame:
    """key, window_ms (its start), fired_ms, n (rows), c (values), s (their sum) and final (fired at the window's end), after each interval
    that had rows. ``interval_ms`` divides ``size_ms``. Rows behind the watermark are dropped."""
    if interval_ms < 2 or size_ms % interval_ms:
        raise ValueError("the interval has two milliseconds at least and divides the window")
    rows = stream.withColumn("in_time", F.col(ts).cast("timestamp")).withWatermark("in_time", delay)
    rows = rows.select(F.col(key).alias("key"), "in_time", F.unix_millis("in_time").alias("in_ms"), F.col(value).cast("double").alias("in_value"))
    schema = f"key {_key(stream, key)}, window_ms bigint, fired_ms bigint, n bigint, c bigint, s double, final boolean"
    return rows.groupBy("key").transformWithStateInPandas(_Early(size_ms, interval_ms), schema, "Append", "EventTime")
