"""Streams that steer others: control streams for all keys, and side inputs for one key each.

A side row is a version: from its time on, its value holds for its key until the next version. A main row meets the version as of
its own time, also when that comes later or out of order, as both wait for the watermark. A control stream must reach every
state that may ask for it, so its rows go to all of ``groups`` key groups, over which main rows are dealt by a hash of the whole row, so
a hot key spreads as well. A keyed side input stays with its key.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lattica.streaming.stateful import Waiting, keep_in_rocksdb, nones


class _AsOf(StatefulProcessor):
    """Main rows wait for the watermark; versions wait by key in time order. Of versions that the watermark has passed only the last is kept."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = Waiting(handle, "us array<bigint>, keys array<string>, rows array<string>")
        self.versions = handle.getMapState("versions", "key string", "us array<bigint>, tie array<bigint>, vals array<string>")

    def _held(self, k: str) -> tuple:
        return tuple(self.versions.getValue((k,))) if self.versions.containsKey((k,)) else ([], [], [])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: dict[str, list[tuple]] = {}
        chunks = []
        for frame in rows:
            side, main = frame[frame["in_side"] == 1], frame[frame["in_side"] == 0]
            for k, *version in zip(side["in_key"].tolist(), side["in_us"].tolist(), side["in_tie"].tolist(), nones(side["in_row"]), strict=True):
                new.setdefault(k, []).append(tuple(version))
            chunks.append((main["in_ms"].tolist(), main["in_us"].tolist(), nones(main["in_key"]), main["in_row"].tolist()))
        for k, versions in new.items():
            ordered = sorted([*zip(*self._held(k), strict=True), *versions], key=lambda v: v[:2])
            self.versions.updateValue((k,), tuple(map(list, zip(*ordered, strict=True))))
        self.waiting.add(chunks)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due = pd.DataFrame(dict(zip(("us", "key", "row"), self.waiting.due(timerValues, 3), strict=True)))
        if lone := due["row"][due["key"].isna()].tolist():
            yield pd.DataFrame({"row": lone, "value": None, "since": None})
        for k, part in due.groupby("key", sort=False):
            times, ties, values = self._held(k)
            at = (np.searchsorted(np.array(times, "int64"), part["us"].to_numpy(), "right") - 1).tolist()
            yield pd.DataFrame({"row": part["row"].tolist(), "value": pd.Series([values[i] if i >= 0 else None for i in at], dtype=object), "since": pd.Series([times[i] if i >= 0 else None for i in at], dtype=object)})
            if (i := bisect_right(times, passed)) > 1:
                self.versions.updateValue((k,), (times[i - 1 :], ties[i - 1 :], values[i - 1 :]))

    def close(self) -> None:
        pass


def _joined(main: DataFrame, side: DataFrame, group: str, key: str, ts: str, tie: str, value: str, delay: str, how: str) -> DataFrame:
    """Both as rows of one stream, grouped by ``group``; main's columns come back from their JSON."""
    keep_in_rocksdb(main.sparkSession)
    columns = [c for c in main.columns if c != group]
    packed = main.select(*[c for c in columns], group, F.col(ts).cast("timestamp").alias("in_time"))
    a = packed.select(F.col(group).alias("in_group"), F.lit(0).alias("in_side"), "in_time", F.col(key).cast("string").alias("in_key"), F.lit(0).cast("long").alias("in_tie"), F.to_json(F.struct(*columns)).alias("in_row"))
    b = side.select(F.col(group).alias("in_group"), F.lit(1).alias("in_side"), F.col(ts).cast("timestamp").alias("in_time"), F.col(key).cast("string").alias("in_key"), F.col(tie).cast("long").alias("in_tie"), F.col(value).cast("string").alias("in_row"))
    both = a.unionByName(b.where("in_key is not null")).where("in_time is not null").withColumn("in_us", F.unix_micros("in_time"))
    both = both.withColumn("in_ms", F.ceil(F.col("in_us") / 1000)).withWatermark("in_time", delay)
    met = both.groupBy("in_group").transformWithStateInPandas(_AsOf(), "row string, value string, since bigint", "Append", "EventTime")
    schema = main.select(*columns).schema
    found = met.select(F.from_json("row", schema).alias("r"), F.col("value").cast(dict(side.dtypes)[value]).alias(f"side_{value}"), F.timestamp_micros("since").alias("side_since"))
    if how == "inner":
        found = found.where("side_since is not null")
    return found.select("r.*", f"side_{value}", "side_since")


def control_join(main: DataFrame, control: DataFrame, key: str, ts: str, tie: str, value: str, delay: str = "0 seconds", groups: int = 64, how: str = "left") -> DataFrame:
    """``main`` with side_``value`` and side_since of the control row of its ``key`` as of its ``ts`` (of equal times the largest ``tie``).

    Both have columns ``key`` and ``ts``. ``groups`` bounds parallelism, and control rows are held once in each group. Rows without time
    are left out; control rows without key are. ``how`` is ``left`` or ``inner``.
    """
    dealt = main.withColumn("in_group", F.expr(f"pmod(xxhash64({', '.join(f'`{c}`' for c in main.columns)}), {groups})").cast("long"))
    sent = control.withColumn("in_group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    return _joined(dealt, sent, "in_group", key, ts, tie, value, delay, how)


def keyed_side_input(main: DataFrame, side: DataFrame, key: str, ts: str, tie: str, value: str, delay: str = "0 seconds", how: str = "left") -> DataFrame:
    """As :func:`control_join`, with the side rows of a key at that key only."""
    group = F.col(key).cast("string")
    return _joined(main.withColumn("in_group", group), side.withColumn("in_group", group), "in_group", key, ts, tie, value, delay, how)
