"""State of streaming queries from outside: lookup, savepoints, and queries that begin with another's state.

Spark's state data source reads a checkpoint's state store as frames, distributed over its partitions. A savepoint is those
frames, one for each state variable, as Parquet in a folder of its own: it survives the query and its checkpoint, and a later query
may begin with it, with other state variables and other fields (:class:`Totals` fills what a savepoint hasn't).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lattica.streaming.stateful import _key


def variables(spark: SparkSession, checkpoint: str) -> DataFrame:
    """operatorName, operatorId, stateStoreName, numPartitions, minBatchId, maxBatchId of a checkpoint's stateful operators."""
    return spark.read.format("state-metadata").load(checkpoint)


def state_of(spark: SparkSession, checkpoint: str, name: str, operator: int = 0, batch: int | None = None) -> DataFrame:
    """All keys of one state variable: ``key`` fields, then the value's fields, or ``items`` (array) of list state, or ``entries`` (map) of
    map state. ``batch`` is the last committed one unless given."""
    reader = spark.read.format("statestore").option("operatorId", str(operator)).option("stateVarName", name).option("flattenCollectionTypes", "false")
    found = (reader.option("batchId", str(batch)) if batch is not None else reader).load(checkpoint)
    if "list_value" in found.columns:
        return found.select("key.*", F.col("list_value").alias("items"))
    if "map_value" in found.columns:
        return found.select("key.*", F.col("map_value").alias("entries"))
    return found.select("key.*", "value.*")


def by_key(spark: SparkSession, checkpoint: str, name: str, kind: str, operator: int = 0, batch: int | None = None) -> DataFrame:
    """All keys of a state variable that :class:`~lattica.streaming.stateful.Packed` holds: ``key`` of type ``kind`` and the value's fields."""
    parts = state_of(spark, checkpoint, name, operator, batch).select(F.explode("entries").alias("part", "v")).select("v.*")
    fields = [c for c in parts.columns if c != "ks"]
    return parts.select(F.inline(F.arrays_zip("ks", *fields))).select(F.col("ks").cast(kind).alias("key"), *fields)


def lookup(spark: SparkSession, checkpoint: str, name: str, keys: DataFrame, operator: int = 0, packed: str | None = None) -> DataFrame:
    """The state of given keys: ``keys`` has the key's columns; keys without state are absent. ``packed`` is the key's type if state is (:func:`by_key`)."""
    state = by_key(spark, checkpoint, name, packed, operator) if packed else state_of(spark, checkpoint, name, operator)
    return state.join(keys.select(*[c for c in keys.columns if c in state.columns]).distinct(), [c for c in keys.columns if c in state.columns], "left_semi")


def savepoint(spark: SparkSession, checkpoint: str, names: list[str], target: str, operator: int = 0) -> None:
    """Write state variables under ``target``, a folder for each name."""
    for name in names:
        state_of(spark, checkpoint, name, operator).write.parquet(f"{target}/{name}")


def saved(spark: SparkSession, target: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{target}/{name}")


class Totals(StatefulProcessor):
    """Count, sum and, if ``wide``, minimum and maximum of each key, as value state ``acc``; a row for each key and batch.

    A saved state may have fewer fields: those that it hasn't begin empty, others that this version hasn't are left.
    """

    def __init__(self, wide: bool):
        self.fields = ["n", "s", "lo", "hi"] if wide else ["n", "s"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        kinds = {"n": "bigint"}
        self.acc = handle.getValueState("acc", ", ".join(f"{f} {kinds.get(f, 'double')}" for f in self.fields))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        held = {f: None if f not in initialState.columns or pd.isna(row[f]) else row[f] for f in self.fields}
        self.acc.update(tuple(int(held[f] or 0) if f == "n" else None if held[f] is None else float(held[f]) for f in self.fields))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = dict(zip(self.fields, self.acc.get(), strict=True)) if self.acc.exists() else dict.fromkeys(self.fields)
        held["n"] = held["n"] or 0
        for frame in rows:
            values = frame["in_value"].dropna()
            held["n"] += len(frame)
            if len(values):
                held["s"] = (held["s"] or 0.0) + float(values.sum())
                for f, pick, of in (("lo", min, float(values.min())), ("hi", max, float(values.max()))):
                    if f in held:
                        held[f] = of if held[f] is None else pick(held[f], of)
        state = tuple(held[f] for f in self.fields)
        self.acc.update(state)
        yield pd.DataFrame([(key[0], *state)], columns=["key", *self.fields])

    def close(self) -> None:
        pass


def totals(stream: DataFrame, key: str, value: str, wide: bool = False, initial: DataFrame | None = None) -> DataFrame:
    """key, n, s and, if ``wide``, lo, hi of each key after each batch. ``initial`` (``key`` and some of these) is where state begins."""
    rows = stream.select(F.col(key).alias("key"), F.col(value).cast("double").alias("in_value"))
    schema = f"key {_key(stream, key)}, n bigint, s double" + (", lo double, hi double" if wide else "")
    begin = initial.groupBy("key") if initial is not None else None
    return rows.groupBy("key").transformWithStateInPandas(Totals(wide), schema, "Update", "None", begin)
