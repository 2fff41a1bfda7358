"""Stateful streaming operators on ``transformWithStateInPandas``, each with the batch twin it must agree with."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SETTING = "spark.sql.streaming.stateStore.providerClass"


def keep_in_rocksdb(spark: SparkSession) -> None:
    """State of these operators needs a store with several variables, which the session must name before a query starts; a choice
    of the user's stays."""
    if spark.conf.get(_SETTING, None) is None:
        spark.conf.set(_SETTING, PROVIDER)


def _key(df: DataFrame, key: str) -> str:
    """The key's type."""
    keep_in_rocksdb(df.sparkSession)
    return dict(df.dtypes)[key]


#: Keys are dealt to so many groups where a call for each of many keys would cost more than its rows.
BUCKETS = 1024


def _in_bucket(stream: DataFrame, key: str) -> tuple[Column, Column]:
    """The key as a string, so that a null among whole numbers leaves the others as they are, and its bucket."""
    kind = _key(stream, key)
    plain = F.col(key) + F.lit(0.0).cast(kind) if kind in ("float", "double") else F.base64(key) if kind == "binary" else F.col(key)
    text = plain.cast("string")
    return text.alias("in_key"), F.pmod(F.xxhash64(text), F.lit(BUCKETS)).cast("int").alias("bucket")


def _typed(kind: str) -> Column:
    """The key that :func:`_in_bucket` made a string."""
    return (F.unbase64("key") if kind == "binary" else F.col("key").cast(kind)).alias("key")


def _coded(keys: pd.Series) -> tuple[np.ndarray, list]:
    """Each row's place in the list of different keys, and that list."""
    codes, names = pd.factorize(keys.to_numpy(object), use_na_sentinel=False)
    return codes.astype("int32"), [None if x != x else x for x in names.tolist()]


class Packed:
    """State by key of a bucket, packed into ``PARTS`` entries of map state by the key's hash: a call reads and writes a part that it touches once."""

    PARTS = 8

    def __init__(self, handle: StatefulProcessorHandle, name: str, columns: str):
        self.state = handle.getMapState(name, "part bigint", f"ks array<string>, {columns}")

    def load(self, keys: list) -> dict:
        """What the keys of the touched parts hold, as tuples; to be changed in place."""
        self.place = lambda k: zlib.crc32(k.encode()) % self.PARTS if k is not None else 0
        begun = self.state.exists()
        self.touched = {self.place(k) for k in keys}
        self.held: dict = {}
        for part in self.touched:
            if begun and self.state.containsKey((part,)):
                ks, *columns = self.state.getValue((part,))
                self.held.update(zip(ks, zip(*columns, strict=True), strict=True))
        return self.held

    def write(self) -> None:
        parts: dict[int, list] = {p: [] for p in self.touched}
        for k, values in self.held.items():
            parts[self.place(k)].append((k, *values))
        for part, rows in parts.items():
            self.state.updateValue((part,), tuple(map(list, zip(*rows, strict=True))))


class _Values:
    """A key's values with their signed counts, in map state by ``PARTS`` hashes: a call reads and writes a part that it touches once."""

    PARTS = 32

    def __init__(self, state, begun: bool, parts: int = PARTS):
        self.state, self.begun, self.PARTS = state, begun, parts
        self.parts: dict[int, dict[float, int]] = {}
        self.changed: set[int] = set()
        self.rising: list[float] | None = None

    def _part(self, i: int) -> dict[float, int]:
        if i not in self.parts:
            held = self.state.getValue((i,)) if self.begun and self.state.containsKey((i,)) else ((), ())
            self.parts[i] = dict(zip(*held, strict=True))
        return self.parts[i]

    def add(self, value: float, sign: int) -> tuple[int, int]:
        """The value's count before and after."""
        i = hash(value) % self.PARTS
        part = self._part(i)
        self.changed.add(i)
        before = part.get(value, 0)
        now = before + sign
        if now:
            part[value] = now
        else:
            del part[value]
        if self.rising is not None and before <= 0 < now:
            heapq.heappush(self.rising, value)
            heapq.heappush(self.falling, -value)
        return before, now

    def extremes(self) -> tuple[float | None, float | None]:
        """The least and the greatest value that is there; the first call orders all of them, later ones only drop what has gone."""
        if self.rising is None:
            self.rising = [v for i in range(self.PARTS) for v, c in self._part(i).items() if c > 0]
            self.falling = [-v for v in self.rising]
            heapq.heapify(self.rising)
            heapq.heapify(self.falling)
        while self.rising and self._part(hash(self.rising[0]) % self.PARTS).get(self.rising[0], 0) <= 0:
            heapq.heappop(self.rising)
        while self.falling and self._part(hash(-self.falling[0]) % self.PARTS).get(-self.falling[0], 0) <= 0:
            heapq.heappop(self.falling)
        return (self.rising[0], -self.falling[0]) if self.rising else (None, None)

    def write(self) -> None:
        for i in self.changed:
            part = self.parts[i]
            if part:
                self.state.updateValue((i,), (list(part), list(part.values())))
            elif self.begun:
                self.state.removeKey((i,))


class _Changelog(StatefulProcessor):
    """Aggregates per key with retractions: (-1, old row) before (+1, new row); only -1 when no row is left.

    State is read and written once a call, and changes leave with each frame of rows, so neither the time of a row nor the memory of a call grows
    with a key's rows. With ``values`` these are kept with their signed counts, so that a minimum or maximum that is taken back gives way to the
    next one, a distinct value goes with its last copy, and a retraction that comes before its row cancels out.
    """

    def __init__(self, keys: list[str], ttl: int | None, values: bool):
        self.keys, self.ttl, self.keep = keys, ttl, values

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("acc", "n bigint, c bigint, s double" + (", lo double, hi double, d bigint" if self.keep else ""), self.ttl)
        if self.keep:
            self.values = handle.getMapState("values", "part bigint", "vs array<double>, cs array<bigint>", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = self.state.get()
        n, c, s, *more = old or (0, 0, 0.0, *((None, None, 0) if self.keep else ()))
        values = _Values(self.values, old is not None) if self.keep else None
        for frame in rows:
            sign, v = frame["in_op"].to_numpy("int64"), frame["in_value"].to_numpy("float64")
            there = ~np.isnan(v)
            table = {"n": _running(n, sign), "c": _running(c, np.where(there, sign, 0)), "s": _running(s, np.where(there, sign * v, 0.0))}
            n, c, s = int(table["n"][-1]), int(table["c"][-1]), float(table["s"][-1])
            table["s"] = np.where(table["c"] == 0, np.nan, table["s"])
            if values:
                steps = self._extremes(values, sign.tolist(), v.tolist(), *more)
                more = steps[-1]
                for i, name in enumerate(("lo", "hi")):
                    table[name] = np.array([np.nan if x[i] is None else x[i] for x in steps])
                table["d"] = np.array([x[2] for x in steps], "int64")
            at = (np.arange(2 * len(sign)) + 1) // 2  # each row's state before it and after it
            at, op = at[table["n"][at] > 0], np.tile([-1, 1], len(sign))[table["n"][at] > 0]
            yield pd.DataFrame({**dict(zip(self.keys, key, strict=True)), **{k: x[at] for k, x in table.items()}, "_op": op.astype("int32")}, index=range(len(at)))
        if values:
            values.write()
        if n or c or s:
            self.state.update((n, c, s, *more))
        elif old is not None:
            self.state.clear()

    @staticmethod
    def _extremes(values: _Values, signs: list[int], vs: list[float], lo: float | None, hi: float | None, d: int) -> list[tuple]:
        """lo, hi, d before the first row and after each."""
        out = [(lo, hi, d)]
        for sign, value in zip(signs, vs, strict=True):
            if value == value:
                before, now = values.add(value, sign)
                if before <= 0 < now:
                    d += 1
                    lo, hi = value if lo is None or value < lo else lo, value if hi is None or value > hi else hi
                elif now <= 0 < before:
                    d -= 1
                    if value in (lo, hi):  # the next one takes its place
                        lo, hi = values.extremes()
            out.append((lo, hi, d))
        return out

    def close(self) -> None:
        pass


def _running(start: float, steps: np.ndarray) -> np.ndarray:
    """``start`` and the totals after each step."""
    return np.cumsum(np.concatenate(([start], steps)))


#: Rows of a key that travel together to where its running totals are, and how many such chunks are unpacked at once.
CHUNK, CHUNKS = 256, 128


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a key as chunks: the bytes of their signs and of their values."""
    for batch in batches:
        keys = batch.column("key").dictionary_encode(null_encoding="encode")
        if not batch.num_rows:
            continue
        codes = keys.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        ops = batch.column("in_op").to_numpy(zero_copy_only=False).astype("int8")[order]
        values = batch.column("in_value").to_numpy(zero_copy_only=False).astype("float64")[order]
        sizes = np.bincount(codes)
        at = np.concatenate([np.arange(end - size, end, CHUNK) for size, end in zip(sizes, np.cumsum(sizes), strict=True)])
        ends = np.append(at[1:], len(codes)).tolist()
        at = at.tolist()
        chunks = [[x[i:j].tobytes() for i, j in zip(at, ends, strict=True)] for x in (ops, values)]
        first = pa.array(codes[order][at])
        yield pa.RecordBatch.from_arrays([keys.dictionary.take(first), *(pa.array(c, pa.binary()) for c in chunks)], ["key", "ops", "vs"])


def _steps(ops: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each row adds to n, c and s."""
    there = ~np.isnan(values)
    sign = ops.astype("int64")
    return sign, np.where(there, sign, 0), np.where(there, sign * values, 0.0)


def _bytes(chunks: Iterable[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, chunks)), kind)


class _Starts(StatefulProcessor):
    """n, c and s of a key before each chunk of its rows; chunks pass through as they are."""

    def __init__(self, ttl: int | None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("acc", "n bigint, c bigint, s double", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = self.state.get()
        now = old or (0, 0, 0.0)
        for frame in (f.iloc[lo : lo + CHUNKS] for f in rows for lo in range(0, len(f), CHUNKS)):
            ends = np.cumsum([len(x) for x in frame["ops"]])
            tables = [_running(start, step) for start, step in zip(now, _steps(_bytes(frame["ops"], "int8"), _bytes(frame["vs"], "float64")), strict=True)]
            now = tuple(t[-1].item() for t in tables)
            at = np.append(0, ends[:-1])
            yield pd.DataFrame({"key": [key[0]] * len(frame), **{name: t[at] for name, t in zip("ncs", tables, strict=True)}, "ops": frame["ops"].to_numpy(), "vs": frame["vs"].to_numpy()})
        if any(now):
            self.state.update(now)
        elif old is not None:
            self.state.clear()

    def close(self) -> None:
        pass


def _changes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(-1, the totals before) and (+1, the totals after) each row of chunks, where rows are left. Totals are added in the order that
    :class:`_Starts` took, so a chunk begins with the very number that the one before it ends with."""
    for whole in batches:
        for lo in range(0, whole.num_rows, CHUNKS):
            batch = whole.slice(lo, CHUNKS)
            ops = batch.column("ops").to_pylist()
            sizes = np.array([len(x) for x in ops])
            row = np.repeat(np.arange(len(sizes)), sizes)
            column = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            tables = {}
            for name, step in zip("ncs", _steps(_bytes(ops, "int8"), _bytes(batch.column("vs").to_pylist(), "float64")), strict=True):
                grid = np.zeros((len(sizes), sizes.max() + 1), step.dtype)
                grid[:, 0] = batch.column(name).to_numpy()
                grid[row, column + 1] = step
                grid = np.cumsum(grid, axis=1)
                tables[name] = np.stack((grid[row, column], grid[row, column + 1]), axis=1).ravel()
            left = tables["n"] > 0
            n, c, s = (t[left] for t in tables.values())
            keys = batch.column("key").take(pa.array(np.repeat(row, 2)[left]))
            signs = np.tile(np.array([-1, 1], "int32"), len(row))[left]
            yield pa.RecordBatch.from_arrays([keys, pa.array(n), pa.array(c), pa.array(s, mask=c == 0), pa.array(signs)], ["key", "n", "c", "s", "_op"])


class _Net(StatefulProcessor):
    """Aggregates of a key's shard with retractions, one change a call: what a micro-batch does to a value is added up first."""

    PARTS = 4

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("acc", "n bigint, c bigint, s double, lo double, hi double, d bigint")
        self.values = handle.getMapState("values", "part bigint", "vs array<double>, cs array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = self.state.get()
        n, c, s, lo, hi, d = old or (0, 0, 0.0, None, None, 0)
        net: dict[float, int] = {}
        for frame in rows:
            sign, v = frame["in_op"].to_numpy("int64"), frame["in_value"].to_numpy("float64")
            there = ~np.isnan(v)
            n, c, s = n + int(sign.sum()), c + int(sign[there].sum()), s + float((sign * v)[there].sum())
            different, which = np.unique(v[there], return_inverse=True)
            for value, more in zip(different.tolist(), np.bincount(which, weights=sign[there]).astype("int64").tolist(), strict=True):
                net[value] = net.get(value, 0) + more
        values = _Values(self.values, old is not None, self.PARTS)
        lost = False
        for value, more in net.items():
            if more:
                before, now = values.add(value, more)
                if before <= 0 < now:
                    d += 1
                    lo, hi = value if lo is None or value < lo else lo, value if hi is None or value > hi else hi
                elif now <= 0 < before:
                    d -= 1
                    lost = lost or value in (lo, hi)
        if lost:  # the next one takes its place
            lo, hi = values.extremes()
        values.write()
        if n or c or s:
            self.state.update((n, c, s, lo, hi, d))
        elif old is not None:
            self.state.clear()
        states = [(x, op) for x, op in ((old, -1), ((n, c, s, lo, hi, d), 1)) if x is not None and x[0] > 0]
        yield pd.DataFrame([(*key, x[0], x[1], x[2] if x[1] else None, *x[3:], op) for x, op in states], columns=["key", "shard", "n", "c", "s", "lo", "hi", "d", "_op"])

    def close(self) -> None:
        pass


def _signed(stream: DataFrame, key: str, value: str) -> DataFrame:
    return stream.select(F.col(key).alias("key"), F.col(value).cast("double").alias("in_value"), (F.col("_op") if "_op" in stream.columns else F.lit(1)).cast("int").alias("in_op"))


def retracting_aggregates(stream: DataFrame, key: str, value: str, ttl_ms: int | None = None, values: bool = True) -> DataFrame:
    """COUNT(*) ``n``, COUNT ``c``, SUM ``s``, MIN ``lo``, MAX ``hi`` and COUNT DISTINCT ``d`` per key as a changelog.

    Input without ``_op`` counts as insertions; rows with ``_op`` -1 take back an equal earlier row. State that isn't touched
    for ``ttl_ms`` of processing time is dropped. Without ``values`` none is kept, and ``lo``, ``hi`` and ``d`` are left out; the group of a
    key then only sees chunks of its rows, which become changes spread over all tasks, in no order between chunks.
    """
    rows, kind, mode = _signed(stream, key, value), _key(stream, key), "ProcessingTime" if ttl_ms else "None"
    if values:
        schema = f"key {kind}, n bigint, c bigint, s double, lo double, hi double, d bigint, _op int"
        return rows.groupBy("key").transformWithStateInPandas(_Changelog(["key"], ttl_ms, True), schema, "Append", mode)
    chunks = rows.mapInArrow(_chunked, f"key {kind}, ops binary, vs binary")
    begun = chunks.groupBy("key").transformWithStateInPandas(_Starts(ttl_ms), f"key {kind}, n bigint, c bigint, s double, ops binary, vs binary", "Append", mode)
    spread = begun.repartition(int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(_changes_of, f"key {kind}, n bigint, c bigint, s double, _op int")


def split_aggregates(stream: DataFrame, key: str, value: str, shards: int = 1024) -> DataFrame:
    """As :func:`retracting_aggregates`, each key's values dealt to ``shards`` by their hash: a key of many rows is many groups.

    The changelog is that of (``key``, ``shard``), with one change for each micro-batch; :func:`merge_shards` makes a key's row of the table that
    it ends in.
    """
    rows = _signed(stream, key, value).withColumn("shard", F.pmod(F.xxhash64("in_value"), F.lit(shards)).cast("int"))
    schema = f"key {_key(stream, key)}, shard int, n bigint, c bigint, s double, lo double, hi double, d bigint, _op int"
    return rows.groupBy("key", "shard").transformWithStateInPandas(_Net(), schema, "Append", "None")


def merge_shards(table: DataFrame) -> DataFrame:
    """One row a key of ``key, shard`` and all or some of ``n, c, s, lo, hi, d``: a value is in one shard only, so distinct ones add up."""
    how = {"n": F.sum, "c": F.sum, "s": F.sum, "lo": F.min, "hi": F.max, "d": F.sum}
    return table.groupBy("key").agg(*[how[c](c).alias(c) for c in table.columns if c in how])


def retracting_aggregate(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Count and sum per key as a changelog ``key, n, s, _op``; a sum of nulls only is null."""
    return retracting_aggregates(stream, key, value, values=False).select("key", "n", "s", "_op")


def materialize(changelog: DataFrame, key: str = "key") -> DataFrame:
    """The table that a changelog ends in: signed counts of equal rows that don't cancel out."""
    columns = [c for c in changelog.columns if c != "_op"]
    return changelog.groupBy(*columns).agg(F.sum("_op").alias("__n")).where("__n > 0").drop("__n")


class _Rolling(StatefulProcessor):
    """Running count, sum, minimum and maximum per key, one output row per input row in time order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("acc", "n bigint, s double, lo double, hi double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, s, lo, hi = self.state.get() if self.state.exists() else (0, 0.0, float("inf"), float("-inf"))
        frame = pd.concat(list(rows)).sort_values(["in_time", "in_id"], kind="stable")
        out = []
        for i, v in zip(frame["in_id"], frame["in_value"], strict=True):
            if not pd.isna(v):
                n, s, lo, hi = n + 1, s + v, min(lo, v), max(hi, v)
            out.append((key[0], i, n, *((s, lo, hi) if n else (None, None, None))))
        self.state.update((n, s, lo, hi))
        yield pd.DataFrame(out, columns=["key", "id", "n", "s", "lo", "hi"])

    def close(self) -> None:
        pass


def rolling_aggregate(df: DataFrame, key: str, ts: str, ident: str, value: str) -> DataFrame:
    """OVER unbounded preceding: ``key, id, n, s, lo, hi`` for every row; streaming or batch."""
    if not df.isStreaming:
        w = Window.partitionBy(key).orderBy(ts, ident).rowsBetween(Window.unboundedPreceding, 0)
        return df.select(F.col(key).alias("key"), F.col(ident).alias("id"), F.count(value).over(w).alias("n"), F.sum(value).over(w).alias("s"), F.min(value).over(w).alias("lo"), F.max(value).over(w).alias("hi"))
    rows = df.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("in_time"), F.col(ident).cast("long").alias("in_id"), F.col(value).cast("double").alias("in_value"))
    return rows.groupBy("key").transformWithStateInPandas(_Rolling(), f"key {_key(df, key)}, id bigint, n bigint, s double, lo double, hi double", "Append", "None")


class _OverRows(StatefulProcessor):
    """The last ``n + 1`` values per key in list state; the oldest leave as new ones come."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("last", "v double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = [r[0] for r in self.state.get()] if self.state.exists() else []
        frame = pd.concat(list(rows)).sort_values(["in_time", "in_id"], kind="stable")
        out = []
        for i, v in zip(frame["in_id"], frame["in_value"], strict=True):
            last = [*last, None if pd.isna(v) else float(v)][-(self.n + 1) :]
            held = [x for x in last if x is not None]
            out.append((key[0], i, len(held), sum(held) if held else None))
        self.state.put([(v,) for v in last])
        yield pd.DataFrame(out, columns=["key", "id", "n", "s"])

    def close(self) -> None:
        pass


def over_rows(df: DataFrame, key: str, ts: str, ident: str, value: str, preceding: int) -> DataFrame:
    """OVER ROWS ``preceding`` PRECEDING (count and sum); streaming or batch."""
    if not df.isStreaming:
        w = Window.partitionBy(key).orderBy(ts, ident).rowsBetween(-preceding, 0)
        return df.select(F.col(key).alias("key"), F.col(ident).alias("id"), F.count(value).over(w).alias("n"), F.sum(value).over(w).alias("s"))
    rows = df.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("in_time"), F.col(ident).cast("long").alias("in_id"), F.col(value).cast("double").alias("in_value"))
    return rows.groupBy("key").transformWithStateInPandas(_OverRows(preceding), f"key {_key(df, key)}, id bigint, n bigint, s double", "Append", "None")


class _CountTrigger(StatefulProcessor):
    """Fires the sum of every ``n`` rows of a key (null where all values are) and clears."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("acc", "n bigint, s double, w bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, s, w = self.state.get() if self.state.exists() else (0, None, 0)
        frame = pd.concat(list(rows)).sort_values(["in_time", "in_id"], kind="stable")
        out = []
        for v in frame["in_value"]:
            n, s = n + 1, s if pd.isna(v) else float(v) + (s or 0.0)
            if n == self.n:
                out.append((key[0], w, s))
                n, s, w = 0, None, w + 1
        self.state.update((n, s, w))
        yield pd.DataFrame(out, columns=["key", "w", "s"])

    def close(self) -> None:
        pass


def count_windows(df: DataFrame, key: str, ts: str, ident: str, value: str, size: int) -> DataFrame:
    """Count-triggered purging windows per key: ``key, w, s``; streaming or batch."""
    if not df.isStreaming:
        from lattica.operators.relational import tumbling_count

        return tumbling_count(df, [key], [ts, ident], size, [F.sum(value).alias("s")]).select(F.col(key).alias("key"), F.col("window").cast("long").alias("w"), "s")
    rows = df.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("in_time"), F.col(ident).cast("long").alias("in_id"), F.col(value).cast("double").alias("in_value"))
    return rows.groupBy("key").transformWithStateInPandas(_CountTrigger(size), f"key {_key(df, key)}, w bigint, s double", "Append", "None")


class Waiting:
    """Rows of a key that wait for the watermark: chunks in list state, whose first column is the millisecond, and one timer at the earliest.

    When the watermark passes that, all rows that are due leave at once, so calls to the state are a few for each key and micro-batch, however many
    rows and times there are.
    """

    def __init__(self, handle: StatefulProcessorHandle, columns: str):
        self.handle = handle
        self.rows = handle.getListState("waiting", f"ms array<bigint>, {columns}")
        self.timer = handle.getValueState("timer", "ms bigint")

    def add(self, chunks: list[tuple[list, ...]]) -> None:
        if chunks := [c for c in chunks if c[0]]:
            self.rows.appendList(chunks)
            first = min(min(c[0]) for c in chunks)
            held = self.timer.get()
            if held is None or first < held[0]:
                if held is not None:
                    self.handle.deleteTimer(held[0])
                self._wait(first)

    def _wait(self, ms: int) -> None:
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def due(self, timerValues, columns: int) -> list[list]:
        """The other columns of the rows that the watermark has passed; the rest waits on."""
        passed = timerValues.getCurrentWatermarkInMs()
        out: list[list] = [[] for _ in range(columns)]
        left = []
        for ms, *held in self.rows.get():
            if max(ms) <= passed:
                for o, h in zip(out, held, strict=True):
                    o.extend(h)
                continue
            late = [i for i, t in enumerate(ms) if t > passed]
            if len(late) < len(ms):
                for o, h in zip(out, held, strict=True):
                    o.extend(x for t, x in zip(ms, h, strict=True) if t <= passed)
            left.append(tuple([c[i] for i in late] for c in (ms, *held)))
        if left:
            self.rows.put(left)
            self._wait(min(min(c[0]) for c in left))
        else:
            self.rows.clear()
            self.timer.clear()
        return out


class WaitingRows:
    """As :class:`Waiting` for a bucket of keys: chunks of rows whose columns are the bytes of arrays, and one timer at the earliest."""

    def __init__(self, handle: StatefulProcessorHandle, **kinds: str):
        self.handle = handle
        self.kinds = {"code": "int32", "ms": "int64", **kinds}
        self.rows = handle.getListState("waiting", "ks array<string>, " + ", ".join(f"{c} binary" for c in self.kinds))
        self.timer = handle.getValueState("timer", "ms bigint")

    def _packed(self, keys: list, columns: dict[str, np.ndarray]) -> tuple:
        return (keys, *(columns[c].astype(kind).tobytes() for c, kind in self.kinds.items()))

    def add(self, frames: Iterable[tuple[pd.Series, dict[str, pd.Series]]]) -> None:
        chunks, first = [], None
        for keys, columns in frames:
            if len(keys):
                codes, names = _coded(keys)
                chunks.append(self._packed(names, {"code": codes, **{c: x.to_numpy() for c, x in columns.items()}}))
                least = int(columns["ms"].min())
                first = least if first is None else min(first, least)
        if chunks:
            self.rows.appendList(chunks)
            held = self.timer.get()
            if held is None or first < held[0]:
                if held is not None:
                    self.handle.deleteTimer(held[0])
                self._wait(first)

    def _wait(self, ms: int) -> None:
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def due(self, timerValues) -> tuple[list, dict[str, np.ndarray]]:
        """The keys and columns of the rows that the watermark has passed (``code`` is a row's place in the keys); the rest waits on."""
        passed = timerValues.getCurrentWatermarkInMs()
        places: dict = {}
        parts: dict[str, list] = {c: [] for c in self.kinds}
        for names, *held in self.rows.get():
            columns = {c: np.frombuffer(bytes(x), kind) for x, (c, kind) in zip(held, self.kinds.items(), strict=True)}
            columns["code"] = np.array([places.setdefault(k, len(places)) for k in names], "int32")[columns["code"]]
            for c, x in columns.items():
                parts[c].append(x)
        rows = {c: np.concatenate(x) if x else np.empty(0, self.kinds[c]) for c, x in parts.items()}
        late = rows["ms"] > passed
        keys = list(places)
        if late.any():
            left = {c: x[late] for c, x in rows.items()}
            used, left["code"] = np.unique(left["code"], return_inverse=True)
            self.rows.put([self._packed([keys[i] for i in used.tolist()], left)])
            self._wait(int(left["ms"].min()))
        else:
            self.rows.clear()
            self.timer.clear()
        return keys, {c: x[~late] for c, x in rows.items()}


def nones(values: pd.Series) -> list:
    """As a list, None for what is missing."""
    return values.astype(object).where(values.notna(), None).tolist()


class _TimeSort(StatefulProcessor):
    """Holds the rows of a bucket of keys until the watermark passes their time and emits them in (key, time, id) order, numbered in their key from 1."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = WaitingRows(handle, id="int64", v="float64")
        self.count = Packed(handle, "count", "ns array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.waiting.add((f["in_key"], {"ms": f["in_ms"], "id": f["in_id"], "v": f["in_value"]}) for f in rows)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        keys, rows = self.waiting.due(timerValues)
        order = np.lexsort((rows["id"], rows["ms"], rows["code"]))
        code, ms, ids, vs = (rows[c][order] for c in ("code", "ms", "id", "v"))
        sizes = np.bincount(code, minlength=len(keys))
        there = [k for k, size in zip(keys, sizes.tolist(), strict=True) if size]
        held = self.count.load(there)
        before = np.array([held.get(k, (0,))[0] for k in keys], "int64")
        pos = np.arange(1, len(code) + 1) - (np.cumsum(sizes) - sizes)[code] + before[code]
        held.update({k: (n,) for k, n, size in zip(keys, (before + sizes).tolist(), sizes.tolist(), strict=True) if size})
        self.count.write()
        yield pd.DataFrame({"key": np.array(keys, object)[code], "ms": ms, "id": ids, "v": vs, "pos": pos})

    def close(self) -> None:
        pass


def time_sort(stream: DataFrame, key: str, ts: str, ident: str, value: str, delay: str) -> DataFrame:
    """Rows of each key in event-time order, numbered by ``pos``, once the watermark has passed their time.

    Rows behind the watermark are dropped; those at or after the last watermark wait for more input. Keys are dealt to ``BUCKETS`` groups.
    """
    rows = stream.withColumn("in_time", F.col(ts).cast("timestamp")).withWatermark("in_time", delay)
    rows = rows.select(*_in_bucket(stream, key), "in_time", F.unix_millis("in_time").alias("in_ms"), F.col(ident).cast("long").alias("in_id"), F.col(value).cast("double").alias("in_value"))
    out = rows.groupBy("bucket").transformWithStateInPandas(_TimeSort(), "key string, ms bigint, id bigint, v double, pos bigint", "Append", "EventTime")
    return out.select(_typed(_key(stream, key)), "ms", "id", "v", "pos")


class _Inactive(StatefulProcessor):
    """A row for each pause: the key's last time, once no row came for ``gap`` ms of event time."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t bigint, n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, n = self.last.get() if self.last.exists() else (None, 0)
        out = []
        if last is not None:
            self.handle.deleteTimer(last + self.gap)
        for t in sorted(int(t) for frame in rows for t in frame["in_ms"].tolist()):
            if last is not None and t > last + self.gap:
                out.append((key[0], last, n))
                n = 0
            last, n = t if last is None else max(last, t), n + 1
        self.last.update((last, n))
        self.handle.registerTimer(last + self.gap)
        yield pd.DataFrame(out, columns=["key", "last_ms", "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.last.exists():
            last, n = self.last.get()
            if last + self.gap == expiredTimerInfo.getExpiryTimeInMs():
                out.append((key[0], last, n))
                self.last.clear()
        yield pd.DataFrame(out, columns=["key", "last_ms", "n"])

    def close(self) -> None:
        pass


def inactivity(stream: DataFrame, key: str, ts: str, gap_ms: int, delay: str) -> DataFrame:
    """``key, last_ms, n`` whenever a key pauses for more than ``gap_ms`` of event time: a process function with timers."""
    rows = stream.withColumn("in_time", F.col(ts).cast("timestamp")).withWatermark("in_time", delay)
    rows = rows.select(F.col(key).alias("key"), "in_time", F.unix_millis("in_time").alias("in_ms"))
    return rows.groupBy("key").transformWithStateInPandas(_Inactive(gap_ms), f"key {_key(stream, key)}, last_ms bigint, n bigint", "Append", "EventTime")


class _Enrich(StatefulProcessor):
    """Two connected inputs: the right one sets a key's value, the left one waits for it. A group is a bucket of keys, with map state by key."""

    def __init__(self, kind: str):
        self.kind = kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getMapState("values", f"k {self.kind}", "v string")
        self.waiting = handle.getMapState("waiting", f"k {self.kind}", "ids array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, waited = self.values.exists(), self.waiting.exists()
        new: dict = {}
        left = []
        for frame in rows:
            side = frame[frame["in_side"] == 1]
            for k, v in zip(side["key"].tolist(), side["in_value"].tolist(), strict=True):
                new[k] = max(new[k], v) if k in new else v
            left.append(frame.loc[frame["in_side"] == 0, ["key", "in_id"]].astype({"in_id": "int64"}))
        keys, ids = [], []
        for k, v in new.items():
            self.values.updateValue((k,), (v,))
            if waited and self.waiting.containsKey((k,)):
                held = self.waiting.getValue((k,))[0]
                keys += [k] * len(held)
                ids += held
                self.waiting.removeKey((k,))
        part = pd.concat([pd.DataFrame({"key": keys, "in_id": ids}), *left] if keys else left)
        if known:
            for k in part["key"].unique().tolist():
                if k not in new and self.values.containsKey((k,)):
                    new[k] = self.values.getValue((k,))[0]
        met = part["key"].isin(new)
        for k, rest in part[~met].groupby("key", sort=False)["in_id"]:
            held = self.waiting.getValue((k,))[0] if waited and self.waiting.containsKey((k,)) else []
            self.waiting.updateValue((k,), ([*held, *rest.tolist()],))
        part = part[met]
        keys = part["key"].tolist()
        if keys:
            yield pd.DataFrame({"key": keys, "id": part["in_id"].tolist(), "value": [new[k] for k in keys]})

    def close(self) -> None:
        pass


def connect_enrich(left: DataFrame, right: DataFrame, key: str, ident: str, value: str, buckets: int = 1024) -> DataFrame:
    """``key, id, value`` for every row of ``left``, as soon as ``right`` has set the key's value (the largest of a batch counts).

    Keys are dealt to ``buckets`` groups, as a call for each of many keys of few rows costs more than its rows. Rows without key meet nothing.
    """
    kind = _key(left, key)
    a = left.select(F.col(key).alias("key"), F.lit(0).alias("in_side"), F.col(ident).cast("long").alias("in_id"), F.lit(None).cast("string").alias("in_value"))
    b = right.select(F.col(key).cast(kind).alias("key"), F.lit(1).alias("in_side"), F.lit(None).cast("long").alias("in_id"), F.col(value).cast("string").alias("in_value"))
    both = a.unionByName(b).where("key is not null").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    return both.groupBy("bucket").transformWithStateInPandas(_Enrich(kind), f"key {kind}, id bigint, value string", "Append", "None")


class _Keyed(StatefulProcessor):
    """Of each key of a bucket: rows so far and a reduced value, the last three ids, and rows by kind, each a state variable of its own."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.n = Packed(handle, "n", "n array<bigint>, hi array<double>")
        self.recent = Packed(handle, "recent", "items array<array<bigint>>")
        self.kinds = Packed(handle, "kinds", "kinds array<array<string>>, ns array<array<bigint>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat([f[["in_key", "in_us", "in_id", "in_kind", "in_value"]] for f in rows], ignore_index=True)
        code, keys = _coded(frame["in_key"])
        order = np.lexsort((frame["in_id"].to_numpy(), frame["in_us"].to_numpy(), code))
        frame, code = frame.iloc[order], code[order]
        sizes = np.bincount(code, minlength=len(keys))
        starts = np.cumsum(sizes) - sizes
        total, recent, kinds = self.n.load(keys), self.recent.load(keys), self.kinds.load(keys)

        before = np.array([total.get(k, (0, None))[0] for k in keys], "int64")
        n = np.arange(1, len(code) + 1) - starts[code] + before[code]

        ids = frame["in_id"].to_numpy("int64")
        values, hi = frame["in_value"].to_numpy("float64"), np.empty(len(code))
        third = np.empty(len(code), "int64")
        for i, (k, at, size) in enumerate(zip(keys, starts.tolist(), sizes.tolist(), strict=True)):
            (old,), (_, most) = recent.get(k, ([],)), total.get(k, (0, None))
            seen = np.concatenate((np.array(old, "int64"), ids[at : at + size]))
            third[at : at + size] = seen[np.maximum(np.arange(len(old), len(seen)) - 2, 0)]
            hi[at : at + size] = np.fmax.accumulate(np.concatenate(([np.nan if most is None else most], values[at : at + size])))[1:]
            last = float(hi[at + size - 1])
            recent[k], total[k] = (seen[-3:].tolist(),), (int(before[i]) + size, None if last != last else last)

        kind, names = _coded(frame["in_kind"])
        pair, which = np.unique(code.astype("int64") * len(names) + kind, return_inverse=True)
        by_pair = np.argsort(which, kind="stable")
        counts = np.bincount(which)
        rank = np.empty(len(code), "int64")
        rank[by_pair] = np.arange(1, len(code) + 1) - (np.cumsum(counts) - counts)[which[by_pair]]
        held = {k: dict(zip(*kinds[k], strict=True)) if k in kinds else {} for k in keys}
        pairs = [(keys[x // len(names)], names[x % len(names)]) for x in pair.tolist()]
        of_kind = rank + np.array([held[k].get(name, 0) for k, name in pairs], "int64")[which]
        for (k, name), more in zip(pairs, counts.tolist(), strict=True):
            held[k][name] = held[k].get(name, 0) + more
        kinds.update({k: (list(x), list(x.values())) for k, x in held.items()})
        for part in (self.n, self.recent, self.kinds):
            part.write()
        yield pd.DataFrame({"key": np.array(keys, object)[code], "id": ids, "n": n, "of_kind": of_kind, "third_last": third, "hi": hi})

    def close(self) -> None:
        pass


def keyed_states(stream: DataFrame, key: str, ts: str, ident: str, kind: str, value: str) -> DataFrame:
    """Per row: its number in the key and in its kind, the id two rows before, and the largest value so far (reducing state).

    Keys are dealt to ``BUCKETS`` groups; :func:`~lattica.streaming.state.by_key` reads their state ``n``, ``recent`` and ``kinds`` by key.
    """
    us = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(-(2**63)))  # rows without time come first
    rows = stream.select(*_in_bucket(stream, key), us.alias("in_us"), F.col(ident).cast("long").alias("in_id"), F.col(kind).cast("string").alias("in_kind"), F.col(value).cast("double").alias("in_value"))
    out = rows.groupBy("bucket").transformWithStateInPandas(_Keyed(), "key string, id bigint, n bigint, of_kind bigint, third_last bigint, hi double", "Append", "None")
    return out.select(_typed(_key(stream, key)), "id", "n", "of_kind", "third_last", "hi")
