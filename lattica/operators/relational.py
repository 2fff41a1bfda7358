"""Relational operators that Spark doesn't offer under one name."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lattica.plans.lineage import cut


#: Keys of which a task holds a reduced row before it passes them on.
REDUCED = 100_000


def range_join(left: DataFrame, right: DataFrame, keys: Sequence[str], lt: str, rt: str, before: int, after: int, how: str = "inner") -> DataFrame:
    """Equi-join with ``left.lt BETWEEN right.rt - before AND right.rt + after`` (seconds).

    Time buckets of the range's width join the keys, so that each side only meets its neighbour buckets and a hot key
    spreads over tasks. ``right`` columns other than the keys must not clash. ``how`` is ``inner`` or ``left``.
    """
    width = max(1, before + after)
    bucket = F.floor(F.unix_timestamp(F.col(lt).cast("timestamp")) / width)
    shifted = F.unix_timestamp(F.col(rt).cast("timestamp"))
    r = right.withColumn("__b", F.explode(F.sequence(F.floor((shifted - before) / width), F.floor((shifted + after) / width))))
    l = left.withColumn("__b", bucket)
    cond = [l[k] == r[k] for k in keys] + [l["__b"] == r["__b"], l[lt] >= r[rt] - F.expr(f"INTERVAL {before} SECONDS"), l[lt] <= r[rt] + F.expr(f"INTERVAL {after} SECONDS")]
    joined = l.join(r, cond, how)
    return joined.select(*[l[c] for c in left.columns], *[r[c] for c in right.columns if c not in keys])


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark cuts each task's groups to ``k`` before the shuffle."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rn") <= k).drop("__rn")


def fixed_size_sample(df: DataFrame, k: int, seed: int = 0, replacement: bool = False) -> DataFrame:
    """Exactly ``k`` rows (or all, if fewer): the least ``k`` random keys, kept per task and then merged."""
    if not replacement:
        return df.orderBy(F.rand(seed)).limit(k)
    draws = df.select(F.struct(*df.columns).alias("row"))
    slots = draws.sparkSession.range(k).select(F.col("id").alias("slot"))
    n = df.count()
    picks = slots.select(F.floor(F.rand(seed) * n).cast("long").alias("__i"))
    return zip_with_index(df, "__i").join(picks, "__i").drop("__i")


def zip_with_index(df: DataFrame, name: str = "index") -> DataFrame:
    """Dense index in the frame's order: counts per partition give offsets, rows add their number within it.

    Rows are written once with their partition and number: executed a second time, a sorted frame would sample other ranges.
    """
    given = [F.col(f"`{c}`") for c in df.columns]
    marked = cut(df.select(F.struct(*[c.alias(n) for c, n in zip(given, df.columns)]).alias("row"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")), "indexed")
    counts = marked.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("p", before.alias("o"))  # one row a partition
    within = F.col("m") - F.shiftleft(F.col("p").cast("long"), 33)
    kept = [F.col(f"row.`{c}`").alias(c) for c in df.columns if c != name]
    return marked.join(F.broadcast(offsets), "p").select(*kept, (F.col("o") + within).alias(name))


def zip_with_unique_id(df: DataFrame, name: str = "id") -> DataFrame:
    return df.withColumn(name, F.monotonically_increasing_id())


def count_per_partition(df: DataFrame) -> DataFrame:
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("n"))


def checksum(df: DataFrame) -> DataFrame:
    """Order-free checksum and count of all rows."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("checksum"))


def collect_multiset(by: Sequence[str], value: str, df: DataFrame) -> DataFrame:
    """Per group a map from value to its number of occurrences; nulls are skipped. Counted before values are gathered."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).cast("int").alias("n"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(value), F.col("n"))))).alias("multiset"))


def min_row(df: DataFrame, by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The row of each group that is least by ``fields`` in order; ties go to the least whole row."""
    return df.groupBy(*by).agg(F.min(F.struct(*fields, F.struct(*df.columns).alias("__row"))).alias("m")).select("m.__row.*")


def max_row(df: DataFrame, by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.max(F.struct(*fields, F.struct(*df.columns).alias("__row"))).alias("m")).select("m.__row.*")


def tumbling_count(df: DataFrame, by: Sequence[str], order: Sequence[str], size: int, aggs: Sequence[Column]) -> DataFrame:
    """Windows of ``size`` rows in order per key; an incomplete last window is dropped."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return df.withColumn("window", F.floor(n / size)).groupBy(*by, "window").agg(F.count(F.lit(1)).alias("__n"), *aggs).where(F.col("__n") == size).drop("__n")


def sliding_by_panes(df: DataFrame, ts: str, size: int, slide: int, by: Sequence[str], value: str) -> DataFrame:
    """Sliding count and sum (seconds) by panes: rows are aggregated once per pane, panes are added up per window."""
    from math import gcd

    pane = gcd(size, slide)
    second = F.unix_timestamp(F.col(ts).cast("timestamp"))
    panes = df.groupBy(*by, (F.floor(second / pane) * pane).alias("pane")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"))
    last = F.floor(F.col("pane") / slide) * slide
    first = F.ceil((F.col("pane") - size + pane) / slide) * slide
    starts = panes.withColumn("start", F.explode(F.sequence(first.cast("long"), last.cast("long"), F.lit(slide).cast("long"))))
    return starts.groupBy(*by, "start").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def grouping_legacy(column: str) -> Column:
    """1 where the column IS grouped: the inverse of the SQL standard's GROUPING."""
    return 1 - F.grouping(column)


def group_id_legacy(columns: Sequence[str]) -> Column:
    """Sum of 1 << i over the grouped columns, the first column being bit 0."""
    return sum((grouping_legacy(c).cast("int") * (1 << i) for i, c in enumerate(columns)), F.lit(0))


def summarize(df: DataFrame) -> DataFrame:
    """One row per column: count, nulls, and by type NaN and infinity counts, extremes, moments, lengths, truth counts."""
    rows = []
    for name, kind in df.dtypes:
        c = F.col(name)
        number = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
        real = kind in ("float", "double")
        ok = c.isNotNull() & ~(F.isnan(c) | c.isin(float("inf"), float("-inf"))) if real else c.isNotNull()
        x = F.when(ok, c.cast("double")) if number else F.lit(None).cast("double")
        length = F.length(c).cast("double") if kind == "string" else F.lit(None).cast("double")
        rows.append(
            F.struct(
                F.lit(name).alias("column"), F.count(c).alias("n"), F.count(F.when(c.isNull(), 1)).alias("nulls"),
                (F.count(F.when(F.isnan(c), 1)) if real else F.lit(0)).cast("long").alias("nans"),
                (F.count(F.when(c.isin(float("inf"), float("-inf")), 1)) if real else F.lit(0)).cast("long").alias("infinities"),
                F.min(x).alias("min"), F.max(x).alias("max"), F.sum(x).alias("sum"), F.avg(x).alias("mean"), F.var_samp(x).alias("variance"), F.stddev_samp(x).alias("stddev"),
                F.min(length).alias("min_length"), F.max(length).alias("max_length"), F.avg(length).alias("mean_length"),
                (F.count(F.when(c, 1)) if kind == "boolean" else F.lit(0)).cast("long").alias("trues"),
            )
        )
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def accumulate(df: DataFrame, run: Callable[[DataFrame], object], **counters: Column) -> dict:
    """Run an action on ``df`` while ``counters`` (aggregates) observe its rows; returns them by name."""
    seen = Observation()
    run(df.observe(seen, *[c.alias(name) for name, c in counters.items()]))
    return seen.get


def map_partition(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Iterator of pandas frames to iterator of pandas frames, per partition."""
    return df.mapInPandas(fn, schema)


def reduce_group(df: DataFrame, by: Sequence[str], fn: Callable, schema: str) -> DataFrame:
    """A function of all rows of a key. For associative reductions prefer an aggregate: it combines before the shuffle."""
    return df.groupBy(*by).applyInPandas(fn, schema)


def combine_group(df: DataFrame, by: Sequence[str], fn: Callable, schema: str) -> DataFrame:
    """A function of the rows of a key within each batch of a partition; no shuffle."""

    def run(frames):
        for frame in frames:
            for _, group in frame.groupby(list(by), dropna=False, sort=False):
                yield fn(group)

    return df.mapInPandas(run, schema)


def co_group(left: DataFrame, right: DataFrame, keys: Sequence[str], fn: Callable, schema: str) -> DataFrame:
    """A function of both sides' rows of each key; a side may be empty."""
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(fn, schema)


def fold(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, start: Column, step: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """An ordered fold over the values of each key, in the JVM."""
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v")))).alias("rows"))
    return rows.select(*by, F.aggregate("rows", start, lambda acc, r: step(acc, r["__v"])).alias(name))


def partition_custom(df: DataFrame, n: int, bucket: Column) -> DataFrame:
    """Rows of bucket ``i`` (0..n-1) go to one partition of their own; buckets are not split."""
    return df.repartitionById(n, bucket.cast("int")) if hasattr(df, "repartitionById") else df.repartition(n, bucket)


def split(df: DataFrame, **conditions: Column) -> dict[str, DataFrame]:
    """Named outputs by condition; a row may be in several."""
    return {name: df.where(cond) for name, cond in conditions.items()}


JOIN_HINTS = {"broadcast_first": ("broadcast", None), "broadcast_second": (None, "broadcast"), "repartition_hash_first": ("shuffle_hash", None), "repartition_hash_second": (None, "shuffle_hash"), "repartition_sort_merge": ("merge", "merge"), "optimizer": (None, None)}


def join_with_hint(left: DataFrame, right: DataFrame, on, how: str = "inner", hint: str = "optimizer") -> DataFrame:
    """A join with one of the strategies of ``JOIN_HINTS``. Broadcast hints are the caller's word that a side is small."""
    first, second = JOIN_HINTS[hint]
    return (left.hint(first) if first else left).join(right.hint(second) if second else right, on, how)


def reduce_rows(df: DataFrame, key: str, combine: Callable[[dict, dict], dict]) -> DataFrame:
    """One row for each ``key``, from all of its rows by ``combine``, a function of two rows (without the key) that is associative and commutative.

    Each task first reduces what it has and passes that on whenever it holds ``REDUCED`` keys, so a hot key leaves a task as few
    rows; these are dealt by key and reduced again. Rows whose key is null are one group.
    """
    names = list(df.columns)
    columns = [c for c in names if c != key]

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        out = lambda: pd.DataFrame([(k, *[r[c] for c in columns]) for k, r in held.items()], columns=[key, *columns])[names]
        for frame in frames:
            for row in frame.to_dict("records"):
                k = row.pop(key)
                k = None if pd.isna(k) else k
                held[k] = combine(held[k], row) if k in held else row
            if len(held) > REDUCED:
                yield out()
                held.clear()
        if held:
            yield out()

    def last(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # sorted by key, so that only one key is open at a time, whatever their number
        open_key, held = None, None
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                k = row.pop(key)
                k = None if pd.isna(k) else k
                if held is not None and k == open_key:
                    held = combine(held, row)
                    continue
                if held is not None:
                    rows.append({key: open_key, **held})
                open_key, held = k, row
            if rows:
                yield pd.DataFrame(rows)[names]
        if held is not None:
            yield pd.DataFrame([{key: open_key, **held}])[names]

    first = df.mapInPandas(fold, df.schema)
    return first.repartition(key).sortWithinPartitions(key).mapInPandas(last, df.schema)
