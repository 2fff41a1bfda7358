"""Watermarks by a strategy of the user's, with sources that may fall idle, and windows that close by them.

Spark derives a stream's watermark from its largest time. Here each row may propose a mark, or none: all rows with a delay (periodic), only
rows that carry a punctuation, or a column that an earlier system has set (preserved). With several sources the level is the lowest mark of
those that are active, so a slow source holds windows open and a silent one doesn't.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.plans.lineage import _delete

_MARKS = "source string, mark long, seen long"
_SUMS = "key string, start_us long, n long, c long, s double, closed boolean"


@dataclass(frozen=True)
class Strategy:
    """``mark``: from the column of a row's time in microseconds to the mark that it proposes, or null."""

    mark: Callable[[Column], Column]


def periodic(delay_us: int = 0) -> Strategy:
    """The largest time less a delay."""
    return Strategy(lambda at: at - delay_us)


def punctuated(marker: Column | str) -> Strategy:
    """The largest time of rows for which ``marker`` holds; other rows move nothing."""
    return Strategy(lambda at: F.when(F.expr(marker) if isinstance(marker, str) else marker, at))


def preserved(column: str) -> Strategy:
    """Marks that the rows bring along, in microseconds."""
    return Strategy(lambda at: F.col(column).cast("long"))


def ingested(stream: DataFrame, ts: str) -> DataFrame:
    """Rows with the time at which their micro-batch is processed as ``ts``; use with ``periodic(0)``."""
    return stream.withColumn(ts, F.current_timestamp())


@dataclass
class Closed:
    """Windows that the level has passed, and rows that came after theirs had closed."""

    windows: DataFrame
    late: DataFrame


def windows_by_mark(stream: DataFrame, key: str, ts: str, value: str, size_us: int, strategy: Strategy, base: str, source: str | None = None, idle_batches: int | None = None) -> Closed:
    """Sums of tumbling windows by key over all available input of ``stream``, each once, when the level has passed its end.

    ``windows``: key (text), start_us, n (rows), c (values), s (their sum), batch (in which it closed). ``late``: the rows of windows that had
    closed when their micro-batch began, with ``batch``. The level moves between micro-batches and never back. Of several sources it is the
    lowest mark of the active ones, and it waits while one of them has no mark; a source without rows in the last ``idle_batches``
    micro-batches (this one included) is idle, never if that is None, and active again with its next row. Rows without time are in no window
    and propose no mark. Null keys and null sources are one key and one source. A later call with the same ``base`` goes on.

    State is a table of sums of open windows and one of marks, written anew for each batch from those of the batch before, so a repeated batch
    gives the same; only the level, a number, reaches the driver.
    """
    if size_us < 1 or (idle_batches is not None and idle_batches < 1):
        raise ValueError("windows and idleness are at least 1 long")
    spark = stream.sparkSession
    of = lambda what, n: f"{base}/{what}/batch={n}"
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    start = at - F.pmod(at, F.lit(size_us))
    spark.createDataFrame([], _MARKS).write.mode("overwrite").parquet(of("marks", -1))
    spark.createDataFrame([], _SUMS).write.mode("overwrite").parquet(of("open", -1))
    spark.createDataFrame([(None,)], "level long").write.mode("overwrite").parquet(of("level", -1))

    def step(batch: DataFrame, n: int) -> None:
        batch.persist()
        try:
            before = spark.read.parquet(of("level", n - 1)).first()[0]
            named = F.col(source).cast("string") if source else F.lit("")
            new = batch.groupBy(named.alias("source")).agg(F.max(strategy.mark(at)).cast("long").alias("mark"), F.lit(n).cast("long").alias("seen"))
            marks = spark.read.schema(_MARKS).parquet(of("marks", n - 1)).unionByName(new).groupBy("source").agg(F.max("mark").alias("mark"), F.max("seen").alias("seen"))
            marks.write.mode("overwrite").parquet(of("marks", n))
            active = spark.read.schema(_MARKS).parquet(of("marks", n))
            if idle_batches is not None:
                active = active.where(F.col("seen") > n - idle_batches)
            lowest = active.agg(F.when(F.count("mark") == F.count(F.lit(1)), F.min("mark"))).first()[0]
            level = max((m for m in (before, lowest) if m is not None), default=None)
            spark.createDataFrame([(level,)], "level long").write.mode("overwrite").parquet(of("level", n))

            passed = lambda first, mark: F.coalesce(first + size_us <= F.lit(mark).cast("long"), F.lit(False))
            batch.where(passed(start, before)).write.mode("overwrite").parquet(of("late", n))
            fresh = batch.where(at.isNotNull() & ~passed(start, before)).groupBy(F.col(key).cast("string").alias("key"), start.alias("start_us"))
            parts = fresh.agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("c"), F.sum(F.col(value).cast("double")).alias("s"))
            held = spark.read.schema(_SUMS).parquet(of("open", n - 1)).where("not closed").drop("closed")
            sums = held.unionByName(parts).groupBy("key", "start_us").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.sum("s").alias("s"))
            sums.withColumn("closed", passed(F.col("start_us"), level)).write.mode("overwrite").parquet(of("open", n))
            spark.read.schema(_SUMS).parquet(of("open", n)).where("closed").drop("closed").write.mode("overwrite").parquet(of("out", n))
        finally:
            batch.unpersist()
        if n > 1:  # batch n - 1 is committed, so what came before it is read no more
            for what in ("marks", "open", "level"):
                _delete(spark, of(what, n - 2))

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return Closed(*(spark.read.schema(f"{schema}, batch long").parquet(f"{base}/{what}") for what, schema in (("out", "key string, start_us long, n long, c long, s double"), ("late", _ddl(stream)))))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
