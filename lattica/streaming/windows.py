"""Event-time windows, joins and routing that work alike on batch and streaming frames."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.plans.lineage import shared_dir


def with_rowtime(df: DataFrame, ts: str, delay: str | None = None) -> DataFrame:
    """``ts`` as a TIMESTAMP, with a watermark on streams (bounded out-of-orderness; "0 seconds" for ascending time)."""
    out = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, delay) if delay and df.isStreaming else out


def tumble(df: DataFrame, ts: str, size: str, by: Sequence[str], aggs: Sequence[Column], offset: str | None = None) -> DataFrame:
    w = F.window(ts, size, size, offset) if offset else F.window(ts, size)
    return df.groupBy(w.alias("w"), *by).agg(*aggs).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *[a for a in _names(df, by, aggs)])


def slide(df: DataFrame, ts: str, size: str, every: str, by: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    return df.groupBy(F.window(ts, size, every).alias("w"), *by).agg(*aggs).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *_names(df, by, aggs))


def session(df: DataFrame, ts: str, gap, by: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """``gap``: a duration, or a column with one (dynamic gap). An event exactly at the end joins the session."""
    return df.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(*aggs).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *_names(df, by, aggs))


def _names(df: DataFrame, by: Sequence[str], aggs: Sequence[Column]) -> list[str]:
    return df.groupBy(*by).agg(*aggs).columns[len(by) :]


def window_join(left: DataFrame, right: DataFrame, key: str, lt: str, rt: str, size: str) -> DataFrame:
    """Pairs of equal key in the same tumbling window; other columns must not clash."""
    l = left.withColumn("window_start", F.window(lt, size)["start"])
    r = right.withColumn("window_start", F.window(rt, size)["start"])
    return l.join(r, ["window_start", key])


def interval_join(left: DataFrame, right: DataFrame, key: str, lt: str, rt: str, before: str, after: str, how: str = "inner") -> DataFrame:
    """``left.lt BETWEEN right.rt - before AND right.rt + after`` on equal keys; Spark cleans stream state by watermark."""
    r = right.withColumnRenamed(key, f"__{key}")
    cond = (F.col(key) == F.col(f"__{key}")) & (F.col(lt) >= F.col(rt) - F.expr(f"INTERVAL {before}")) & (F.col(lt) <= F.col(rt) + F.expr(f"INTERVAL {after}"))
    return left.join(r, cond, how).drop(f"__{key}")


def split_late(df: DataFrame, ts: str, watermark: Column) -> tuple[DataFrame, DataFrame]:
    """(on time, late) by a watermark value, as inside ``foreachBatch``."""
    return df.where(F.col(ts) > watermark), df.where(F.col(ts) <= watermark)


def run_to_end(stream: DataFrame, mode: str = "append", once: bool = False, checkpoint: str | None = None, drain: bool = False) -> DataFrame:
    """Run a stream over all available input into the shared folder and read the result back.

    Each micro-batch overwrites a folder of its own number, so a repeated batch leaves no second copy; in ``complete`` mode
    the last batch replaces the earlier ones. ``once`` runs a single batch: a query with state that expires by processing
    time would go on with empty ones. ``checkpoint`` names a folder for the state, to read it afterwards.
    ``drain`` goes on until the source has no more, for sources that don't know at the start what is available.
    """
    spark: SparkSession = stream.sparkSession
    base = f"{shared_dir(spark)}/lattica/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.parquet(f"{base}/out/batch=none")

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out/batch={'all' if mode == 'complete' else batch}")

    writer = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint or f"{base}/checkpoint")
    if drain:
        query = writer.start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    else:
        writer.trigger(**({"once": True} if once else {"availableNow": True})).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out/batch=*")


def async_lookup(df: DataFrame, fn, schema: str, capacity: int = 16, timeout: float = 10.0, ordered: bool = True) -> DataFrame:
    """Enrich rows by calls that wait: a pool of threads per task. ``fn`` maps a row (dict) to a row; a timeout gives nulls."""
    columns = [part.strip().split()[0] for part in schema.split(",")]

    def run(frames):
        import concurrent.futures as cf

        import pandas as pd

        with cf.ThreadPoolExecutor(capacity) as pool:
            for frame in frames:
                jobs = [pool.submit(fn, r) for r in frame.to_dict("records")]
                rows = []
                for job in jobs if ordered else cf.as_completed(jobs):
                    try:
                        rows.append(job.result(timeout=timeout))
                    except cf.TimeoutError:
                        rows.append(dict.fromkeys(columns))
                yield pd.DataFrame(rows, columns=columns)

    return df.mapInPandas(run, schema)
