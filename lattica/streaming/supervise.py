"""Streams that restart after failures, and streams that feed themselves."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


@dataclass
class FixedDelay:
    """At most ``attempts`` restarts, ``delay`` seconds apart."""

    attempts: int
    delay: float = 0.0

    def allows(self, failures: list[float]) -> bool:
        return len(failures) <= self.attempts


@dataclass
class FailureRate:
    """Restarts as long as no ``interval`` of seconds has more than ``most`` failures."""

    most: int
    interval: float
    delay: float = 0.0

    def allows(self, failures: list[float]) -> bool:
        return sum(t > failures[-1] - self.interval for t in failures) <= self.most


def supervise(start: Callable[[], StreamingQuery], strategy: FixedDelay | FailureRate) -> int:
    """Start a query, and again from its checkpoint each time it fails, until it ends; returns the number of failures.

    When the strategy allows no more, the last failure is raised.
    """
    failures: list[float] = []
    while True:
        try:
            start().awaitTermination()
            return len(failures)
        except StreamingQueryException:
            failures.append(time.monotonic())
            if not strategy.allows(failures):
                raise
            time.sleep(strategy.delay)


def feedback(start: DataFrame, step: Callable[[DataFrame], tuple[DataFrame, DataFrame]], base: str) -> DataFrame:
    """A stream whose batches are split by ``step`` into results and rows that come back; ends when none comes back.

    Rows that come back are written into the folder that the stream reads, a folder for each batch, so a repeated batch replaces
    what it wrote. ``step``'s second frame has the columns of ``start``. Returns all results.
    """
    spark = start.sparkSession
    start.write.parquet(f"{base}/in/start")
    last: deque[bool] = deque([True], maxlen=1)

    def turn(batch: DataFrame, number: int) -> None:
        out, back = step(batch)
        out.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        returned = not back.isEmpty()
        if returned:
            back.select(*start.columns).write.mode("overwrite").parquet(f"{base}/in/batch-{number}")
        last.append(returned)

    stream = spark.readStream.schema(start.schema).parquet(f"{base}/in/*")
    query = stream.writeStream.foreachBatch(turn).option("checkpointLocation", f"{base}/checkpoint").start()
    try:
        while last[0]:
            query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.parquet(f"{base}/out").drop("batch")
