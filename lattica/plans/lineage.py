"""Cutting lineage through a folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.

    ``spark.checkpoint.dir`` names it. Only where that is unset on a local master (tests, one machine) is a folder of our
    own made and remembered in the session; on a cluster, whose executors don't share one, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lattica.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="lattica-checkpoint-")
        spark.conf.set("lattica.checkpoint.dir", found)
    return found.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Files written inside the open :func:`scratch` contexts.
_written: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what :func:`cut` has written inside, but for frames cut with ``keep``.

    For a result that is written inside the context: frames that still read the deleted files can't be used afterwards.
    """
    _written.append([])
    try:
        yield
    finally:
        for path in _written.pop():
            _delete(spark, path)


def cut(df: DataFrame, name: str = "cut", by: Sequence[str] = (), keep: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back; ``by`` columns become folders, and come last.

    The result has no lineage but the files, so a lost executor costs a reread and not a recomputation of a loop. Nothing reads the shuffles behind it again, so
    their files go at once and not when the driver collects garbage.
    """
    path = f"{shared_dir(df.sparkSession)}/lattica/{name}-{uuid.uuid4().hex}"
    if _written and not keep:
        _written[-1].append(path)
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files behind a frame that :func:`cut` returned and nothing needs any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lattica/" in path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
