"""A streaming file sink with buckets, rolling files and exactly-once results.

A task writes hidden in-progress files, one for each bucket at a time, and rolls them by size and age. When it ends, its files are
pending and their names go to the driver. The commit of a batch writes one manifest (pending name, final name) and then
renames. A batch that Spark repeats finds its manifest: the first attempt's renames are finished and the new files deleted. What
neither a manifest nor a task message names belongs to a failed attempt; :func:`recover` removes it before a query starts.

Files are written with ``pyarrow.fs``, so ``path`` may be any address that it opens, in a store that all executors reach.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

_BUCKET = "_bucket"
#: Manifests of so many last batches stay.
_KEEP = 10


@dataclass
class _Pending(WriterCommitMessage):
    """(bucket, name) of a task's closed files."""

    files: list[tuple[str, str]]


class _Store:
    """The sink's folder."""

    def __init__(self, path: str):
        self.fs, self.root = fs.FileSystem.from_uri(path)

    def at(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def exists(self, path: str) -> bool:
        return self.fs.get_file_info(path).type != fs.FileType.NotFound

    def move(self, source: str, target: str) -> None:
        """Rename; a rename that an earlier attempt has done already is no error."""
        if self.exists(source):
            self.fs.move(source, target)

    def listed(self, *parts: str, recursive: bool = False) -> list[fs.FileInfo]:
        return self.fs.get_file_info(fs.FileSelector(self.at(*parts), allow_not_found=True, recursive=recursive))

    def manifests(self) -> dict[int, str]:
        return {int(i.base_name.removesuffix(".json")): i.path for i in self.listed("_commits") if i.base_name.endswith(".json")}

    def renames(self, manifest: str) -> list[list[str]]:
        with self.fs.open_input_stream(manifest) as f:
            return json.loads(f.read())

    def publish(self, renames: list[list[str]]) -> None:
        for source, target in renames:
            self.move(self.at(source), self.at(target))


class _Open:
    """A file that is being written."""

    def __init__(self, store: _Store, bucket: str, schema: pa.Schema):
        self.bucket, self.name, self.began = bucket, f"_{uuid.uuid4().hex}", time.monotonic()
        store.fs.create_dir(store.at(bucket))
        self.path = store.at(bucket, self.name + ".in-progress")
        self.stream = store.fs.open_output_stream(self.path)
        self.writer = pq.ParquetWriter(self.stream, schema)


class _Writer(DataSourceStreamArrowWriter):
    def __init__(self, path: str, roll_bytes: int, roll_seconds: float, open_files: int):
        self.path, self.roll_bytes, self.roll_seconds, self.open_files = path, roll_bytes, roll_seconds, open_files

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Pending:
        store, opened, done = _Store(self.path), {}, []

        def close(o: _Open) -> None:
            o.writer.close()
            o.stream.close()
            store.fs.move(o.path, store.at(o.bucket, o.name + ".pending"))
            done.append((o.bucket, o.name))
            del opened[o.bucket]

        for batch in iterator:
            for bucket in pc.unique(batch.column(_BUCKET)).to_pylist():
                rows = batch.filter(pc.equal(batch.column(_BUCKET), bucket)).drop_columns([_BUCKET])
                if bucket in opened:
                    o = opened.pop(bucket)
                else:
                    if len(opened) >= self.open_files:  # the one that waits longest for rows
                        close(next(iter(opened.values())))
                    o = _Open(store, bucket, rows.schema)
                opened[bucket] = o
                o.writer.write_batch(rows)
                if o.stream.tell() >= self.roll_bytes or time.monotonic() - o.began >= self.roll_seconds:
                    close(o)
        for o in list(opened.values()):
            close(o)
        return _Pending(done)

    def commit(self, messages: list[_Pending | None], batchId: int) -> None:
        store = _Store(self.path)
        files = [f for m in messages if m for f in m.files]
        store.fs.create_dir(store.at("_commits"))
        manifests = store.manifests()
        if batchId in manifests:
            renames = store.renames(manifests[batchId])
            known = {source for source, _ in renames}
            for bucket, name in files:
                if f"{bucket}/{name}.pending" not in known:
                    store.fs.delete_file(store.at(bucket, name + ".pending"))
        else:
            renames = [[f"{b}/{n}.pending", f"{b}/part-{batchId}{n}.parquet"] for b, n in files]
            draft = store.at("_commits", f"_{uuid.uuid4().hex}")
            with store.fs.open_output_stream(draft) as f:
                f.write(json.dumps(renames).encode())
            store.fs.move(draft, store.at("_commits", f"{batchId}.json"))
        store.publish(renames)
        for batch, path in manifests.items():
            if batch <= batchId - _KEEP:
                store.fs.delete_file(path)

    def abort(self, messages: list[_Pending | None], batchId: int) -> None:
        store = _Store(self.path)
        for bucket, name in (f for m in messages if m for f in m.files):
            if store.exists(path := store.at(bucket, name + ".pending")):
                store.fs.delete_file(path)


class BucketSink(DataSource):
    """Format ``bucketed``: options ``path``, ``rollBytes``, ``rollSeconds``, ``openFiles``; rows carry ``_bucket``."""

    @classmethod
    def name(cls) -> str:
        return "bucketed"

    def streamWriter(self, schema, overwrite: bool) -> _Writer:
        o = self.options
        return _Writer(o["path"], int(o.get("rollBytes", 128 << 20)), float(o.get("rollSeconds", 3600)), int(o.get("openFiles", 64)))


def recover(path: str) -> None:
    """Finish renames of committed batches and delete files of attempts that were never committed; for one writer a folder."""
    store = _Store(path)
    for manifest in store.manifests().values():
        store.publish(store.renames(manifest))
    for info in store.listed(recursive=True):
        if info.base_name.startswith("_") and info.base_name.endswith((".in-progress", ".pending")):
            store.fs.delete_file(info.path)


def write_bucketed(stream: DataFrame, path: str, ts: str, checkpoint: str, pattern: str = "yyyy-MM-dd--HH", roll_bytes: int = 128 << 20, roll_seconds: float = 3600, **trigger: object) -> StreamingQuery:
    """Start a query that writes Parquet under ``path``/bucket; the bucket is ``ts`` by ``pattern``, ``unknown`` where it is null.

    Readers see the files of committed batches only.
    """
    stream.sparkSession.dataSource.register(BucketSink)
    recover(path)
    bucket = F.coalesce(F.date_format(ts, pattern), F.lit("unknown"))
    writer = stream.withColumn(_BUCKET, bucket).writeStream.format("bucketed").options(path=path, rollBytes=str(roll_bytes), rollSeconds=str(roll_seconds))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_bucketed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The committed rows, with the ``bucket`` that each file lies in."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    return rows.withColumn("bucket", F.element_at(F.split("_metadata.file_path", "/"), -2))
