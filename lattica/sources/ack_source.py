"""A source that acknowledges messages once they are safe.

Messages lie as JSON lines in files of ``path``/pending. A micro-batch takes the files that wait; when Spark has committed it, its files move
to ``path``/acked and never come again. Between the two, a crash gives them once more, as do senders that repeat a message, so
:func:`read_once` drops ids seen before within the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.json as pj
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class _File(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class _Reader(DataSourceStreamReader):
    """Offsets name the files of their batch, so a repeated batch reads the same."""

    def __init__(self, path: str, schema: StructType, most: int):
        self.path, self.schema, self.most = path, to_arrow_schema(schema), most
        self.last: dict = self.initialOffset()

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def initialOffset(self) -> dict:
        return {"batch": 0, "files": []}

    def latestOffset(self) -> dict:
        store, root = self._store()
        listed = store.get_file_info(fs.FileSelector(f"{root}/pending", allow_not_found=True))
        waiting = sorted(i.base_name for i in listed if i.type == fs.FileType.File and not i.base_name.startswith(("_", ".")))
        new = [f for f in waiting if f not in set(self.last["files"])][: self.most]
        if new:
            self.last = {"batch": self.last["batch"] + 1, "files": new}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[_File]:
        if end["batch"] > self.last["batch"]:
            self.last = end  # a batch of an earlier run
        return [_File(f) for f in end["files"]]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        store, root = self._store()
        found = [p for p in (f"{root}/pending/{partition.name}", f"{root}/acked/{partition.name}") if store.get_file_info(p).type == fs.FileType.File]
        if not found or not store.get_file_info(found[0]).size:
            return
        with store.open_input_stream(found[0]) as f:
            yield from pj.read_json(f, parse_options=pj.ParseOptions(explicit_schema=self.schema, unexpected_field_behavior="ignore")).select(self.schema.names).to_batches()

    def commit(self, end: dict) -> None:
        store, root = self._store()
        store.create_dir(f"{root}/acked")
        for f in end["files"]:
            if store.get_file_info(f"{root}/pending/{f}").type == fs.FileType.File:
                store.move(f"{root}/pending/{f}", f"{root}/acked/{f}")


class AckSource(DataSource):
    """Format ``acknowledged``: option ``path``, and ``filesPerBatch`` at most; the schema is the reader's."""

    @classmethod
    def name(cls) -> str:
        return "acknowledged"

    def streamReader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], schema, int(self.options.get("filesPerBatch", 1000)))


def read_once(spark: SparkSession, path: str, schema: StructType, ident: str, micros: str, within: str, files_per_batch: int = 1000) -> DataFrame:
    """The stream of messages with ``in_time`` (of ``micros``, in microseconds); of rows with one ``ident`` that come ``within`` the watermark, the first."""
    spark.dataSource.register(AckSource)
    rows = spark.readStream.format("acknowledged").schema(schema).option("path", path).option("filesPerBatch", str(files_per_batch)).load()
    return rows.withColumn("in_time", F.timestamp_micros(micros)).withWatermark("in_time", within).dropDuplicatesWithinWatermark([ident])
