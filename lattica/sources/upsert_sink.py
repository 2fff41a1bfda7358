"""A keyed table that a stream of changes keeps up to date.

Keys are dealt to buckets. A micro-batch rewrites only the buckets that it touches, each as a new folder, and then writes a manifest (bucket and
the batch that wrote it last, one row a bucket). Readers follow the last manifest, so they never see half a batch, and a repeated batch
begins again from the manifest before it.

The last change by ``order`` counts, in whatever order changes arrive: deletions stay as rows without values, so that an older change that
comes later doesn't bring a key back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


class KeyedTable:
    """``schema`` holds the columns of changes, with ``op`` (``delete`` names the value that takes a key away)."""

    def __init__(self, spark: SparkSession, base: str, schema: StructType, keys: Sequence[str], order: Sequence[str], op: str = "op", delete: str = "D", buckets: int = 64):
        self.spark, self.base, self.schema, self.keys, self.order, self.op, self.delete, self.buckets = spark, base, schema, list(keys), list(order), op, delete, buckets

    def _manifest(self, before: int | None = None) -> dict[int, int]:
        """Bucket to batch, of the last batch (before a given one); one row a bucket."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/manifests")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = [] if not fs.exists(path) else [int(s.getPath().getName()) for s in fs.listStatus(path) if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        done = [n for n in done if before is None or n < before]
        return {r.bucket: r.batch for r in self.spark.read.parquet(f"{self.base}/manifests/{max(done)}").collect()} if done else {}

    def _rows(self, manifest: dict[int, int], buckets: Sequence[int]) -> DataFrame:
        paths = [f"{self.base}/data/{manifest[b]}/bucket={b}" for b in buckets if b in manifest]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def apply(self, batch: DataFrame, number: int) -> None:
        """One micro-batch of changes; rows with a null key are left out."""
        given = batch.select(*self.schema.names).where(" and ".join(f"`{k}` is not null" for k in self.keys))
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = [r[0] for r in given.select(bucket).distinct().collect()]  # at most one row a bucket
        manifest = self._manifest(number)
        both = self._rows(manifest, touched).unionByName(given)
        last = both.groupBy(*self.keys).agg(F.max(F.struct(*self.order, F.struct(*self.schema.names).alias("row"))).alias("m")).select("m.row.*")
        last.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.base}/data/{number}")
        new = manifest | dict.fromkeys(touched, number)
        self.spark.createDataFrame(sorted(new.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.base}/manifests/{number}")

    def read(self) -> DataFrame:
        """The rows of keys that aren't deleted."""
        manifest = self._manifest()
        return self._rows(manifest, sorted(manifest)).where(~F.col(self.op).eqNullSafe(self.delete))

    def write(self, stream: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
