"""Sources and sinks: declarative descriptors, files, and write modes."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lattica.plans.lineage import cut


@dataclasses.dataclass
class Source:
    """Connector + format + schema + rowtime, turned into a reader.

    ``fields`` renames physical columns, ``computed`` adds expressions, ``rowtime`` is (column, expression, delay).
    """

    connector: str
    format: str = "parquet"
    path: str | None = None
    schema: str | None = None
    options: dict[str, str] = dataclasses.field(default_factory=dict)
    fields: dict[str, str] = dataclasses.field(default_factory=dict)
    computed: dict[str, str] = dataclasses.field(default_factory=dict)
    rowtime: tuple[str, str, str] | None = None

    def validate(self) -> None:
        if self.connector not in ("filesystem", "kafka", "jdbc", "socket", "rate"):
            raise ValueError(f"unknown connector {self.connector}")
        if self.connector == "filesystem" and not self.path:
            raise ValueError("a filesystem source needs a path")
        if self.connector == "kafka" and not ({"subscribe", "subscribePattern", "assign"} & self.options.keys()):
            raise ValueError("a kafka source needs a topic")
        if self.connector == "jdbc" and not {"url", "dbtable"} <= self.options.keys():
            raise ValueError("a jdbc source needs url and dbtable")

    def properties(self) -> dict[str, str]:
        out = {"connector.type": self.connector, "format.type": self.format, **{f"connector.{k}": v for k, v in self.options.items()}}
        return out | ({"connector.path": self.path} if self.path else {}) | ({"schema": self.schema} if self.schema else {})

    def load(self, spark: SparkSession, streaming: bool = False) -> DataFrame:
        self.validate()
        reader = (spark.readStream if streaming else spark.read).format(self.format if self.connector == "filesystem" else self.connector).options(**self.options)
        if self.schema:
            reader = reader.schema(self.schema)
        df = reader.load(self.path) if self.path else reader.load()
        if self.fields:
            df = df.select(*[F.col(physical).alias(logical) for logical, physical in self.fields.items()])
        for name, expression in self.computed.items():
            df = df.withColumn(name, F.expr(expression))
        if self.rowtime:
            name, expression, delay = self.rowtime
            df = df.withColumn(name, F.expr(expression).cast("timestamp"))
            df = df.withWatermark(name, delay) if streaming else df
        return df


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", row: str | None = None, quote: str = '"', header: bool = False, comment: str | None = None, lenient: bool = False, fields: Sequence[str] | None = None) -> DataFrame:
    """Delimited text with typed columns; ``lenient`` drops rows that don't parse, ``fields`` keeps some columns only."""
    options = {"sep": sep, "quote": quote, "header": str(header).lower(), "mode": "DROPMALFORMED" if lenient else "FAILFAST"}
    options |= ({"lineSep": row} if row else {}) | ({"comment": comment} if comment else {})
    df = spark.read.schema(schema).options(**options).csv(path)
    return df.select(*fields) if fields else df


def read_lines(spark: SparkSession, path: str, sep: str | None = None, whole: bool = False) -> DataFrame:
    reader = spark.read.option("wholetext", str(whole).lower())
    return (reader.option("lineSep", sep) if sep else reader).text(path)


def read_primitives(spark: SparkSession, path: str, kind: str, sep: str = "\n") -> DataFrame:
    """One value per delimited record; what doesn't parse is null."""
    return spark.read.option("lineSep", sep).text(path).select(F.trim("value").try_cast(kind).alias("value"))


def read_filtered(spark: SparkSession, path: str, format: str, glob: str | None = None, recursive: bool = False, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return (reader.schema(schema) if schema else reader).format(format).load(path)


def record_time(df: DataFrame, name: str = "rowtime") -> DataFrame:
    """Row time from the record's own time, which for files is the modification time."""
    return df.select("*", F.col("_metadata.file_modification_time").alias(name))


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, lower: int = 0, upper: int = 0, parts: int = 1, predicates: Sequence[str] | None = None, **options: str) -> DataFrame:
    """A table or ``(query) alias``, read in ranges of a numeric column or with one task for each of ``predicates``, which part all rows."""
    if predicates is not None:
        return spark.read.jdbc(url, table, predicates=list(predicates), properties=options)
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column:
        reader = reader.options(partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts))
    return reader.load()


# sinks
def write_csv(df: DataFrame, path: str, sep: str = ",", files: int | None = None, overwrite: bool = False) -> None:
    """Null as an empty field, no quoting."""
    df = df.coalesce(files) if files else df
    df.write.mode("overwrite" if overwrite else "error").options(sep=sep, emptyValue="", nullValue="", quote="").csv(path)


def apply_jdbc(df: DataFrame, url: str, staging: str, statements: Sequence[str], **options: str) -> None:
    """Write ``df`` to the table ``staging`` from all tasks, run ``statements`` over it in one transaction, and drop it.

    The statements (an insertion, update or merge from the staging table) take effect wholly or not at all, whatever tasks are repeated
    or fail while the rows are staged.
    """
    df.write.mode("overwrite").jdbc(url, staging, properties=options)
    _transact(df.sparkSession, url, statements)
    _transact(df.sparkSession, url, [f"DROP TABLE {staging}"])


def jdbc_sink(stream: DataFrame, url: str, staging: str, statements: Sequence[str], checkpoint: str, log: str, **options: str):
    """Apply each micro-batch of ``stream`` as :func:`apply_jdbc` does, once: its number goes to the table ``log`` (``batch``, a primary key, which
    must exist) in the same transaction, and a batch whose number is there is left out."""
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        if read_jdbc(spark, url, f"(SELECT batch FROM {log} WHERE batch = {number}) done", **options).isEmpty():
            apply_jdbc(batch, url, staging, [*statements, f"INSERT INTO {log} VALUES ({number})"], **options)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _transact(spark: SparkSession, url: str, statements: Sequence[str]) -> None:
    connection = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    try:
        connection.setAutoCommit(False)
        run = connection.createStatement()
        try:
            for text in statements:
                run.execute(text)
            connection.commit()
        except Exception:
            connection.rollback()
            raise
    finally:
        connection.close()


def cached_file(df: DataFrame, most_rows: int) -> str:
    """Ship a small table to every node as one Parquet file; Python functions in tasks read it from ``SparkFiles.get(name)`` by the returned name.

    A table of more than ``most_rows`` rows is an error: join it instead.
    """
    if df.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"a cached file holds {most_rows} rows at most; join larger tables")
    path = cut(df.coalesce(1), "cached").inputFiles()[0]
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


def write_buckets(df: DataFrame, path: str, ts: str, pattern: str = "yyyy-MM-dd--HH", format: str = "parquet") -> None:
    """Files by time bucket."""
    df.withColumn("bucket", F.date_format(ts, pattern)).write.mode("append").partitionBy("bucket").format(format).save(path)


def upsert(target: DataFrame, changes: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Apply keyed changes (``_op`` 1 upsert, -1 delete; the last by ``order`` counts) to a table state."""
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*changes.columns), order).alias("c")).select("c.*")
    kept = target.join(last, list(keys), "left_anti")
    return kept.unionByName(last.where("_op = 1").select(*target.columns))


def insert_into(spark: SparkSession, df: DataFrame, table: str) -> None:
    """``INSERT INTO``: names don't matter, number and types of columns do."""
    target = spark.table(table)
    if len(target.columns) != len(df.columns):
        raise ValueError(f"{table} has {len(target.columns)} columns, the query {len(df.columns)}")
    for (name, want), (_, have) in zip(target.dtypes, df.dtypes, strict=True):
        if want != have:
            raise ValueError(f"column {name} of {table} is {want}, the query gives {have}")
    df.write.insertInto(table)


class Catalog:
    """Tables of one database: make, list, read, alter and drop. As a context, the database lives as long as the session needs
    its frames; its table names are dropped at the end and the files stay, so that frames made inside remain readable."""

    def __init__(self, spark: SparkSession, database: str):
        self.spark, self.database = spark, database

    def __enter__(self) -> Catalog:
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database}")
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.sql(f"DROP DATABASE {self.database} CASCADE")

    def create(self, name: str, schema: str, path: str, properties: dict[str, str] | None = None, format: str = "parquet") -> None:
        """An external table over a folder."""
        listed = ", ".join(f"'{k}' = '{v}'" for k, v in (properties or {}).items())
        self.spark.sql(f"DROP TABLE IF EXISTS {self.database}.{name}")
        self.spark.sql(f"CREATE TABLE {self.database}.{name} ({schema}) USING {format} LOCATION '{path}'" + (f" TBLPROPERTIES ({listed})" if listed else ""))

    def alter(self, name: str, properties: dict[str, str]) -> None:
        self.spark.sql(f"ALTER TABLE {self.database}.{name} SET TBLPROPERTIES ({', '.join(f'{k!r} = {v!r}' for k, v in properties.items())})")

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {self.database}.{name}")

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.database) if not t.isTemporary)

    def properties(self, name: str) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES {self.database}.{name}").collect()}

    def table(self, name: str) -> DataFrame:
        """The table's files as they are now."""
        location = next(r["data_type"] for r in self.spark.sql(f"DESCRIBE EXTENDED {self.database}.{name}").collect() if r["col_name"] == "Location")
        table = self.spark.table(f"{self.database}.{name}")
        return self.spark.read.schema(table.schema).parquet(location)


def for_each_interval(df: DataFrame, write: Callable[[DataFrame, int], None], interval: str, checkpoint: str):
    """A stream written by a function every ``interval``."""
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


class SequenceSource(DataSource):
    """``from``..``to`` as rows ``value``, in ``parts`` partitions; batch and stream (``perBatch`` rows a trigger)."""

    @classmethod
    def name(cls) -> str:
        return "sequence"

    def schema(self) -> str:
        return "value long"

    def _range(self) -> tuple[int, int]:
        return int(self.options.get("from", 0)), int(self.options["to"])

    def reader(self, schema) -> DataSourceReader:
        lo, hi = self._range()
        return _SequenceReader(lo, hi, int(self.options.get("parts", 4)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        lo, hi = self._range()
        return _SequenceStream(lo, hi, int(self.options.get("perBatch", 1000)))


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class _SequenceReader(DataSourceReader):
    def __init__(self, lo: int, hi: int, parts: int):
        self.lo, self.hi, self.parts = lo, hi, parts

    def partitions(self):
        step = max(1, -(-(self.hi - self.lo + 1) // self.parts))
        return [_Range(a, min(a + step - 1, self.hi)) for a in range(self.lo, self.hi + 1, step)] or [_Range(0, -1)]

    def read(self, partition):
        for v in range(partition.lo, partition.hi + 1):
            yield (v,)


class _SequenceStream(DataSourceStreamReader):
    def __init__(self, lo: int, hi: int, per: int):
        self.lo, self.hi, self.per, self.at = lo, hi, per, lo

    def initialOffset(self):
        return {"next": self.lo}

    def latestOffset(self):
        self.at = min(self.at + self.per, self.hi + 1)
        return {"next": self.at}

    def partitions(self, start, end):
        return [_Range(start["next"], end["next"] - 1)]

    def read(self, partition):
        for v in range(partition.lo, partition.hi + 1):
            yield (v,)
