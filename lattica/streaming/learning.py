"""Learning on streams: the model is versioned state in the shared folder.

Version 0 is no model; version b + 1 is version b after one round of mixing over the examples of micro-batch b, so a repeated batch writes
the same version again. A batch's own predictions come from the version before it (test, then train). Predictor streams join a version
by its number, whenever and however often they run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.sharded import Learner, mixed, scores
from lattica.plans.lineage import drop

_MODEL = "feature string, w array<double>"


def model_version(spark: SparkSession, base: str, version: int) -> DataFrame:
    """The weights after ``version`` batches."""
    return spark.read.schema(_MODEL).parquet(f"{base}/models/version={version}") if version else spark.createDataFrame([], _MODEL)


def learn(stream: DataFrame, learner: Learner, base: str, machine: bool = False) -> DataFrame:
    """Run ``stream`` (shard, id, label, features) over all available input; returns id, batch and scores of every example so far.

    A later call with the same ``base`` goes on from the last version and takes what has come since.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        model = model_version(spark, base, number)
        scores(batch, model, machine).write.mode("overwrite").parquet(f"{base}/predictions/batch={number}")
        new = mixed(batch, learner, 1, start=model)
        new.write.mode("overwrite").parquet(f"{base}/models/version={number + 1}")
        drop(new)

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/predictions")


def predict(rows: DataFrame, base: str, version: str = "version") -> DataFrame:
    """id, version and scores of rows (id, features and the version that each asks for); batch or stream of micro-batches.

    Versions that don't exist score nothing: an empty array.
    """
    spark = rows.sparkSession
    models = spark.read.parquet(f"{base}/models").select(F.col("version").cast("long").alias("version"), "feature", "w")
    parts = rows.select("id", F.col(version).cast("long").alias("version"), F.explode_outer("features").alias("feature", "x")).join(models, ["version", "feature"], "left")
    terms = parts.select("id", "version", F.posexplode_outer("w").alias("d", "w"), "x").groupBy("id", "version", "d").agg(F.sum(F.col("w") * F.col("x")).alias("s"))
    listed = F.array_sort(F.collect_list(F.when(F.col("d").isNotNull(), F.struct("d", "s"))))
    return terms.groupBy("id", "version").agg(F.transform(listed, lambda e: e["s"]).alias("scores"))
