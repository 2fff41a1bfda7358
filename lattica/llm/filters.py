"""Stages that take documents away, with all their columns kept as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.exact_dedup import exact_dedup
from lattica.llm.near_dedup import near_dedup
from lattica.plans.lineage import cut

#: Up to so many keys of rows to be dropped are broadcast (about 100 bytes each); more go through a shuffled join.
BROADCAST_KEYS = 200_000
_SHA = "__lattica_text_sha256"


def _small(keys: DataFrame) -> DataFrame:
    keys = cut(keys, "dropped")
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def drop_repeats(docs: DataFrame) -> DataFrame:
    """Without the rows whose text a row with a larger ``doc_id`` repeats. A null ``doc_id`` loses against any other."""
    gone = _small(exact_dedup(docs).where("NOT kept").select(F.col("doc_id").alias("__gone"), F.col("text_sha256").alias("__sha")).distinct())
    marked = docs.withColumn(_SHA, F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    return marked.join(gone, marked["doc_id"].cast("long").eqNullSafe(gone["__gone"]) & (marked[_SHA] == gone["__sha"]), "left_anti").drop(_SHA)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate component: the one with the smallest ``doc_id``. Rows without an id stay."""
    gone = _small(near_dedup(docs).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
