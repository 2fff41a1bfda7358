"""A training corpus from raw documents: five stages, each over all that the stage before kept.

``STAGES`` lists (name, function). A function takes ``(spark, docs, sf_dir)`` and returns a frame; all but the last return
the columns of ``documents``. :func:`run` writes each result as Parquet in the shared folder and rereads it for the next.

Every stage keeps the columns as they are, takes empty tables and null texts and ids, and treats repeated rows alike: toxicity
keeps texts without a token, exact dedup counts a null text as empty and lets a null ``doc_id`` lose against any other, near
dedup keeps rows without words or ``doc_id``, decontamination keeps texts without words, and bpe gives null texts no tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import bpe, decontaminate, filters, toxicity
from lattica.llm.queries import vocabulary_path
from lattica.plans.lineage import cut, drop, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below one half; it learns from ``labels``."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest ``doc_id``."""
    return filters.drop_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return filters.drop_near_copies(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.encode_decode(docs, vocabulary_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", encode),
]

#: Trained models and tokenisation are beyond SQL; tests compare run() with brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage has written on its way goes when its result is written
            docs = cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"), keep=True)
        if last is not None:
            drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
