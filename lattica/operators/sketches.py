"""Sketches by time slice: small states of each slice that merge for any range of slices.

A sketch is a table of slice and counters; each kind merges by one associative aggregate, so slices are made with partial sums in the tasks and a
range costs its slices only, however many rows they stand for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slices(df: DataFrame, ts: str, width: str) -> DataFrame:
    """``df`` with ``slice``, the start of the time slice."""
    return df.withColumn("slice", F.window(F.col(ts).cast("timestamp"), width)["start"])


def tug_of_war(df: DataFrame, item: str, counters: int = 64, groups: int = 8) -> DataFrame:
    """slice, counters (array): for each of ``groups`` times ``counters`` signs, the sum of the sign of every row's item. Nulls don't count.

    Rows are counted by item first, so each item is hashed once in a slice.
    """
    counts = df.where(F.col(item).isNotNull()).groupBy("slice", item).agg(F.count(F.lit(1)).alias("n"))
    signs = F.transform(F.sequence(F.lit(0), F.lit(counters * groups - 1)), lambda i: F.when(F.pmod(F.xxhash64(F.col(item), i), F.lit(2)) == 0, F.col("n")).otherwise(-F.col("n")))
    signed = counts.select("slice", F.posexplode(signs).alias("i", "x"))
    return signed.groupBy("slice", "i").agg(F.sum("x").alias("x"))


def second_moment(sketch: DataFrame, ranges: DataFrame, groups: int = 8) -> DataFrame:
    """range, f2 for ``ranges`` (range, lo, hi: slices from lo and before hi): the median over groups of mean squares.

    With c counters in a group the estimate is within 4 / sqrt(c) of the moment, except with a chance under exp(-groups / 8) for each range.
    """
    merged = sketch.join(F.broadcast(ranges), (F.col("slice") >= F.col("lo")) & (F.col("slice") < F.col("hi"))).groupBy("range", "i").agg(F.sum("x").alias("x"))
    means = merged.groupBy("range", (F.col("i") % groups).alias("g")).agg(F.avg(F.col("x") * F.col("x")).alias("m"))
    return means.groupBy("range").agg(F.percentile("m", F.lit(0.5)).alias("f2"))


def minhash(df: DataFrame, by: str, item: str, hashes: int = 256) -> DataFrame:
    """slice, ``by``, i, h: minima of ``hashes`` salted hashes; ranges merge by the least."""
    items = df.where(F.col(item).isNotNull()).select("slice", by, item).distinct()
    return items.select("slice", by, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.xxhash64(F.col(item), i))).alias("i", "h")).groupBy("slice", by, "i").agg(F.min("h").alias("h"))


def resemblance(sketch: DataFrame, by: str, lo: Column | None = None, hi: Column | None = None) -> DataFrame:
    """a, b, jaccard of all pairs of the few groups ``by`` over slices from ``lo`` and before ``hi``: the share of equal minima.

    Its standard error is at most 0.5 / sqrt(hashes).
    """
    kept = sketch if lo is None else sketch.where((F.col("slice") >= lo) & (F.col("slice") < hi))
    merged = kept.groupBy(by, "i").agg(F.min("h").alias("h"))
    a, b = merged.select(F.col(by).alias("a"), "i", F.col("h").alias("x")), merged.select(F.col(by).alias("b"), "i", F.col("h").alias("y"))
    return a.join(b, "i").where("a < b").groupBy("a", "b").agg(F.avg((F.col("x") == F.col("y")).cast("double")).alias("jaccard"))
