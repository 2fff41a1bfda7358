"""Bounded training samples and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Texts of a training sample, in bytes together; the row that crosses it is the last.
MAX_BYTES = 64 << 20


def fold(n: int) -> Column:
    """``crc32(doc_id as text) mod n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def sample(rows: DataFrame, n: int, by: str | None = None, seed: int = 7) -> DataFrame:
    """At most ``n`` different rows (of each value of ``by``), those with the least hash of ``doc_id``: a bounded sample that
    doesn't hang on file order. Without ``by`` tasks cut their rows to ``n`` before the shuffle; with it, values that have more are
    first cut to about ``2 n`` rows by a threshold on the hash, so that no value's rows meet in one task."""
    order = [F.xxhash64("doc_id", F.lit(seed)), *map(F.col, rows.columns)]
    if by is None:
        return rows.distinct().orderBy(*order).limit(n)
    hashed = rows.distinct().withColumn("__u", F.pmod(order[0], F.lit(1 << 40)) / float(1 << 40))
    counts = F.broadcast(hashed.groupBy(by).agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n")).limit(10_000).select(F.col(by).alias("__by"), "__n"))
    least = F.coalesce((2.0 * n + 1000) / F.col("__n"), F.lit(1.0))
    rows = hashed.join(counts, F.col(by).eqNullSafe(F.col("__by")), "left").where(F.col("__u") <= least).drop("__u", "__by", "__n")
    return rows.withColumn("__nth", F.dense_rank().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__nth") <= n).drop("__nth").distinct()


def with_texts(docs: DataFrame, picked: DataFrame, rows: int, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The texts of a bounded sample (at most ``rows`` rows of ``doc_id`` and other columns, which may be broadcast).

    A ``doc_id`` with several texts counts with each; at most ``rows`` different rows and about ``max_bytes`` of text are taken,
    in an order by hash. ``row`` is the same for repeated rows of ``docs``, of which training takes one (:func:`first_of`).
    """
    source = docs.select("doc_id", "text")
    text_hash = F.xxhash64("text").alias("__hash")
    keys = source.join(F.broadcast(picked), "doc_id").select("doc_id", *[c for c in picked.columns if c != "doc_id"], text_hash, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("__size"))
    order = [F.xxhash64("doc_id", F.lit(11)), F.col("doc_id"), F.col("__hash")]
    keys = keys.distinct().orderBy(*order).limit(rows)
    before = F.sum("__size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))  # a bounded number of rows
    kept = keys.where(F.col("__hash").isNotNull()).withColumn("__before", F.coalesce(before, F.lit(0))).where(F.col("__before") < max_bytes).drop("__before", "__size")
    found = source.withColumn("__hash", F.xxhash64("text")).join(F.broadcast(kept), ["doc_id", "__hash"])
    return found.select(*[c for c in kept.columns if c != "__hash"], "text", F.xxhash64("doc_id", "__hash").alias("row"))


def first_of(rows: list, seen: set) -> list[int]:
    """Where rows stand that weren't seen before; remembers them."""
    out = []
    for i, row in enumerate(rows):
        if row not in seen:
            seen.add(row)
            out.append(i)
    return out
