"""Exact deduplication against a minimal perfect hash over historical distinct digests.

The index is a table with one row per shard of the digest space. A shard holds a minimal perfect hash (levels of bit
arrays: a key stays on the first level where no other key shares its bit, and its slot is the rank of that bit), and per
slot the full 32-byte digest, the winner's locator and the number of historical rows. A lookup computes the slot and then
compares all 32 bytes, so a digest outside the index is never taken for a member.

Defined cases: null text counts as empty text; equal texts share one group whatever their other columns hold; repeated
rows with one ``doc_id`` and text count as rows of the group and share its outcome; rows with a null ``doc_id`` never win
over rows that have one (a group of null ids only has a null ``keep_id`` and keeps all its rows); an empty table gives an
empty result; columns of the input beyond ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm._text import U, bounded_batches, mix
from lattica.plans.lineage import cut

#: Shards are as many as give about so many digests each, and never more than MAX_SHARDS.
SHARD_DIGESTS = 1024
MAX_SHARDS = 1 << 16
GAMMA, MAX_LEVELS = 1.5, 48


class PerfectHash:
    """Minimal perfect hash of n distinct 32-byte digests: a bijection of them to 0..n-1."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rank = np.cumsum(bits, dtype=np.int64) - 1

    @staticmethod
    def _keys(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = np.ascontiguousarray(digests).view(U)
        return words[:, 1] ^ words[:, 3], words[:, 2] | U(1)

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        a, b = cls._keys(digests)
        alive, sizes, bits = np.arange(len(digests)), [], []
        for level in range(MAX_LEVELS):
            if not len(alive):
                break
            m = max(64, int(GAMMA * len(alive)))
            at = (mix(a[alive] + U(level) * b[alive]) % U(m)).astype(np.int64)
            taken = np.bincount(at, minlength=m)
            sizes.append(m)
            bits.append(taken == 1)
            alive = alive[taken[at] > 1]
        return cls(np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, bool), np.ascontiguousarray(digests[alive]))

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest; of a nonmember any slot, or -1."""
        out = np.full(len(digests), -1, np.int64)
        a, b = self._keys(digests)
        alive = np.arange(len(digests))
        for level, m in enumerate(self.sizes):
            if not len(alive):
                return out
            at = (mix(a[alive] + U(level) * b[alive]) % U(m)).astype(np.int64) + self.offsets[level]
            hit = self.bits[at]
            out[alive[hit]] = self.rank[at[hit]]
            alive = alive[~hit]
        if len(self.rest) and len(alive):  # keys that no level could part
            where = {bytes(d): int(self.bits.sum()) + i for i, d in enumerate(self.rest)}
            out[alive] = [where.get(bytes(d), -1) for d in digests[alive]]
        return out


def digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, digest)`` of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("digest"))


def _sharded(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


INDEX_SCHEMA = "shard int, level_sizes binary, level_bits binary, rest binary, digests binary, winners binary, counts binary"


def _build_shard(table: pa.Table) -> pa.Table:
    keys = _matrix(table["digest"])
    found = PerfectHash.build(keys)
    slot = found.slots(keys)
    order = np.empty(len(keys), np.int64)
    order[slot] = np.arange(len(keys))
    winners = table["winner"].fill_null(-(1 << 63)).to_numpy()[order]
    counts = table["n"].to_numpy()[order]
    row = [table["shard"][0].as_py(), found.sizes.tobytes(), np.packbits(found.bits).tobytes(), found.rest.tobytes(), keys[order].tobytes(), winners.astype(np.int64).tobytes(), counts.astype(np.int64).tobytes()]
    kinds = [pa.int32()] + [pa.binary()] * 6
    return pa.table({f: pa.array([v], k) for f, v, k in zip(["shard", "level_sizes", "level_bits", "rest", "digests", "winners", "counts"], row, kinds, strict=True)})


def build_index(history: DataFrame, n_shards: int) -> DataFrame:
    """The index over the distinct digests of ``history`` (``doc_id, digest``), one row per shard.

    Equal digests are combined before the shuffle, so a hot digest costs one row per task.
    """
    distinct = history.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("n"))
    return _sharded(distinct, n_shards).groupBy("shard").applyInArrow(_build_shard, INDEX_SCHEMA)


LOOKUP_SCHEMA = "doc_id long, digest binary, winner long, n long, member boolean"


def _probe(docs: pa.Table, index: pa.Table) -> pa.Table:
    keys = _matrix(docs["digest"])
    winner, n, member = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    if index.num_rows and len(keys):
        row = {k: v[0] for k, v in index.to_pydict().items()}
        sizes = np.frombuffer(row["level_sizes"], np.int64)
        bits = np.unpackbits(np.frombuffer(row["level_bits"], np.uint8), count=int(sizes.sum())).astype(bool)
        slot = PerfectHash(sizes, bits, np.frombuffer(row["rest"], np.uint8).reshape(-1, 32)).slots(keys)
        held = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        at = np.maximum(slot, 0)
        member = (slot >= 0) & (held[at] == keys).all(axis=1)  # the byte check
        winner = np.where(member, np.frombuffer(row["winners"], np.int64)[at], 0)
        n = np.where(member, np.frombuffer(row["counts"], np.int64)[at], 0)
    return pa.table({"doc_id": docs["doc_id"], "digest": docs["digest"].cast(pa.binary()), "winner": pa.array(winner, mask=~member | (winner == -(1 << 63))), "n": pa.array(n), "member": pa.array(member)})


def lookup(docs: DataFrame, index: DataFrame, n_shards: int, rows: int) -> DataFrame:
    """Probe every ``(doc_id, digest)`` row against the index.

    A shard with more rows than twice the mean is dealt over several groups by a hash of ``doc_id`` and its index row is
    repeated for each. The list of such shards has at most ``MAX_SHARDS`` rows, which is why it may be broadcast.
    """
    probes = _sharded(docs, n_shards)
    target = max(2 * SHARD_DIGESTS, 2 * rows // n_shards)
    load = probes.groupBy("shard").agg(F.count(F.lit(1)).alias("load")).select("shard", F.ceil(F.col("load") / target).cast("int").alias("parts")).where("parts > 1")
    load = cut(load.coalesce(1), "hot-shards")
    dealt = probes.join(F.broadcast(load), "shard", "left").withColumn("part", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copies = index.join(F.broadcast(load), "shard", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(_probe, LOOKUP_SCHEMA)


def exact_dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256, in_history``.

    Without ``history`` the index covers the documents themselves and the row with the largest ``doc_id`` of each text
    stays. With ``history`` (``doc_id, text`` too) a document whose text is there is a repeat of the historical winner
    and goes; the others group among themselves by digest. ``group_size`` counts the rows on the side that decided.
    """
    bounded_batches(docs.sparkSession)
    own = cut(digests(docs), "digests")
    past = own if history is None else cut(digests(history), "digests")
    rows = max(own.count(), past.count())
    n_shards = min(MAX_SHARDS, max(1, -(-rows // SHARD_DIGESTS)))
    index = cut(build_index(past, n_shards), "mph")
    found = lookup(own, index, n_shards, rows)
    if history is None:
        out = found.select("doc_id", F.col("winner").alias("keep_id"), F.col("n").alias("group_size"), F.coalesce(F.col("doc_id") == F.col("winner"), F.col("winner").isNull()).alias("kept"), "digest", F.lit(False).alias("in_history"))
    else:
        found = cut(found, "looked-up")
        repeats = found.where("member").select("doc_id", F.col("winner").alias("keep_id"), F.col("n").alias("group_size"), F.lit(False).alias("kept"), "digest", F.lit(True).alias("in_history"))
        new = found.where("NOT member").select("doc_id", "digest")
        groups = new.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        fresh = new.join(groups, "digest").select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "digest", F.lit(False).alias("in_history"))
        out = repeats.unionByName(fresh)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"), "in_history")
