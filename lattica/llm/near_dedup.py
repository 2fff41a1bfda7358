"""Near-duplicate components by HyperMinHash.

A document's set is its distinct five-word shingles (words: ASCII letters lower-cased, split at ASCII white space). One
64-bit hash per shingle picks one of ``REGISTERS`` buckets; a bucket keeps its smallest hash, stored as its number of
leading zeros and the ``MANTISSA`` bits after them (two bytes). Buckets that stay empty are filled by rehashing the set
for ``ROUNDS`` rounds and then by a hash per bucket, so small sets have full sketches whose registers agree with the
Jaccard probability.

1. Equal sets collapse to one representative. Everything below is about representatives.
2. Registers are banded. In each bucket of a band every member is paired with the bucket's smallest id only, so a large
   group gives as many pairs as it has members.
3. Pairs pass the collision-corrected estimate (kept wide by five standard deviations) and are then confirmed on full sets.
4. Components of the confirmed links. Buckets whose members are in one component are done. In the rest, members of
   different components are compared too, so that no link is lost behind a leader it doesn't reach: small buckets by
   pairs; large ones in blocks that hold registers and sets, where a task compares two blocks and emits only the links
   that join components. A pair is compared in the first band that it shares and nowhere else.

Defined cases: null and white-space-only texts have an empty set, no links, and are their own component; fewer than five
words are one shingle; rows that share a ``doc_id`` are one document (linked through any of them); a null ``doc_id``
links with nothing and is kept; texts of any length are read whole and ties between equal minima make equal registers; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm._text import BY_SPACE, U, Words, as_bytes, blocks, bounded_batches, lean, mix
from lattica.operators.components import connected_components
from lattica.plans.lineage import cut

WORDS_PER_SHINGLE = 5
THRESHOLD = (75, 100)
BAND_ROWS, BANDS = 5, 64
REGISTERS = BAND_ROWS * BANDS
MANTISSA, ROUNDS = 10, 8
#: Buckets of up to so many members are compared by pairs; the members of larger ones by blocks of about BLOCK.
SMALL_BUCKET, BLOCK = 32, 1024
#: Up to so many ids (8 bytes each) may be broadcast to pick documents; more go through a shuffled join.
BROADCAST_IDS = 500_000
_STEPS = mix(np.arange(101, 101 + WORDS_PER_SHINGLE, dtype=U)) | U(1)
_BUCKET_SEEDS = mix(np.arange(1001, 1001 + REGISTERS, dtype=U))
_BAND_SEEDS = mix(np.arange(5001, 5001 + BANDS, dtype=U))
_ROUND_SEEDS = mix(np.arange(3001, 3001 + ROUNDS, dtype=U))
#: A register of two different minima is equal by chance with about this probability (leading zeros alike, then mantissa).
COLLISION = 1 / 3 / (1 << MANTISSA)


def shingle_sets(docs: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each document of a block."""
    words = Words([d.lower() for d in docs], BY_SPACE)
    h, bounds = words.hashes(), words.bounds
    n = len(h)
    if n >= WORDS_PER_SHINGLE:
        full = np.zeros(n - WORDS_PER_SHINGLE + 1, U)
        for j, step in enumerate(_STEPS):
            full += h[j : n - WORDS_PER_SHINGLE + 1 + j] * step
        full = mix(full)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= WORDS_PER_SHINGLE:
            out.append(np.unique(full[lo : hi - WORDS_PER_SHINGLE + 1]))
        elif hi > lo:
            out.append(mix(np.array([(h[lo:hi] * _STEPS[: hi - lo]).sum(dtype=U) + U(hi - lo)], U)))
        else:
            out.append(np.zeros(0, U))
    return out


def _compress(least: np.ndarray) -> np.ndarray:
    """Leading zeros (6 bits) and the mantissa bits after the leading one, as uint16. ``least`` has 52 useful bits."""
    _, exponent = np.frexp(least.astype(np.float64))
    zeros = np.clip(53 - exponent, 0, 63).astype(np.int64)
    shift = np.maximum(exponent.astype(np.int64) - 1 - MANTISSA, 0)
    mantissa = (least >> shift.astype(U)).astype(np.int64) & ((1 << MANTISSA) - 1)
    return ((zeros << MANTISSA) | mantissa).astype(np.uint16)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """``len(sets) x REGISTERS`` registers; the rows of empty sets mean nothing."""
    docs = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if docs else np.zeros(0, U)
    owner = np.repeat(np.arange(docs), sizes)
    none = U((1 << 64) - 1)
    least = np.full(docs * REGISTERS, none, U)
    for r in range(ROUNDS):
        h = mix(flat + _ROUND_SEEDS[r])
        cell = owner * REGISTERS + ((h >> U(44)) * U(REGISTERS) >> U(20)).astype(np.int64)
        value = mix(h) >> U(12)
        free = least[cell] == none if r else slice(None)
        cell, value = cell[free], value[free]
        if len(cell):
            order = np.lexsort((value, cell))
            cell, value = cell[order], value[order]
            first = np.concatenate([[True], cell[1:] != cell[:-1]])
            least[cell[first]] = value[first]
        if r + 1 < ROUNDS:
            open_docs = (least.reshape(docs, REGISTERS) == none).any(axis=1)
            keep = open_docs[owner]
            flat, owner = flat[keep], owner[keep]
    table = least.reshape(docs, REGISTERS)
    for d in np.flatnonzero((table == none).any(axis=1) & (sizes > 0)):
        gaps = np.flatnonzero(table[d] == none)
        for part in np.array_split(gaps, max(1, len(gaps) * len(sets[d]) // 200_000)):
            table[d, part] = (mix((sets[d][None, :] ^ _BUCKET_SEEDS[part][:, None]).ravel()) >> U(12)).reshape(len(part), -1).min(axis=1)
    return _compress(table.ravel()).reshape(docs, REGISTERS)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimate from two blocks of registers, without what agrees by chance."""
    share = (a == b).mean(axis=1)
    return np.clip((share - COLLISION) / (1 - COLLISION), 0, 1)


#: Below this estimate a pair isn't confirmed: the threshold less five standard deviations.
LEAST_ESTIMATE = THRESHOLD[0] / THRESHOLD[1] - 5 * math.sqrt(0.75 * 0.25 / REGISTERS)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test on two sets: intersection / union >= 0.75 in whole numbers."""
    if not len(a) or not len(b):
        return False
    low, high = sorted((len(a), len(b)))
    if THRESHOLD[1] * low < THRESHOLD[0] * high:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return THRESHOLD[1] * both >= THRESHOLD[0] * (len(a) + len(b) - both)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ids = as_bytes(batch.column(1)), batch.column(0)
        for lo, hi in blocks(texts):
            sets = shingle_sets(texts[lo:hi])
            registers = sketches(sets)
            sizes = np.array([len(s) for s in sets], np.int64)
            digest, kept = [], []
            for s, r in zip(sets, registers, strict=True):
                if len(s):
                    k = np.arange(1, len(s) + 1, dtype=U)
                    digest.append(np.array([mix(s + k).sum(dtype=U), mix(s ^ U(0xA24BAED4963EE407)).sum(dtype=U) + U(len(s))], U).tobytes())
                    kept.append(r.tobytes())
                else:
                    digest.append(None)
                    kept.append(None)
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(sizes), pa.array(digest, pa.binary()), pa.array(kept, pa.binary())], names=["doc_id", "n_shingles", "digest", "registers"])


def signatures(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, digest of the set, registers)`` of every row; no shuffle."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(lean(_signatures), "doc_id long, n_shingles long, digest binary, registers binary")


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, 2048):
            batch = whole.slice(lo, 2048)
            registers = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, BAND_ROWS)
            key = np.broadcast_to(_BAND_SEEDS, registers.shape[:2]).copy()
            for j in range(BAND_ROWS):
                key = mix(key + registers[:, :, j].astype(U))
            ids = np.repeat(batch.column(0).to_numpy(), BANDS)
            band = np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(band), pa.array(ids)], names=["bucket", "band", "id"])


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
            good = pa.array(estimate(a, b) >= LEAST_ESTIMATE)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ids = as_bytes(batch.column(1)), batch.column(0)
        for lo, hi in blocks(texts):
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array([s.tobytes() for s in shingle_sets(texts[lo:hi])], pa.binary())], names=["id", "shingles"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [linked(np.frombuffer(a, U), np.frombuffer(b, U)) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        if any(good):
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])


def _beside(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """``a, b`` with the value of each; two equi-joins on ids, which adaptive execution splits at a hot id."""
    left = table.select(F.col("id").alias("a"), F.col(value).alias("va"))
    right = table.select(F.col("id").alias("b"), F.col(value).alias("vb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "va", "vb")


def _sets_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """``(id, shingles)`` of the documents with these ids, from their whole texts."""
    ids = cut(ids.distinct(), "ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
    return cut(texts.mapInArrow(lean(_sets), "id long, shingles binary"), "sets")


def _links(pairs: DataFrame, registers: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    near = cut(_beside(pairs, registers, "registers").mapInArrow(lean(_estimated), "a long, b long"), "near-pairs")
    sets = _sets_of(near.select(F.explode(F.array("a", "b")).alias("doc_id")), docs)
    return cut(_beside(near, sets, "shingles").mapInArrow(lean(_confirmed), "a long, b long").distinct(), "links")


def _settle(table: pa.Table) -> pa.Table:
    """Links that join components between two blocks of one bucket (or inside one block)."""
    low, high, band = (table[c][0].as_py() for c in ("low", "high", "band"))
    ids, component, side = (table[c].to_numpy() for c in ("id", "component", "side"))
    registers = np.frombuffer(b"".join(table["registers"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
    sets = [np.frombuffer(x, U) for x in table["shingles"].to_pylist()]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out: list[tuple[int, int]] = []
    for i in np.flatnonzero(side == low):
        others = np.flatnonzero((side == high) & (component != component[i]) if low != high else (np.arange(len(ids)) > i) & (component != component[i]))
        if len(others):
            same = registers[others] == registers[i]
            first = same.reshape(len(others), BANDS, BAND_ROWS).all(axis=2).argmax(axis=1)
            good = (first == band) & ((same.mean(axis=1) - COLLISION) / (1 - COLLISION) >= LEAST_ESTIMATE)
            for k in others[good]:
                a, b = find(int(component[i])), find(int(component[k]))
                if a != b and linked(sets[i], sets[k]):
                    root[max(a, b)] = min(a, b)
                    out.append((int(min(ids[i], ids[k])), int(max(ids[i], ids[k]))))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _across_blocks(rest: DataFrame, registers: DataFrame, docs: DataFrame) -> DataFrame:
    """Links across components inside the large buckets of ``rest`` (``bucket, band, id, component, m``)."""
    members = cut(rest, "large-buckets")
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = members.withColumn("parts", parts).withColumn("side", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("bucket", "band", "id", "component", "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))
    sets = _sets_of(members.select(F.col("id").alias("doc_id")), docs)
    held = dealt.join(sets.join(registers, "id"), "id")
    return cut(held.groupBy("bucket", "low", "high").applyInArrow(_settle, "a long, b long"), "block-links")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``."""
    bounded_batches(docs.sparkSession)
    signed = cut(signatures(docs), "signatures")
    classes = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    classes = cut(classes, "classes")
    # rows of one doc_id with different words are one document, so it links their classes
    named = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "digest")
    several = named.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    reps = cut(named.join(several, "doc_id", "left_semi").join(classes, "digest").select("doc_id", "rep").distinct(), "classes-of-ids")
    same = reps.join(reps.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("a <> rep").select("a", F.col("rep").alias("b")).distinct()
    first = classes.select(F.col("rep").alias("doc_id"), "digest")
    registers = signed.join(first, ["doc_id", "digest"], "left_semi").select(F.col("doc_id").alias("id"), "registers")
    registers = cut(registers, "registers")
    buckets = registers.select("id", "registers").mapInArrow(lean(_band_rows), "bucket long, band int, id long")
    shared = buckets.groupBy("bucket").agg(F.min("id").alias("leader"), F.max("id").alias("other"), F.count(F.lit(1)).alias("m")).where("leader <> other").select("bucket", "leader", "m")
    shared = cut(shared, "shared-buckets")  # from files, so that a small one is broadcast and a hot bucket of a large one is split
    members = cut(buckets.join(shared, "bucket"), "buckets")
    stars = members.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    stars = cut(stars, "stars-by-leader")
    links = _links(stars, registers, docs).unionByName(same)
    joined = cut(connected_components(links, "a", "b"), "components")
    # what a leader doesn't reach: members of one bucket that are still in different components
    placed = members.where("m > 2").join(joined, "id", "left").select("bucket", "band", "id", "m", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    mixed = cut(mixed, "mixed")
    rest = cut(placed.join(mixed, "bucket", "left_semi"), "mixed-buckets")
    small = rest.where(F.col("m") <= SMALL_BUCKET)
    a = small.select("bucket", F.col("id").alias("a"), F.col("component").alias("ca"))
    b = small.select("bucket", F.col("id").alias("b"), F.col("component").alias("cb"))
    across = a.join(b, "bucket").where("a < b AND ca <> cb").select("a", "b").distinct().join(stars, ["a", "b"], "left_anti")
    more = _links(across, registers, docs).union(_across_blocks(rest.where(F.col("m") > SMALL_BUCKET), registers, docs))
    component = cut(connected_components(links.union(more), "a", "b"), "components")
    by_set = classes.join(component, classes["rep"] == component["id"], "left").select("digest", F.coalesce("component", "rep").alias("found"))
    out = signed.select("doc_id", "n_shingles", "digest").join(by_set, "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
