"""Alignment of two tokenizers: which tokens of A and B cover the same bytes.

A is a byte-level BPE (tokenizers), B a piece model with byte fallback (sentencepiece); both encode a space and then the text, without
special tokens. The ends of all tokens, as byte offsets, cut a text into elementary intervals (``union1d`` of both arrays); ``searchsorted``
gives the A and the B token that own an interval, so each interval is one overlapping pair, a link. Ends that both share close
groups; :func:`group_products` expands the groups to pairs.

Texts are cut before each single space that stands between two characters other than white space. Neither tokenizer ever joins
anything over such a place (A's pattern begins a new word at that space; no piece of B has a space behind another character, which is
checked when B is loaded), so a different segment is encoded and aligned once and kept, in bounded number, for the
length of a task.

Scoring takes corpus-wide counts. Tasks write chunks of whole documents (``CHUNK_BYTES`` of text, or one longer document) with the chunk's
different pairs and each document's links to them. Only the chunks' pairs are shuffled: summed up to counts, joined back, collected
per chunk, which bounds them, and met with the chunk's documents. No pair has more rows than there are chunks.

A null or empty text, or one that the tokens of A or B don't give back byte by byte, has no tokens: zeros and ''. Every row is a
document of its own, rows with equal or null ``doc_id`` too. An empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm._text import blocks, lean
from lattica.plans.lineage import cut

#: UTF-8 bytes of text (about) whose documents form a chunk.
CHUNK_BYTES = 4 << 20
#: Different segments, and their characters, that a task keeps.
SEGMENTS, SEGMENT_CHARS = 100_000, 16 << 20
_BATCH_CHARS = 1 << 16
_PER_DOC = ("n_a", "n_b", "n_groups", "n_links", "n_products")
_CHUNK = "chunk long, doc_id array<long>, " + ", ".join(f"{c} array<long>" for c in _PER_DOC) + ", groups_sha256 array<string>, pairs array<long>, n_docs array<int>, sizes array<int>, links binary"
_RESULT = "doc_id long, " + ", ".join(f"{c} long" for c in _PER_DOC) + ", n_best long, count_sum long, groups_sha256 string"
_CUT = re.compile(r"(?<=\S)(?= \S)")


def _byte_alphabet() -> dict[str, int]:
    """Byte-level BPE's character for each byte: printable Latin-1 stands for itself, the others follow from U+0100."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or (b >= 0xA1 and b != 0xAD)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class Tokenizers:
    """Both encoders, and each token's bytes by id."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks have one core, and a pool of threads its own memory each
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        alphabet = _byte_alphabet()
        size = self.a.get_vocab_size()
        self.bytes_a = np.array([bytes(map(alphabet.__getitem__, t)) if t and all(c in alphabet for c in t) else (t or "").encode() for t in map(self.a.id_to_token, range(size))] + [None], object)[:-1]
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        self.bytes_b = np.array([bytes([int(p[3:-1], 16)]) if is_byte else p.replace("▁", " ").encode() for p, is_byte in pieces] + [None], object)[:-1]
        if any("▁" in p.lstrip("▁") for p, _ in pieces):
            raise ValueError("a piece of B has a space behind another character, so segments would not be independent")
        self.sizes_a, self.sizes_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        # The names of all tokens as they stand in a list of groups: A's within a group, A's last of one, B's within, B's last.
        names = [b"%d" % i + end for ids, ends in ((self.bytes_a, (b",", b"|")), (self.bytes_b, (b",", b";"))) for end in ends for i in range(len(ids))]
        self.names, self.name_sizes = np.array([*names, None], object)[:-1], np.fromiter(map(len, names), np.int64, len(names))

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of segments that begin with a space, which B adds itself."""
        ids_a: list[list[int]] = []
        for lo, hi in blocks(segments, _BATCH_CHARS):
            ids_a += [e.ids for e in self.a.encode_batch_fast(segments[lo:hi], add_special_tokens=False)]
        return ids_a, self.b.encode([s[1:] for s in segments], num_threads=1)


def segments_of(text: str) -> list[str]:
    """The independent segments of a space and ``text``."""
    return _CUT.split(" " + text)


def _flat(ids: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids)))


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Elementary intervals of two rising arrays of ends that cover the same bytes.

    Returns the intervals' ends, the A and the B token that own each, and which A and which B tokens close a group.
    """
    ends = np.union1d(ends_a, ends_b)
    own_a, own_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    both = (ends_a[own_a] == ends) & (ends_b[own_b] == ends)
    closes_a, closes_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    closes_a[own_a[both]] = closes_b[own_b[both]] = True
    return ends, own_a, own_b, closes_a, closes_b


def _before(n: np.ndarray) -> np.ndarray:
    """Sums of all earlier entries, and of all."""
    return np.concatenate([[0], np.cumsum(n)])


class _Aligned:
    """Segments by number with what their alignment gives; pairs of token ids by number."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers, self.chars = tokenizers, 0
        self.number: dict[str, int] = {}
        self.pair_number: dict[int, int] = {}
        self.pairs = np.zeros(0, np.int64)  # a << 32 | b
        self.counts = {c: np.zeros(0, np.int64) for c in _PER_DOC}
        self.good = np.zeros(0, bool)
        self.groups: list[bytes] = []
        self.link_at, self.link = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def numbers(self, segments: list[str]) -> np.ndarray:
        """The numbers of segments; those not seen before are encoded and aligned together."""
        known = self.number
        if fresh := [s for s in dict.fromkeys(segments) if s not in known]:
            self.chars += sum(map(len, fresh))
            known |= zip(fresh, range(len(known), len(known) + len(fresh)))
            self._add(fresh)
        return np.fromiter(map(known.__getitem__, segments), np.int64, len(segments))

    def full(self) -> bool:
        return len(self.number) > SEGMENTS or self.chars > SEGMENT_CHARS

    def _add(self, segments: list[str]) -> None:
        t = self.tokenizers
        ids = t.encode(segments)
        sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in ids]
        a, b = map(_flat, ids)
        raw = [s.encode("utf-8", "surrogatepass") for s in segments]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        good = np.ones(len(raw), bool)
        for x, n, of, token_bytes in ((a, sizes[0], t.sizes_a, t.bytes_a), (b, sizes[1], t.sizes_b, t.bytes_b)):
            found = np.diff(_before(of[x])[_before(n)])
            if (found != lengths).any() or b"".join(token_bytes[x].tolist()) != b"".join(raw):  # rare: look at each
                at = _before(n).tolist()
                good &= [b"".join(token_bytes[x[lo:hi]].tolist()) == r for lo, hi, r in zip(at[:-1], at[1:], raw)]
        a, b = a[np.repeat(good, sizes[0])], b[np.repeat(good, sizes[1])]
        sizes = [n * good for n in sizes]
        ends_a, ends_b = np.cumsum(t.sizes_a[a]), np.cumsum(t.sizes_b[b])
        _, own_a, own_b, closes_a, closes_b = overlaps(ends_a, ends_b)
        of_a = np.repeat(np.arange(len(segments)), sizes[0])
        tally = lambda which, weights=None: np.bincount(which, weights, len(segments)).astype(np.int64)
        group_a, group_b = _before(closes_a)[:-1], _before(closes_b)[:-1]  # the group of each token
        n_groups = int(closes_a.sum())
        in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        links = tally(of_a[own_a])
        new = {"n_a": sizes[0], "n_b": sizes[1], "n_groups": tally(of_a[closes_a]), "n_links": links, "n_products": tally(of_a[closes_a], in_a * in_b)}
        self.counts = {c: np.concatenate([self.counts[c], new[c]]) for c in _PER_DOC}
        self.good = np.concatenate([self.good, good])
        # Names in the order of groups, A's tokens before B's.
        name = np.empty(len(a) + len(b), np.int64)
        name[np.arange(len(a)) + _before(in_b)[group_a]] = a + closes_a * len(t.bytes_a)
        name[np.arange(len(b)) + _before(in_a)[1:][group_b]] = b + closes_b * len(t.bytes_b) + 2 * len(t.bytes_a)
        text = b"".join(t.names[name].tolist())
        at = _before(t.name_sizes[name])[_before(sizes[0] + sizes[1])].tolist()
        self.groups += [text[lo:hi] for lo, hi in zip(at[:-1], at[1:])]
        pairs, which = np.unique(a[own_a] << 32 | b[own_b], return_inverse=True)
        number = self.pair_number
        added = [p for p in pairs.tolist() if p not in number]
        number |= zip(added, range(len(number), len(number) + len(added)))
        self.pairs = np.concatenate([self.pairs, np.array(added, np.int64)])
        self.link = np.concatenate([self.link, np.fromiter(map(number.__getitem__, pairs.tolist()), np.int64, len(pairs))[which]])
        self.link_at = np.concatenate([self.link_at, self.link_at[-1] + np.cumsum(links)])

    def documents(self, texts: list[str | None]) -> dict[str, object]:
        """Of each document the counts, the hash of its groups, and its different pairs with their number of links."""
        parts = [segments_of(t) if t else [] for t in texts]
        flat = self.numbers([s for p in parts for s in p])
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        doc = np.repeat(np.arange(len(parts)), size)
        bad = np.bincount(doc, ~self.good[flat], len(parts)) > 0
        flat, doc = flat[~bad[doc]], doc[~bad[doc]]
        at = _before(np.where(bad, 0, size))
        out: dict[str, object] = {c: np.diff(_before(self.counts[c][flat])[at]) for c in _PER_DOC}
        digests = []
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
            digests.append(hashlib.sha256(b"".join([self.groups[i] for i in flat[lo:hi].tolist()])[:-1]).hexdigest() if hi > lo else "")
        seg, times = np.unique(doc << 32 | flat, return_counts=True)
        doc, seg = seg >> 32, seg & 0xFFFFFFFF
        n = self.link_at[seg + 1] - self.link_at[seg]
        link = self.link[np.repeat(self.link_at[seg] - _before(n)[:-1], n) + np.arange(n.sum())]
        found, which = np.unique(np.repeat(doc, n) << 32 | link, return_inverse=True)
        out |= {"groups_sha256": digests, "pair": found & 0xFFFFFFFF, "times": np.bincount(which, np.repeat(times, n), len(found)).astype(np.int64), "size": np.bincount(found >> 32, minlength=len(parts))}
        return out


def _packed(*arrays: np.ndarray) -> bytes:
    raw = b"".join(x.astype(np.int32).tobytes() for x in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True), np.int32).astype(np.int64)


def _chunk_row(number: int, ids: list, found: list[dict], pairs: np.ndarray) -> pa.RecordBatch:
    """One chunk; in a document pairs are numbered by their place among the chunk's, and stored as differences."""
    join = lambda c: np.concatenate([f[c] for f in found])
    pair, size = join("pair"), join("size")
    used, place = np.unique(pair, return_inverse=True)
    step = np.diff(place, prepend=0)
    first = _before(size)[:-1][size > 0]
    step[first] = place[first]
    row = {"chunk": number, "doc_id": ids, **{c: join(c) for c in _PER_DOC}, "groups_sha256": [d for f in found for d in f["groups_sha256"]],
           "pairs": pairs[used], "n_docs": np.bincount(place, minlength=len(used)), "sizes": size, "links": _packed(step, join("times"))}
    kinds = {"chunk": pa.int64(), "groups_sha256": pa.list_(pa.string()), "n_docs": pa.list_(pa.int32()), "sizes": pa.list_(pa.int32()), "links": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(c, pa.list_(pa.int64()))) for c, v in row.items()], list(row))


def chunks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Documents encoded and aligned, a row for each chunk; written in the shared folder."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = Tokenizers(path_a, path_b)
        aligned, number = _Aligned(tokenizers), TaskContext.get().partitionId() << 32
        ids: list = []
        found: list[dict] = []
        held = 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            doc_ids = batch.column("doc_id").to_pylist()
            for lo, hi in blocks(texts):
                found.append(aligned.documents(texts[lo:hi]))
                ids += doc_ids[lo:hi]
                held += sum(len(t) for t in texts[lo:hi] if t)
                if held >= CHUNK_BYTES or aligned.full():
                    yield _chunk_row(number, ids, found, aligned.pairs)
                    ids, found, held, number = [], [], 0, number + 1
                    if aligned.full():
                        aligned = _Aligned(tokenizers)
        if ids:
            yield _chunk_row(number, ids, found, aligned.pairs)

    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _CHUNK), "aligned")


def _pairs(chunked: DataFrame) -> DataFrame:
    return chunked.select("chunk", F.posexplode(F.arrays_zip("pairs", "n_docs")).alias("place", "p")).select("chunk", "place", F.col("p.pairs").alias("pair"), F.col("p.n_docs").alias("n_docs"))


def link_counts(chunked: DataFrame) -> DataFrame:
    """pair (A id shifted left by 32 bits, or B id), count: how many documents have it linked; is_best: no pair of its A id has more."""
    counts = _pairs(chunked).groupBy("pair").agg(F.sum("n_docs").alias("count"))
    best = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("most"))
    return counts.join(best, F.shiftright("pair", 32) == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).alias("is_best"))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each document: doc_id, n_a, n_b (tokens), n_groups, n_links, n_products (pairs within groups), n_best, count_sum, groups_sha256."""
    chunked = chunks(docs, path_a, path_b)
    counts = cut(link_counts(chunked), "link-counts")
    scored = _pairs(chunked).join(counts, "pair").groupBy("chunk").agg(F.collect_list(F.struct("place", "count", "is_best")).alias("scores"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                values = lambda c: row.column(c).flatten()
                size = values("sizes").to_numpy().astype(np.int64)
                place, times = np.split(_unpacked(row.column("links")[0].as_py()), 2)
                starts = _before(size)
                place = np.cumsum(place)
                # Differences begin anew in each document, so what was summed up before it comes off.
                some = np.flatnonzero(size)
                begin = starts[some]
                place -= np.repeat(np.concatenate([[0], place[begin[1:] - 1]]) if len(begin) else place[:0], size[some])
                count, best = np.zeros(int(place.max(initial=-1)) + 1, np.int64), np.zeros(int(place.max(initial=-1)) + 1, np.int64)
                scores = values("scores")
                if len(scores):
                    at, n, is_best = (x.to_numpy(zero_copy_only=False) for x in scores.flatten())
                    count[at], best[at] = n, is_best
                total = lambda x: pa.array(np.diff(_before(x * times)[starts]))
                yield pa.RecordBatch.from_arrays([values("doc_id"), *[values(c) for c in _PER_DOC], total(best[place]), total(count[place]), values("groups_sha256")], ["doc_id", *_PER_DOC, "n_best", "count_sum", "groups_sha256"])

    return chunked.drop("pairs", "n_docs").join(scored, "chunk", "left").mapInArrow(finish, _RESULT)


def group_products(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The groups expanded: a row for each A and B token of the same group, with doc_id, group (from 0), a, b, their byte ranges, and
    ``linked`` where these overlap. Texts are encoded whole and a document's rows come in batches of its groups."""
    schema = "doc_id long, group long, a int, b int, a_start long, a_end long, b_start long, b_end long, linked boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tokenizers(path_a, path_b)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                (a,), (b,) = ([np.array(x, np.int64) for x in ids] for ids in t.encode([" " + text])) if text else ((np.zeros(0, np.int64),), (np.zeros(0, np.int64),))
                raw = (" " + (text or "")).encode("utf-8", "surrogatepass")
                if not text or not b"".join(t.bytes_a[a].tolist()) == raw == b"".join(t.bytes_b[b].tolist()):
                    continue
                ends_a, ends_b = np.cumsum(t.sizes_a[a]), np.cumsum(t.sizes_b[b])
                *_, closes_a, closes_b = overlaps(ends_a, ends_b)
                group_a, group_b = _before(closes_a)[:-1], _before(closes_b)[:-1]
                n_b = np.bincount(group_b)
                first_b, n = _before(n_b)[:-1], n_b[group_a]  # a token of A meets all of its group's B tokens
                for lo, hi in _rounds(n):
                    m = n[lo:hi]
                    i = np.repeat(np.arange(lo, hi), m)
                    j = np.repeat(first_b[group_a[lo:hi]] - _before(m)[:-1], m) + np.arange(m.sum())
                    start_a, start_b = ends_a[i] - t.sizes_a[a[i]], ends_b[j] - t.sizes_b[b[j]]
                    linked = (start_a < ends_b[j]) & (start_b < ends_a[i])
                    columns = [np.full(len(i), doc_id or 0), group_a[i], a[i].astype(np.int32), b[j].astype(np.int32), start_a, ends_a[i], start_b, ends_b[j], linked]
                    arrays = [pa.array(x) for x in columns]
                    if doc_id is None:
                        arrays[0] = pa.nulls(len(i), pa.int64())
                    yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _rounds(n: np.ndarray, rows: int = 100_000) -> Iterator[tuple[int, int]]:
    """Runs of entries whose sum is about ``rows``, or of a single larger one."""
    total = _before(n)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + rows, "right")) - 1)
        yield lo, hi
        lo = hi
