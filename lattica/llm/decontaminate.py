"""Benchmark decontamination by latent semantic retrieval.

1. Benchmark items are cut into overlapping passages, which become TF-IDF rows. A word's document frequency counts benchmark
   items, so copies of an item in the corpus can't lower the weight of its words, and documents are read once only.
2. A distributed randomised SVD (range finder with power iterations; each step is a Spark job over the rows and sums dense
   partial products) gives a latent space of ``rank_of`` dimensions, fewer than half the passages: the overlapping passages
   of one item, and the words that occur together in them, share directions.
3. The words of a document are summed in the latent space by cells of ``STEP`` words; runs of cells are its passages, short
   ones beside items of up to ``SCALES[0]`` words and longer ones beside the others. Those whose cosine with a passage of an
   item reaches ``COSINE`` are candidates. The cosine is taken inside the latent space, so what a space of few dimensions
   loses of an item it loses of the item's copies alike.
4. A candidate is confirmed on words: the longest common subsequence of the whole item and a stretch of ``SPREAD`` times the
   item's words. At ``COPY`` of the item it is a copy; from ``PARAPHRASE`` it is a paraphrase if ``ANSWER`` of the item's
   answer (its last sentence, or its last quarter if it has only one) is there too. Stretches begin at every ``STEP`` words,
   or at every eighth of an item where that is more, and are longer by that much.
Items of fewer than ``SHORT`` words are no paraphrase of anything; they are looked up as exact runs of words.

Passages are grouped by at most ``PASSAGES`` (a longer item spans groups), each group with a latent space of its own;
``GROUPS`` groups are searched in one pass over the documents, which bounds what is broadcast; a larger benchmark takes
more passes. Documents are never shuffled.

Defined cases: null, empty or wordless items and documents match nothing; items and documents of any length are searched
whole; equal items each match; of equal shares the larger cosine is reported; repeated rows match alike; a null ``doc_id``
is reported as null; empty tables give empty results; other columns are not read or pass through.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm._text import BY_LETTER, U, Words, blocks, bounded_batches, folded, lean, mix
from lattica.plans.lineage import cut

STEP = 8
#: Words of a document's passages; items of up to the first have one passage, of the first length.
SCALES = (16, 32)
RANK, OVERSAMPLE, POWER_STEPS = 160, 16, 2
PASSAGES, GROUPS = 1024, 4
COSINE = 0.40
COPY, PARAPHRASE, ANSWER = 0.75, 0.50, 0.80
SPREAD = 1.5
SHORT = 8
#: Cells of a document that are projected at a time.
PIECE = 4096
_BITS = 18
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def randomized_svd(spark: SparkSession, rows: list[tuple[np.ndarray, np.ndarray]], features: int, rank: int, seed: int = 11) -> np.ndarray:
    """Right singular vectors (features x rank) of a sparse matrix given by rows of (columns, values).

    Halko, Martinsson and Tropp's range finder: rows are dealt over tasks, each task returns its share of A'AQ.
    """
    width = min(rank + OVERSAMPLE, features, max(1, len(rows)))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((features, width)))[0]
    packed = [(c.astype(np.int32).tobytes(), v.astype(np.float32).tobytes()) for c, v in rows]
    table = spark.createDataFrame(packed, "columns binary, amounts binary").repartition(min(4, max(1, len(rows) // 64)))

    def products(q: np.ndarray, gram: bool) -> np.ndarray:
        shared = spark.sparkContext.broadcast(q)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = shared.value
            total = np.zeros((q.shape[1], q.shape[1]) if gram else q.shape)
            for batch in batches:
                for c, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    c, v = np.frombuffer(c, np.int32), np.frombuffer(v, np.float32)
                    y = v @ q[c]
                    if gram:
                        total += np.outer(y, y)
                    else:
                        np.add.at(total, c, np.outer(v, y))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

        out = sum(np.frombuffer(r["total"], np.float64) for r in table.mapInArrow(lean(part), "total binary").toLocalIterator())
        shared.unpersist()
        return out.reshape(q.shape[1], q.shape[1]) if gram else out.reshape(q.shape)

    for _ in range(POWER_STEPS):
        q = np.linalg.qr(products(q, False))[0]
    values, vectors = np.linalg.eigh(products(q, True))
    return q @ vectors[:, np.argsort(-values)[:rank]]


def rank_of(passages: int) -> int:
    """Dimensions of the latent space of so many passages."""
    return max(1, min(RANK, passages // 2))


def answer_words(text: str) -> int:
    """How many of an item's last words are its answer."""
    whole = np.diff(Words([folded(text)], BY_LETTER).bounds)[0]
    last = np.diff(Words([folded(_SENTENCE.split(text.strip())[-1])], BY_LETTER).bounds)[0]
    return int(last if 0 < last < whole else max(1, whole // 4))


def cuts(words: int, length: int) -> list[int]:
    """Where the passages of ``length`` words of an item begin: at every half length, and the last at the item's end."""
    return [*range(0, max(1, words - length), length // 2), *([words - length] if words > length else [])]


class Item:
    """An item's words for confirmation."""

    __slots__ = ("id", "size", "answer", "mask", "step", "stretch")

    def __init__(self, id: int, hashes: np.ndarray, answer: int):
        self.id, self.size, self.answer = id, len(hashes), answer
        #: Stretches begin at every so many words, and have so many.
        self.step = max(STEP, self.size // 8 // STEP * STEP)
        self.stretch = int(np.ceil(SPREAD * self.size)) + self.step
        self.mask: dict[int, int] = {}
        for i, w in enumerate(hashes.tolist()):
            self.mask[w] = self.mask.get(w, 0) | 1 << i

    def common(self, words: list[int]) -> tuple[float, str]:
        """Share of the item in common with a stretch of words, and what that makes the stretch."""
        share = common_subsequence(self.mask, self.size, words) / self.size
        if share >= COPY or share < PARAPHRASE:
            return share, "copy" if share >= COPY else ""
        first = self.size - self.answer  # the answer counts by itself, wherever a paraphrase has moved it
        answer = {w: m >> first for w, m in self.mask.items() if m >> first}
        return share, "paraphrase" if common_subsequence(answer, self.answer, words) >= ANSWER * self.answer else ""


class Index:
    """One group of passages: vocabulary, latent space, words of its items."""

    def __init__(self, items: list[tuple[int, np.ndarray, int]], parts: list[tuple[int, int]], frequency: dict[int, int], number: int):
        """``items``: (item_id, word hashes, words of the answer); ``parts``: (item, first word) of the passages to search with."""
        self.items = [Item(*x) for x in items]
        self.runs: dict[int, dict[int, list[int]]] = {}
        for i, (_, h, _) in enumerate(items):
            if 0 < len(h) < SHORT:
                self.runs.setdefault(len(h), {}).setdefault(int(_runs(h, len(h))[0]), []).append(i)
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, U), *(items[i][1][o : o + SCALES[1]] for i, o in parts)]))
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.vocabulary & U((1 << _BITS) - 1)).astype(np.int64)] = True
        idf = np.log((1.0 + number) / np.array([frequency[w] for w in self.vocabulary.tolist()])) + 0.1
        self.often = np.zeros((len(items), len(self.vocabulary) + 1), np.uint16)  # a word's places in an item; the last column is for words of no item
        self.rows, self.parts = [], []

        def row(i: int, o: int, length: int) -> tuple[np.ndarray, np.ndarray]:
            at, n = np.unique(np.searchsorted(self.vocabulary, items[i][1][o : o + length]), return_counts=True)
            return at, n * idf[at]

        for i, o in parts:
            self.parts.append((i, o, *row(i, o, SCALES[1])))
            near = items[i][1][o : o + SCALES[1]]
            self.rows += [self.parts[-1][2:], *(row(i, o + c, SCALES[0]) for c in cuts(len(near), SCALES[0]) if len(near) > SCALES[0])]
        for i in {i for i, _ in parts}:
            at = np.searchsorted(self.vocabulary, items[i][1])
            at = at[self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == items[i][1]] if len(items[i][1]) > SCALES[1] else at
            self.often[i] = np.minimum(np.bincount(at, minlength=len(self.vocabulary) + 1), 65535)
        self.idf = idf
        held = np.bincount([i for i, _ in parts], minlength=len(items)) if parts else np.zeros(len(items), int)
        #: Words that a stretch must hold; 0 where this group has only some passages of an item, whose words it doesn't know.
        self.need = np.array([np.ceil(PARAPHRASE * x.size - 1e-9) if k == len(cuts(x.size, SCALES[1])) else 0 for x, k in zip(self.items, held, strict=True)])

    def project(self, spark: SparkSession) -> Index:
        """Fit the latent space of the passages."""
        if self.rows:
            v = randomized_svd(spark, self.rows, len(self.vocabulary), rank_of(len(self.rows)))
            self.place_in(v)
        return self

    def place_in(self, v: np.ndarray) -> None:
        """Take the columns of ``v`` for the latent space."""
        self.weights = np.concatenate([v * self.idf[:, None], np.zeros((1, v.shape[1]))]).astype(np.float32)
        latent = np.stack([x @ v[c] for _, _, c, x in self.parts])
        latent /= np.maximum(np.linalg.norm(latent, axis=1), 1e-9)[:, None]
        item, offset = (np.array([p[j] for p in self.parts], np.int64) for j in (0, 1))
        size = np.array([self.items[i].size for i in item], np.int64)
        self.searches = []
        for length, own in zip(SCALES, (size <= SCALES[0], size > SCALES[0]), strict=True):
            if own.any():
                self.searches.append((length // STEP, length // 2 // STEP, np.ascontiguousarray(latent[own].T, np.float32), item[own], offset[own]))

    def places(self, h: np.ndarray) -> np.ndarray:
        """The place of each word in the vocabulary; the one after the last where it isn't there."""
        out = np.full(len(h), len(self.vocabulary), np.int32)
        at = np.flatnonzero(self.maybe[(h & U((1 << _BITS) - 1)).astype(np.int64)])
        if len(at):
            found = np.minimum(np.searchsorted(self.vocabulary, h[at]), len(self.vocabulary) - 1)
            same = self.vocabulary[found] == h[at]
            out[at[same]] = found[same]
        return out


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` words."""
    out = np.zeros(len(h) - n + 1, U)
    for j in range(n):
        out = mix(out + h[j : len(h) - n + 1 + j] + U(j + 1))
    return out


def common_subsequence(mask: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence with an item (bit-parallel)."""
    full = (1 << size) - 1
    v = full
    for w in words:
        m = mask.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


Match = tuple[int, float, float, str]


def find(indexes: list[Index], texts: list[bytes]) -> list[list[Match]]:
    """For each document of a block: (item_id, cosine, share of the item in common, kind), the best for each item."""
    words = Words(texts, BY_LETTER)
    best: list[dict[int, Match]] = [{} for _ in texts]
    if len(words):
        h = words.hashes()
        for index in indexes:
            for d, match in _search(index, h, words.bounds):
                old = best[d].get(match[0])
                if old is None or (match[2], match[1]) > (old[2], old[1]):
                    best[d][match[0]] = match
    return [[found[i] for i in sorted(found)] for found in best]


def candidates(index: Index, place: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of (document, first word of the passage, end of the passage, item, first word in the item, cosine)."""
    counts = np.diff(bounds)
    first = np.concatenate([[0], np.cumsum(-(-counts // STEP))])
    known = np.flatnonzero(place < len(index.vocabulary))
    owner = np.searchsorted(bounds, known, side="right") - 1
    cell = first[owner] + (known - bounds[owner]) // STEP
    doc_of = np.repeat(np.arange(len(counts)), np.diff(first))
    beyond = max(s[0] for s in index.searches) - 1
    for lo in range(0, int(first[-1]), PIECE):
        hi = min(lo + PIECE, int(first[-1]))
        sums = np.zeros((hi - lo + beyond, index.weights.shape[1]), np.float32)
        a, b = np.searchsorted(cell, [lo, hi + beyond])
        if a == b:
            continue
        own = cell[a:b] - lo
        head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        sums[own[head]] = np.add.reduceat(index.weights[place[known[a:b]]], head, axis=0)
        for cells, stride, latent, item, offset in index.searches:
            start = np.arange(lo, hi)
            doc = doc_of[lo:hi]
            start, doc = (x[(start - first[doc]) % stride == 0] for x in (start, doc))
            total = sums[start - lo]
            for j in range(1, cells):
                inside = start + j < first[doc + 1]
                total[inside] += sums[start[inside] + j - lo]
            norm = np.sqrt(np.einsum("ij,ij->i", total, total))
            some = np.flatnonzero(norm > 1e-6)
            for at in range(0, len(some), 1024):
                rows = some[at : at + 1024]
                cosine = total[rows] @ latent
                w, k = np.nonzero(cosine >= COSINE * norm[rows][:, None])
                if len(w):
                    d, begin = doc[rows[w]], bounds[doc[rows[w]]] + (start[rows[w]] - first[doc[rows[w]]]) * STEP
                    yield d, begin, np.minimum(begin + cells * STEP, bounds[d + 1]), item[k], offset[k], cosine[w, k] / norm[rows[w]]


def _search(index: Index, h: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, Match]]:
    for size, wanted in index.runs.items():
        if len(h) >= size:
            runs = _runs(h, size)
            for p in np.flatnonzero(np.isin(runs, np.array(list(wanted), U))):
                d = int(np.searchsorted(bounds, p, side="right")) - 1
                if p + size <= bounds[d + 1]:
                    yield from ((d, (index.items[i].id, 1.0, 1.0, "short")) for i in wanted[int(runs[p])])
    if not index.parts:
        return
    place = index.places(h)
    size = np.array([x.size for x in index.items], np.int64)
    stretch, step = (np.array([getattr(x, f) for x in index.items], np.int64) for f in ("stretch", "step"))
    before = _before(place)
    done: set[tuple[int, int, int]] = set()  # stretches that were compared: (document, item, first word)
    whole: set[tuple[int, int]] = set()
    for d, begin, end, item, offset, cosine in candidates(index, place, bounds):
        # where the stretch may begin: an item of one passage lies around the document's passage, a longer one beside its own part
        n = size[item]
        slack = n // 4 + STEP
        low = np.where(n <= SCALES[1], begin - n, begin - offset - slack)
        high = np.where(n <= SCALES[1], end, begin - offset + slack)
        low = np.maximum(bounds[d], low)
        low = low - (low - bounds[d]) % step[item]
        high = np.maximum(low + 1, np.minimum(high, bounds[d + 1]))
        top = np.minimum(bounds[d + 1], high - 1 + stretch[item])
        good = _enough(index, place, before, item, low, top, stretch[item])
        for c in good[np.argsort(-cosine[good], kind="stable")].tolist():
            doc, i = int(d[c]), int(item[c])
            own = index.items[i]
            if (doc, i) in whole:
                continue
            starts = [s for s in range(int(low[c]), int(high[c]), own.step) if (doc, i, s) not in done]
            done.update((doc, i, s) for s in starts)
            if not starts:
                continue
            words = h[starts[0] : min(int(bounds[doc + 1]), starts[-1] + own.stretch)].tolist()
            if common_subsequence(own.mask, own.size, words) < PARAPHRASE * own.size:
                continue
            for s in starts:
                share, kind = own.common(words[s - starts[0] : s - starts[0] + own.stretch])
                if kind:
                    yield doc, (own.id, float(cosine[c]), share, kind)
                    if share == 1.0:
                        whole.add((doc, i))
                        break


def _before(place: np.ndarray) -> np.ndarray:
    """Where the word at each place occurs the last time before; -1 where it doesn't."""
    out = np.full(len(place), -1, np.int64)
    order = np.argsort(place, kind="stable")
    same = np.flatnonzero(place[order[1:]] == place[order[:-1]])
    out[order[same + 1]] = order[same]
    return out


def _regions(low: np.ndarray, top: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates by blocks of about 2**18 words: which, all words of their regions, the lengths and where each begins."""
    edges = np.concatenate([[0], np.cumsum(top - low)])
    lo = 0
    while lo < len(low):
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + (1 << 18), side="right")) - 1)
        length, begin = (top - low)[lo:hi], edges[lo:hi] - edges[lo]
        yield np.arange(lo, hi), np.arange(edges[hi] - edges[lo]) - np.repeat(begin - low[lo:hi], length), length, begin
        lo = hi


def _enough(index: Index, place: np.ndarray, before: np.ndarray, item: np.ndarray, low: np.ndarray, top: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    """Which candidates have so many words of their item, in whatever order, as a confirmation implies: in the whole region
    with each different word counted as often as the item has it, and in some stretch."""
    often, width = index.often.ravel(), index.often.shape[1]
    good = []
    for own, at, length, begin in _regions(low, top):
        held = often.take(np.repeat(item[own] * width, length) + place.take(at))
        held[before.take(at) >= np.repeat(low[own], length)] = 0
        good.append(own[np.add.reduceat(held, begin, dtype=np.int32) >= index.need[item[own]]])
    some = np.concatenate(good) if good else np.zeros(0, np.int64)
    good = []
    for own, at, length, begin in _regions(low[some], top[some]):
        own = some[own]
        held = often.take(np.repeat(item[own] * width, length) + place.take(at)) > 0
        total = np.concatenate([[0], np.cumsum(held, dtype=np.int32)])
        span = np.minimum(np.repeat(begin + length, length), np.arange(len(at)) + np.repeat(stretch[own], length))
        good.append(own[np.maximum.reduceat(total[span] - total[:-1], begin) >= index.need[item[own]]])
    return np.concatenate(good) if good else np.zeros(0, np.int64)


def build_indexes(docs: DataFrame, benchmark: DataFrame) -> Iterator[list[Index]]:
    """For each pass over the documents, its groups of passages. A pass holds at most ``GROUPS * PASSAGES`` of them."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND length(trim(text)) > 0").orderBy("item_id", "text")
    frequency: dict[int, int] = {}
    number = 0
    for row in items.toLocalIterator():
        number += 1
        for w in set(Words([folded(row["text"])], BY_LETTER).hashes().tolist()):
            frequency[w] = frequency.get(w, 0) + 1
    pending: list[Index] = []
    own: list[tuple[int, np.ndarray, int]] = []
    parts: list[tuple[int, int]] = []

    def close() -> None:
        if own:
            pending.append(Index(own.copy(), parts.copy(), frequency, number).project(spark))
        own.clear()
        parts.clear()

    for row in items.toLocalIterator():
        h = Words([folded(row["text"])], BY_LETTER).hashes()
        if not len(h):
            continue
        new = [None] if len(h) < SHORT else cuts(len(h), SCALES[1])
        fresh = True
        for o in new:
            if len(parts) == PASSAGES or len(own) == PASSAGES and fresh:
                close()
                fresh = True
                if len(pending) == GROUPS:
                    yield pending
                    pending = []
            if fresh:
                own.append((row["item_id"], h, answer_words(row["text"])))
                fresh = False
            if o is not None:
                parts.append((len(own) - 1, o))
    close()
    if pending:
        yield pending


MATCH_SCHEMA = "doc_id long, item_id long, cosine double, common double, kind string"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, cosine, common, kind`` for every benchmark item found in a document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for indexes in build_indexes(docs, benchmark):
        shared = spark.sparkContext.broadcast(cloudpickle.dumps(indexes))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            indexes = pickle.loads(shared.value)
            for batch in batches:
                texts, ids = [folded(t) for t in batch.column(1).to_pylist()], batch.column(0).to_pylist()
                for lo, hi in blocks(texts):
                    rows = [(ids[lo + d], *m) for d, found in enumerate(find(indexes, texts[lo:hi])) for m in found]
                    if rows:
                        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "cosine", "common", "kind"])

        part = source.mapInArrow(lean(run), MATCH_SCHEMA)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], MATCH_SCHEMA)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with all their columns; no shuffle.

    Between passes the rows are written, so that a task holds the indexes of one pass only and a later pass reads what is left.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    at = docs.columns.index("text")
    out = docs
    for number, indexes in enumerate(build_indexes(docs, benchmark)):
        if number:
            out = cut(out, "clean")
        shared = spark.sparkContext.broadcast(cloudpickle.dumps(indexes))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            indexes = pickle.loads(shared.value)
            for batch in batches:
                texts = [folded(t) for t in batch.column(at).to_pylist()]
                for lo, hi in blocks(texts):
                    yield batch.slice(lo, hi - lo).filter(pa.array([not found for found in find(indexes, texts[lo:hi])]))

        out = out.mapInArrow(lean(run), docs.schema)
    return out
