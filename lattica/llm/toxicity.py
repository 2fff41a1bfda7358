"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are runs of letters and digits of the lower-cased text. A token's features are hashes of the word and of its
prefixes of 4, 5 and 6 bytes. Document labels become token labels by distant supervision: in a toxic training document,
a token is toxic if the word or a prefix is significantly over-represented in toxic documents (likelihood ratio G2).
The field has two tags; it is trained by gradient ascent on the exact log-likelihood. Forward-backward runs as a blocked
scan over 2x2 transfer matrices, with documents cut apart by rank-one matrices, so a whole block of texts of any length
is one vectorised pass. A document's score is a logistic function of the expected number of toxic tokens and the largest
marginal; tokens with a marginal of at least one half form the offending spans (code point offsets in the text).

Training reads a bounded sample of labelled rows (``max_toxic`` and ``max_clean`` rows, ``max_bytes`` of text); scoring covers
every whole text. Toxic features are counted over the whole sample; the field is trained on ``max_chains`` of its documents, in an
order by hash, and on every further toxic one that holds a toxic feature which those don't, so none stays without a weight.

Defined cases: repeated rows are learned once; a document that is labelled both ways counts as toxic; texts of any length are
scored whole; null and empty texts and texts without a token get the score of no evidence, which is below one half;
without any toxic training row, everything scores 0; a null ``doc_id`` counts as held out; label rows with nulls, or
without a document, are ignored; repeated rows are scored alike; other columns pass through untouched or are not read.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm._sample import MAX_BYTES, first_of, fold, sample, with_texts
from lattica.llm._text import BY_LETTER, U, Words, blocks, bounded_batches, folded, lean, mix

BUCKETS = 1 << 18
PREFIXES = (4, 5, 6)
N_FEATURES = 1 + len(PREFIXES)
_SEEDS = mix(np.arange(701, 701 + N_FEATURES, dtype=U))
_COPY_SEEDS = mix(np.arange(801, 807, dtype=U))
#: What marks a feature as toxic: significance, and odds against clean documents.
LEAST_G2, LEAST_ODDS = 20.0, 50.0
#: Where a sample is too small for any feature to reach both: the so many most significant of those in no clean document.
FALLBACK = 32
#: A training document that agrees in so many of six min-hashes with another is its copy.
COPY_MARKS = 5
SPAN = 0.5


def features(words: Words) -> np.ndarray:
    """``N_FEATURES x tokens`` bucket numbers."""
    hashes = [words.hashes()] + [words.prefixes(n) for n in PREFIXES]
    return np.stack([(mix(h ^ s) & U(BUCKETS - 1)).astype(np.int32) for h, s in zip(hashes, _SEEDS, strict=True)])


def _times(a: tuple, b: tuple) -> tuple:
    c = (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3])
    total = c[0] + c[1] + c[2] + c[3]
    return tuple(x / total for x in c)


def _scan(p: np.ndarray, block: int = 64) -> np.ndarray:
    """Row vectors ``v_t = v_(t-1) P_t`` (normalised, v before the first is uniform) for ``4 x n`` matrices."""
    n = p.shape[1]
    if n <= 2 * block:
        out, v0, v1 = np.empty((2, n)), 0.5, 0.5
        for t in range(n):
            v0, v1 = v0 * p[0, t] + v1 * p[2, t], v0 * p[1, t] + v1 * p[3, t]
            v0, v1 = v0 / (v0 + v1), v1 / (v0 + v1)
            out[0, t], out[1, t] = v0, v1
        return out
    rows = -(-n // block)
    padded = np.empty((4, rows * block))
    padded[:, :n] = p
    padded[:, n:] = np.array([[1.0], [0.0], [0.0], [1.0]])
    steps = np.ascontiguousarray(padded.reshape(4, rows, block).transpose(0, 2, 1))
    product = tuple(steps[:, 0])
    for t in range(1, block):
        product = _times(product, tuple(steps[:, t]))
    ends = _scan(np.stack(product), block)
    v0, v1 = np.concatenate([[0.5], ends[0, :-1]]), np.concatenate([[0.5], ends[1, :-1]])
    out = np.empty((2, block, rows))
    for t in range(block):
        v0, v1 = v0 * steps[0, t] + v1 * steps[2, t], v0 * steps[1, t] + v1 * steps[3, t]
        total = v0 + v1
        v0, v1 = v0 / total, v1 / total
        out[0, t], out[1, t] = v0, v1
    return out.transpose(0, 2, 1).reshape(2, -1)[:, :n]


def forward_backward(emit: np.ndarray, starts: np.ndarray, transition: np.ndarray, initial: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of tag 1, and (alpha before, matrices, beta) for pair marginals.

    ``emit``: log-potential of tag 1 against tag 0 of each token; ``starts``: true at the first token of a document.
    """
    e = np.exp(np.clip(emit, -25, 25))
    t = np.exp(transition)
    s = np.exp(initial)
    p = np.empty((4, len(e)))
    p[0], p[2] = np.where(starts, s[0], t[0, 0]), np.where(starts, s[0], t[1, 0])
    p[1], p[3] = np.where(starts, s[1], t[0, 1]) * e, np.where(starts, s[1], t[1, 1]) * e
    p /= p.sum(axis=0)
    alpha = _scan(p)
    back = _scan(p[[0, 2, 1, 3]][:, ::-1])[:, ::-1]
    beta = np.concatenate([back[:, 1:], np.full((2, 1), 0.5)], axis=1)
    both = alpha * beta
    before = np.concatenate([np.full((2, 1), 0.5), alpha[:, :-1]], axis=1)
    return both[1] / both.sum(axis=0), before, p, beta


class Model:
    """Weights by bucket, transitions, and the logistic function over a document's evidence."""

    def __init__(self, weights: np.ndarray, transition: np.ndarray, initial: np.ndarray, logistic: np.ndarray, empty: bool):
        self.weights, self.transition, self.initial, self.logistic, self.empty = weights, transition, initial, logistic, empty

    def marginals(self, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if self.empty or not tokens.shape[1]:
            return np.zeros(tokens.shape[1])
        return forward_backward(self.weights[tokens].sum(axis=0, dtype=np.float64), starts, self.transition, self.initial)[0]

    def scores(self, expected: np.ndarray, largest: np.ndarray) -> np.ndarray:
        if self.empty:
            return np.zeros(len(expected))
        z = np.log1p(expected) * self.logistic[0] + largest * self.logistic[1] + self.logistic[2]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _by_doc(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and largest value of each document; 0 where it has no token."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    sums = np.maximum(total[bounds[1:]] - total[bounds[:-1]], 0)
    largest = np.zeros(len(bounds) - 1)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        largest[full] = np.maximum.reduceat(values, bounds[:-1][full])
    return sums, largest


def _without_copies(tokens: list[np.ndarray]) -> list[int]:
    """Documents that don't share five of six min-hashes of word trigrams with one that is kept.

    Copies of one document would otherwise make its ordinary words look like evidence.
    """
    seen: dict[tuple[int, int], list[int]] = {}
    keep = []
    for i, t in enumerate(tokens):
        w = np.concatenate([t[0].astype(U), np.zeros(2, U)])
        h = mix(w[:-2] * U(0x9E3779B97F4A7C15) + w[1:-1] * U(0xC2B2AE3D27D4EB4F) + w[2:])
        if not len(h):
            continue
        marks = {(j, int(mix(h ^ s).min())) for j, s in enumerate(_COPY_SEEDS)}
        shared = Counter(k for mark in marks for k in seen.get(mark, ()))
        if max(shared.values(), default=0) < COPY_MARKS:
            keep.append(i)
            for mark in marks:
                seen.setdefault(mark, []).append(i)
    return keep


def fit(labels: np.ndarray, tokens: list[np.ndarray], steps: int = 30, rate: float = 0.4, l2: float = 1e-4, max_chains: int = 1200) -> Model:
    """Train on documents given as ``N_FEATURES x n`` bucket arrays and 0/1 labels."""
    nothing = Model(np.zeros(1, np.float32), np.zeros((2, 2)), np.zeros(2), np.zeros(3), True)
    chosen = _without_copies(tokens)
    labels, tokens = labels[chosen], [tokens[i] for i in chosen]
    toxic = labels == 1
    if not toxic.any():
        return nothing
    count = np.zeros((2, BUCKETS))
    for y, x in zip(labels, tokens, strict=True):
        count[int(y), np.unique(x)] += 1
    n1, n0 = toxic.sum(), (~toxic).sum()
    k1, k0 = count[1], count[0]
    share = (k1 + k0) / (n1 + n0)

    def part(k: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(expected, 1e-9)), 0)

    g2 = 2 * (part(k1, n1 * share) + part(k0, n0 * share) + part(n1 - k1, n1 * (1 - share)) + part(n0 - k0, n0 * (1 - share)))
    odds = np.log((k1 + 0.5) / (n1 + 1)) - np.log((k0 + 0.5) / (n0 + 1))
    marked = (g2 >= LEAST_G2) & (odds >= np.log(LEAST_ODDS))
    if not marked.any():
        only = np.flatnonzero((k1 > 0) & (k0 == 0))
        if not len(only):
            return nothing
        marked[only[np.argsort(-g2[only], kind="stable")[:FALLBACK]]] = True
    tags = [marked[x].any(axis=0) if y else np.zeros(x.shape[1], bool) for y, x in zip(labels, tokens, strict=True)]
    covered = ~marked
    order = []
    for i in np.flatnonzero(toxic):
        if tokens[i].shape[1] and (len(order) < max_chains // 2 or not covered[tokens[i]].all()):
            order.append(i)
            covered[tokens[i]] = True
    order += [i for i in np.flatnonzero(~toxic)[: max_chains // 2] if tokens[i].shape[1]]
    x = np.concatenate([tokens[i] for i in order], axis=1)
    y = np.concatenate([tags[i] for i in order]).astype(np.float64)
    starts = np.zeros(x.shape[1], bool)
    starts[np.cumsum([0] + [tokens[i].shape[1] for i in order[:-1]])] = True
    used, at = np.unique(x, return_inverse=True)
    at = at.reshape(x.shape)
    theta = np.zeros(len(used) + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    tag = y.astype(int)
    seen = np.zeros(6)
    inside = np.flatnonzero(~starts)
    np.add.at(seen, tag[inside - 1] * 2 + tag[inside], 1)
    np.add.at(seen, 4 + tag[starts], 1)
    for step in range(1, steps + 1):
        w = theta[: len(used)]
        p1, before, p, beta = forward_backward(w[at].sum(axis=0), starts, theta[-6:-2].reshape(2, 2), theta[-2:])
        grad = np.zeros_like(theta)
        grad[: len(used)] = sum(np.bincount(row, y - p1, len(used)) for row in at)
        pairs = np.stack([before[0] * p[0] * beta[0], before[0] * p[1] * beta[1], before[1] * p[2] * beta[0], before[1] * p[3] * beta[1]])
        pairs = (pairs / pairs.sum(axis=0))[:, inside].sum(axis=1)
        expected = np.concatenate([pairs, [(1 - p1[starts]).sum(), p1[starts].sum()]])
        grad[-6:] = seen - expected
        grad -= l2 * len(y) * theta / 100
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = theta[: len(used)]
    model = Model(weights, theta[-6:-2].reshape(2, 2).copy(), theta[-2:].copy(), np.zeros(3), False)
    evidence = []
    for lo in range(0, len(tokens), 256):
        part_tokens = tokens[lo : lo + 256]
        bounds = np.concatenate([[0], np.cumsum([t.shape[1] for t in part_tokens])])
        first = np.zeros(bounds[-1], bool)
        first[bounds[:-1][np.diff(bounds) > 0]] = True
        sums, largest = _by_doc(model.marginals(np.concatenate(part_tokens, axis=1), first), bounds)
        evidence.append(np.stack([np.log1p(sums), largest, np.ones(len(sums))], axis=1))
    z, b = np.concatenate(evidence), np.zeros(3)
    weight = np.where(toxic, 0.5 / n1, 0.5 / max(n0, 1)) * len(labels)
    for _ in range(30):  # Newton steps for the logistic function, with a small ridge
        q = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (weight * (labels - q)) - 0.5 * b
        hessian = (z * (weight * q * (1 - q))[:, None]).T @ z + 0.5 * np.eye(3)
        b = b + np.clip(np.linalg.solve(hessian, g), -4, 4)
    b[2] = min(b[2], -1e-3)
    model.logistic = b
    return model


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [folded(t) for t in batch.column(0).to_pylist()]
        for lo, hi in blocks(texts):
            words = Words(texts[lo:hi], BY_LETTER)
            found = features(words)
            rows = [np.ascontiguousarray(found[:, a:b]).tobytes() for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo).cast(pa.int32()), pa.array(rows, pa.binary()), batch.column(2).slice(lo, hi - lo)], names=["toxic", "tokens", "row"])


def _fit_rows(batches: Iterator[pa.RecordBatch], max_chains: int) -> Iterator[pa.RecordBatch]:
    labels, tokens = [], []
    seen: set[int] = set()
    for batch in batches:
        batch = batch.take(pa.array(first_of(batch.column(2).to_pylist(), seen), pa.int64()))
        labels += batch.column(0).to_pylist()
        tokens += [np.frombuffer(t, np.int32).reshape(N_FEATURES, -1) for t in batch.column(1).to_pylist()]
    order = sorted(range(len(labels)), key=lambda i: (hashlib.blake2b(tokens[i].tobytes()).digest(), labels[i]))  # rows come in any order
    model = fit(np.array([labels[i] for i in order], int), [tokens[i] for i in order], max_chains=max_chains)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(model))], pa.binary())], names=["model"])


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = 3000, max_clean: int = 4000, max_chains: int = 1200, max_bytes: int = MAX_BYTES) -> Model:
    """Train on at most ``max_toxic`` and ``max_clean`` labelled rows outside the held-out fold, in one task."""
    bounded_batches(docs.sparkSession)
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(fold(5) != 0)
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = sample(usable.where("toxic = 1"), max_toxic).union(sample(usable.where("toxic = 0"), max_clean))
    rows = with_texts(docs, picked, max_toxic + max_clean, max_bytes).select("text", "toxic", "row").mapInArrow(lean(_token_rows), "toxic int, tokens binary, row long")
    state = rows.repartition(1).mapInArrow(lean(lambda batches: _fit_rows(batches, max_chains)), "model binary").first()
    return Model(**pickle.loads(state["model"])) if state else fit(np.zeros(0, int), [])


def _evidence(model: Model, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, list]]:
    """For each block: its rows, their scores and their spans."""
    raw = [folded(t) for t in texts]
    for lo, hi in blocks(raw):
        words = Words(raw[lo:hi], BY_LETTER)
        starts = np.zeros(len(words), bool)
        starts[words.bounds[:-1][np.diff(words.bounds) > 0]] = True
        p1 = model.marginals(features(words), starts)
        scores = model.scores(*_by_doc(p1, words.bounds))
        spans: list[list[dict]] = [[] for _ in range(hi - lo)]
        hot = np.flatnonzero(p1 >= SPAN)
        if len(hot):
            chars = np.concatenate([[0], np.cumsum((words.buf & 0xC0) != 0x80)])
            doc = np.searchsorted(words.bounds, hot, side="right") - 1
            base = chars[words.doc_start[doc]]
            for d, a, b, p in zip(doc.tolist(), (chars[words.start[hot]] - base).tolist(), (chars[words.end[hot]] - base).tolist(), p1[hot].tolist(), strict=True):
                spans[d].append({"start": a, "end": b, "prob": p})
        yield lo, hi, scores, spans


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("prob", pa.float64())]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted, spans`` of every row of ``docs``. The model (1 MB) is broadcast."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value)
        for batch in batches:
            for lo, hi, scores, spans in _evidence(model, batch.column(2).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(spans, SPANS)], names=["doc_id", "held_out", "score", "predicted", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(5) == 0).alias("held_out"), "text")
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int,prob:double>>")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns; no shuffle."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value)
        for batch in batches:
            for lo, hi, scores, _ in _evidence(model, batch.column(at).to_pylist()):
                yield batch.slice(lo, hi - lo).filter(pa.array(scores < threshold))

    return docs.mapInArrow(lean(run), docs.schema)
