"""Quality by ordinal cumulative-link regression.

P(grade <= k) = logistic(threshold_k - s) with one score ``s`` per text for all grades and ordered thresholds (the first is
free, each later one adds a positive step). ``s`` is the mean weight of the text's hashed words, plus the mean weight of
its hashed token shapes (kinds of the first and last character), plus weights for its share of distinct lines and its
length class. Expected grade and the tail probability P(grade >= g) follow; texts whose tail probability reaches one half
are selected.

Training reads a bounded sample of graded rows (``max_rows`` rows, ``max_bytes`` of text) outside the held-out fold; scoring
covers whole texts.

Defined cases: repeated rows are learned once, a document with several grades with each; an empty table gives an empty result;
texts of any length are read whole; null and empty texts have no words, shapes or lines and get the score of their length class; without
training rows every grade is 0 and nothing is selected; ratings with null parts are ignored; repeated rows are scored
alike; a null ``doc_id`` counts as held out; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm._sample import MAX_BYTES, first_of, fold, sample, with_texts
from lattica.llm._text import BY_LETTER, BY_SPACE, U, Words, blocks, bounded_batches, folded, lean, mix

WORD_BUCKETS = 1 << 16
SHAPES, BINS = 1 << 10, 32
BUCKETS = WORD_BUCKETS + SHAPES + 2 * BINS
#: Kinds of bytes: 0 other, 1 lower case, 2 upper case, 3 digit, 4 beyond ASCII, from 5 the ASCII marks one by one.
KINDS = np.zeros(256, np.int64)
KINDS[ord("a") : ord("z") + 1], KINDS[ord("A") : ord("Z") + 1], KINDS[ord("0") : ord("9") + 1], KINDS[128:] = 1, 2, 3, 4
_MARKS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
KINDS[_MARKS] = 5 + np.arange(len(_MARKS))
_LINE = np.ones(256, bool)
_LINE[10] = False


def _weights_of(texts: list[str | None]) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]], np.ndarray]]:
    """For each block: (buckets, document bounds) of words and of shapes, and the two bins of each document."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    for lo, hi in blocks(raw):
        words = Words([folded(t) for t in texts[lo:hi]], BY_LETTER)
        tokens, lines = Words(raw[lo:hi], BY_SPACE), Words(raw[lo:hi], _LINE)
        word = (mix(words.hashes() ^ U(0x51)) & U(WORD_BUCKETS - 1)).astype(np.int64)
        first, last = KINDS[tokens.buf[tokens.start]], KINDS[tokens.buf[tokens.end - 1]]
        shape = WORD_BUCKETS + (mix((first * 64 + last).astype(U)) & U(SHAPES - 1)).astype(np.int64)
        line = lines.hashes()
        bins = np.empty((hi - lo, 2), np.int64)
        for i in range(hi - lo):
            a, b = lines.bounds[i], lines.bounds[i + 1]
            share = len(np.unique(line[a:b])) / (b - a) if b > a else 1.0
            bins[i] = WORD_BUCKETS + SHAPES + int(share * (BINS - 1)), WORD_BUCKETS + SHAPES + BINS + min(BINS - 1, int(np.log2(1 + words.bounds[i + 1] - words.bounds[i])))
        yield lo, hi, [(word, words.bounds), (shape, tokens.bounds)], bins


def _means(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)


class Model:
    """Shared weights and ordered thresholds; ``len(thresholds) + 1`` grades."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, s: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - s[:, None], -30, 30)))


def fit(grades: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], steps: int = 150, rate: float = 0.3, l2: float = 1e-6) -> Model:
    """Maximum likelihood (Adam) on sparse rows of (buckets, values)."""
    if not len(grades) or grades.max() < 1:
        return Model(np.zeros(BUCKETS), np.full(1, 30.0))
    k = int(grades.max())
    at = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    used, column = np.unique(np.concatenate([i for i, _ in rows]), return_inverse=True)
    value = np.concatenate([v for _, v in rows])
    shares = np.cumsum(np.bincount(grades, minlength=k + 1))[:-1] / len(grades)
    start = np.log(np.clip(shares, 1e-3, 1 - 1e-3) / (1 - np.clip(shares, 1e-3, 1 - 1e-3)))
    theta = np.concatenate([np.zeros(len(used)), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, head = theta[: len(used)], theta[len(used) :]
        cuts = np.concatenate([[-np.inf], head[0] + np.concatenate([[0.0], np.cumsum(np.exp(head[1:]))]), [np.inf]])
        s = np.bincount(at, w[column] * value, len(rows))
        upper, lower = cuts[grades + 1] - s, cuts[grades] - s
        cu, cl = 1 / (1 + np.exp(-np.clip(upper, -40, 40))), 1 / (1 + np.exp(-np.clip(lower, -40, 40)))
        cu, cl = np.where(np.isinf(upper), 1.0, cu), np.where(np.isinf(lower), 0.0, cl)
        p = np.maximum(cu - cl, 1e-9)
        du, dl = cu * (1 - cu) / p, cl * (1 - cl) / p
        grad = np.zeros_like(theta)
        grad[: len(used)] = np.bincount(column, (dl - du)[at] * value, len(used)) / len(rows) - l2 * w
        by_cut = np.array([(du[grades == j].sum() - dl[grades == j + 1].sum()) / len(rows) for j in range(k)])
        grad[len(used)] = by_cut.sum()
        grad[len(used) + 1 :] = np.cumsum(by_cut[::-1])[::-1][1:] * np.exp(head[1:])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[used] = theta[: len(used)]
    head = theta[len(used) :]
    return Model(weights, head[0] + np.concatenate([[0.0], np.cumsum(np.exp(head[1:]))]))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, parts, bins in _weights_of(batch.column(0).to_pylist()):
            buckets, values = [], []
            for i in range(hi - lo):
                own = [np.unique(b[bounds[i] : bounds[i + 1]], return_counts=True) for b, bounds in parts]
                buckets.append(np.concatenate([own[0][0], own[1][0], bins[i]]).astype(np.int32).tobytes())
                values.append(np.concatenate([own[0][1] / max(1, own[0][1].sum()), own[1][1] / max(1, own[1][1].sum()), [1.0, 1.0]]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array(buckets, pa.binary()), pa.array(values, pa.binary()), batch.column(2).slice(lo, hi - lo)], names=["grade", "buckets", "amounts", "row"])


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grades: list[int] = []
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        keys = list(zip(batch.column(3).to_pylist(), batch.column(0).to_pylist(), strict=True))  # a row may have several grades
        batch = batch.take(pa.array(first_of(keys, seen), pa.int64()))
        grades += batch.column(0).to_pylist()
        rows += [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float64)) for i, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
    order = sorted(range(len(grades)), key=lambda i: (grades[i], rows[i][0].tobytes(), rows[i][1].tobytes()))  # rows come in any order
    grades, rows = [grades[i] for i in order], [rows[i] for i in order]
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(fit(np.array(grades, int), rows)))], pa.binary())], names=["model"])


def train(docs: DataFrame, ratings: DataFrame, max_rows: int = 8000, max_bytes: int = MAX_BYTES) -> Model:
    """Train on at most ``max_rows`` rows of ``ratings`` (``doc_id, grade`` from 0) outside the held-out fold."""
    bounded_batches(docs.sparkSession)
    usable = ratings.select("doc_id", F.col("grade").cast("int").alias("grade")).where("doc_id IS NOT NULL AND grade >= 0").where(fold(5) != 0)
    rows = with_texts(docs, sample(usable, max_rows), max_rows, max_bytes).select("text", "grade", "row")
    state = rows.mapInArrow(lean(_feature_rows), "grade int, buckets binary, amounts binary, row long").repartition(1).mapInArrow(lean(_fit_rows), "model binary").first()
    return Model(**pickle.loads(state["model"])) if state else fit(np.zeros(0, int), [])


def score(docs: DataFrame, model: Model, tail_grade: int = 1, least: float = 0.5) -> DataFrame:
    """``doc_id, held_out, expected_grade, tail_probability, selected`` of every row; no shuffle, the model is broadcast."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value)
        for batch in batches:
            for lo, hi, parts, bins in _weights_of(batch.column(2).to_pylist()):
                s = model.weights[bins].sum(axis=1) + sum(_means(model.weights[b], bounds) for b, bounds in parts)
                tails = model.tails(s)
                tail = tails[:, min(tail_grade, tails.shape[1]) - 1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(tail >= least)], names=["doc_id", "held_out", "expected_grade", "tail_probability", "selected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(5) == 0).alias("held_out"), "text")
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, expected_grade double, tail_probability double, selected boolean")
