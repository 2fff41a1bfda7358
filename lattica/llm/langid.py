"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; every run of characters that aren't letters becomes one space. Code point bigrams and trigrams are
hashed into ``BUCKETS``. The log-probability matrix (buckets x languages, float32) is broadcast; a batch is scored by
gathering the rows of its n-grams and summing them by document.

Training reads a bounded sample of rows outside the held-out fold, ``max_rows`` of each language and ``max_bytes`` of text in
all, so that rare languages are learned too; prediction covers every whole text. The prior is the share of a language among
all rows that could have been taken, not in the sample.

Defined cases: repeated rows are learned once; texts of any length are read whole; an empty table gives an empty result; null texts and texts without a letter are ``und`` with score 0; with no training row everything is
``und``; ties go to the language first in sorted order; a null ``doc_id`` counts as empty text for the fold; repeated
rows are predicted alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm._sample import MAX_BYTES, first_of, fold, sample, with_texts
from lattica.llm._text import U, blocks, bounded_batches, lean

BUCKETS = 1 << 16
_NOT_LETTERS = regex.compile(r"\P{L}+")
_LETTER = regex.compile(r"\p{L}")


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all bigrams and trigrams of a block, and the document of each."""
    sizes = np.array([len(t) + 2 for t in texts], np.int64)
    x = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    two = x[:-1] * U(0x9E3779B97F4A7C15) + x[1:] * U(0xC2B2AE3D27D4EB4F)
    three = two[:-1] + x[2:] * U(0x165667B19E3779F9) + U(0x27D4EB2F165667C5)
    inside2, inside3 = doc[:-1] == doc[1:], doc[:-2] == doc[2:]
    two, three = two[inside2], three[inside3]
    out = np.concatenate([two, three])
    out ^= out >> U(29)
    out *= U(0xBF58476D1CE4E5B9)
    return (out >> U(48)).astype(np.int32), np.concatenate([doc[:-1][inside2], doc[:-2][inside3]])


def _clean(text: str | None) -> str:
    return _NOT_LETTERS.sub(" ", text.lower()) if text else ""


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    seen: set[int] = set()
    for batch in batches:
        batch = batch.take(pa.array(first_of(batch.column(2).to_pylist(), seen), pa.int64()))
        texts, langs = [_clean(t) for t in batch.column(0).to_pylist()], batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
            for lo, hi in blocks(own):
                counts = np.bincount(_grams(own[lo:hi])[0], minlength=BUCKETS)
                total[lang] = total.get(lang, 0) + counts
    for lang, counts in total.items():
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used.astype(np.int32)), pa.array(counts[used].astype(np.int64))], names=["lang", "bucket", "n"])


class Model:
    """Sorted languages, log-probabilities (buckets x languages) and log-priors."""

    def __init__(self, langs: list[str], table: np.ndarray, prior: np.ndarray):
        self.langs, self.table, self.prior = langs, table, prior


def train(docs: DataFrame, max_rows: int = 4000, max_bytes: int = MAX_BYTES, smoothing: float = 0.5) -> Model:
    """Count n-grams of at most ``max_rows`` rows of each language, outside the held-out fold.

    Counts are summed per task before they are shuffled; the result has at most languages x ``BUCKETS`` rows.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold(4) != 2))
    rows = rows.select("doc_id", F.col("lang").alias("label"))
    held = dict(rows.groupBy("label").count().collect())  # one row a language
    picked = sample(rows, max_rows, "label")
    texts = with_texts(docs, picked, max_rows * max(1, len(held)), max_bytes).select("text", "label", "row").repartition(8, "row")
    counts = texts.mapInArrow(lean(_count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    lang, bucket, n = (counts[c].to_numpy() for c in ("lang", "bucket", "n"))
    langs = sorted(set(lang.tolist()))
    table = np.zeros((BUCKETS, len(langs)))
    table[bucket, np.searchsorted(np.array(langs, dtype=object), lang)] = n
    table += smoothing
    prior = np.log(np.array([held.get(x, 0) + 1.0 for x in langs]) / (sum(held.get(x, 0) for x in langs) + len(langs))) if langs else np.zeros(0)
    return Model(langs, np.log(table / table.sum(axis=0)).astype(np.float32), prior)


def _scores(model: Model, texts: list[str]) -> np.ndarray:
    """Log-likelihoods, ``texts x languages``."""
    bucket, doc = _grams(texts)
    out = np.empty((len(texts), len(model.langs)))
    for k in range(len(model.langs)):
        out[:, k] = np.bincount(doc, model.table[:, k][bucket], len(texts))
    return out + model.prior


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row. ``score`` is the posterior of the chosen language."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, np.asfortranarray(model.table), model.prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            raw = batch.column(2).to_pylist()
            texts = [_clean(t) for t in raw]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            for lo, hi in blocks(texts) if model.langs else ():
                z = _scores(model, texts[lo:hi])
                best = z.argmax(axis=1)
                top = 1 / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)
                for i in range(lo, hi):
                    if _LETTER.search(texts[i]):
                        lang[i], score[i] = model.langs[best[i - lo]], top[i - lo]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(4) == 2).alias("held_out"), "text")
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double")
