"""Vectorised tokens and hashes over Arrow batches of text, shared by the operators of this subpackage.

Every function takes whole texts. Work inside a batch goes by blocks of whole documents, so memory follows the block
(or the longest single document) and not the batch.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

U = np.uint64
_P = 0xD1342543DE82EF95  # odd, so that it has an inverse mod 2**64
_PI = pow(_P, -1, 1 << 64)
BLOCK_BYTES = 512 << 10
SPACES = np.array([0x20, *range(0x09, 0x0E)])


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: a bijection of 64 bits."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
#: Bytes of a word when words end at ASCII white space only.
BY_SPACE = np.ones(256, bool)
BY_SPACE[SPACES] = False
#: Bytes of a word when words are ASCII letters and digits, and all of non-ASCII.
BY_LETTER = np.zeros(256, bool)
BY_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x5F, *range(0x80, 0x100)]] = True

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept between calls while they are of block size."""
    if len(_powers[0]) < n:
        full = [np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, U(b))]), dtype=U) for b in (_P, _PI)]
        if n > 8 * BLOCK_BYTES:
            return full[0], full[1]
        _powers[:] = full
    return _powers[0][:n], _powers[1][:n]


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bound Arrow batches by bytes as well as rows, so that very long texts can't pile up in one batch; a bound of the user's stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, size)


def _trim() -> None:
    """Give freed memory back to the system; Python workers live on between tasks and stages."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, with Arrow on the system's allocator and memory given back after each batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            _trim()

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        gc.collect()  # functions and tables of earlier tasks of this worker, which hang in reference cycles
        _trim()
        yield from run(each(batches))
        _trim()

    return wrapped


def blocks(texts: list, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about ``limit`` bytes together."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if size and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every row; null becomes empty."""
    return [b if b is not None else b"" for b in column.cast(pa.large_binary()).to_pylist()]


def folded(text: str | None) -> bytes:
    """Lower case with the number of code points kept, as UTF-8."""
    if not text:
        return b""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c) == 1 else o for o, c in ((o, o.lower()) for o in text))
    return low.encode("utf-8", "surrogatepass")


class Words:
    """The words of a block of documents: byte ranges, document bounds and 64-bit hashes of any sub-range."""

    def __init__(self, docs: list[bytes], word_bytes: np.ndarray):
        self.buf = np.frombuffer(b" " + b" ".join(docs) + b" ", np.uint8)
        sizes = np.array([len(d) for d in docs], np.int64)
        self.doc_start = 1 + np.concatenate([[0], np.cumsum(sizes + 1)])
        mask = word_bytes[self.buf]
        step = np.flatnonzero(mask[1:] != mask[:-1]) + 1
        self.start, self.end = step[0::2], step[1::2]
        self.bounds = np.searchsorted(self.start, self.doc_start)
        power, self._inverse = _power(len(self.buf))
        self._sum = np.zeros(len(self.buf) + 1, U)
        np.cumsum(BYTE_VALUES[self.buf] * power, out=self._sum[1:])

    def __len__(self) -> int:
        return len(self.start)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the bytes ``[start, end)`` that depends on nothing else."""
        return mix((self._sum[end] - self._sum[start]) * self._inverse[start] + (end - start).astype(U))

    def hashes(self) -> np.ndarray:
        return self.hash(self.start, self.end)

    def prefixes(self, n: int) -> np.ndarray:
        """Hashes of the first ``n`` bytes of each word; of the whole word where it is shorter."""
        return self.hash(self.start, np.minimum(self.start + n, self.end))

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
