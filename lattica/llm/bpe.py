"""Byte-pair encoding and decoding by a pair occurrence index.

The vocabulary file (a public tokenizer in JSON; its path is a parameter, its content is broadcast, about 2 MB) fixes the
rules: NFC, lower case, words by a pattern that drops white space, bytes as printable characters, an end-of-word mark.

Within a partition, the distinct words that haven't been seen yet are laid out in lists of symbols (of about ``INDEX_BYTES``, or
one longer word) with links to the neighbours. For each list an index maps each pair (by its rank) to all positions where it occurs in any word; a heap holds the ranks that
are active. The least rank is taken out, all its positions are merged from left to right, and the pairs to the left and
right of each merge move to the lists of their new ranks; nothing else is looked at again. A merge can only give rise to
pairs of higher rank (checked when the vocabulary loads), so the ranks come in ascending order for every word at once, and a
word of any length takes time in proportion to its merges.

Results are kept per piece for the length of a task, in two dictionaries of bounded size of which the one that is older goes
when the other is full, so frequent pieces are encoded once.

Defined cases: null text is empty text, with 0 tokens and the hashes of empty strings; the strings of special tokens in a
text become those tokens; texts of any length are encoded whole; repeated rows are encoded alike; other columns aren't read.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm._text import blocks, bounded_batches, lean

CACHE_PIECES = 200_000
BLOCK_BYTES = 512 << 10
#: Symbols that share a pair index: more are no faster, as the index then outgrows a processor's cache.
INDEX_BYTES = 32 << 10
NO_RANK = (1 << 31) - 1
END = "</w>"
#: str.split() takes these for white space; the pattern doesn't.
_SEPARATORS = frozenset("\x1c\x1d\x1e\x1f")
#: One of these after letters is a piece of its own.
_MARKS = frozenset(".,;:!?")
#: The pattern of a piece for text in ASCII, in lower case and without white space.
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_SPACE = regex.compile(r"\p{White_Space}+")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Ids, merges and special tokens of a vocabulary file's content."""

    def __init__(self, content: str):
        data = json.loads(content)
        self.ids: dict[str, int] = dict(data["model"]["vocab"])
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        made: dict[int, int] = {}
        codes, results = [], []
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, new = self.ids[left], self.ids[right], self.ids[left + right]
            if made.get(a, -1) >= rank or made.get(b, -1) >= rank or new in made:
                raise ValueError("a merge could give rise to a pair of lower rank; an ascending sweep would be wrong")
            made[new] = rank
            codes.append(a << 32 | b)
            results.append(new)
        order = np.argsort(np.array(codes, np.int64))
        self.codes, self.code_ranks, self.results = np.array(codes, np.int64)[order], order.astype(np.int64), results
        # ranks by what stands to the right, or to the left, of a symbol
        self.right_of: dict[int, dict[int, int]] = {}
        self.left_of: dict[int, dict[int, int]] = {}
        for r, c in enumerate(codes):
            left, right = c >> 32, c & 0xFFFFFFFF
            self.right_of.setdefault(left, {})[right] = r
            self.left_of.setdefault(right, {})[left] = r
        shown = byte_characters()
        self.byte = np.array([self.ids.get(c, -1) for c in shown], np.int64)
        self.last = np.array([self.ids.get(c + END, -1) for c in shown], np.int64)
        top = max(self.tokens) + 1
        self.id_text, self.token_text = [str(i) for i in range(top)], [self.tokens.get(i, "") for i in range(top)]
        # with a line feed behind the tokens that end a word; no token holds one, as bytes are printable characters
        ends = ["\n" * t.endswith(END) for t in self.token_text]
        self.id_line, self.token_line = ([t + e for t, e in zip(texts, ends, strict=True)] for texts in (self.id_text, self.token_text))
        del self.ids, self.tokens
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

        self.content, self.library = content, None
        self.pieces, self.unassigned = pieces_pattern(), unassigned_pattern()

    def library_pieces(self, text: str) -> list[str]:
        """The pieces of a text by the tokenizers library; for characters newer than Python's tables."""
        if self.library is None:
            from tokenizers import Regex, Tokenizer, pre_tokenizers

            rule = json.loads(self.content)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            self.library = Tokenizer.from_str(self.content).normalizer, pre_tokenizers.Split(Regex(rule), "removed", invert=True)
        normalizer, split = self.library
        return [piece for piece, _ in split.pre_tokenize_str(normalizer.normalize_str(text))]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, ``NO_RANK`` where they don't merge."""
        code = left << 32 | right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.code_ranks[at], NO_RANK)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        flat, bounds = self.sweep(words)
        return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def sweep(self, words: list[str]) -> tuple[list[int], list[int]]:
        """The ids of all words in one list, and where each word begins. An index covers words of about ``INDEX_BYTES``."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        ids: list[int] = []
        bounds = [0]
        for lo, hi in blocks(raw, INDEX_BYTES):
            flat, own = self._indexed(raw[lo:hi])
            bounds += [len(ids) + b for b in own[1:]]
            ids += flat
        return ids, bounds

    def _indexed(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """The same for words that share one pair index."""
        raw = words
        sizes = np.array([len(r) for r in raw], np.int64)
        if not sizes.sum():
            return [], [0] * (len(words) + 1)
        buf = np.frombuffer(b"".join(raw), np.uint8)
        word = np.repeat(np.arange(len(words)), sizes)
        symbol = self.byte[buf]
        ends = np.cumsum(sizes)[sizes > 0] - 1
        symbol[ends] = self.last[buf[ends]]
        known = symbol >= 0
        symbol, word = symbol[known], word[known]
        n = len(symbol)
        edge = np.flatnonzero(np.concatenate([word[1:] != word[:-1], [True]]))
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[edge] = -1
        before[edge[:-1] + 1] = -1
        rank = np.full(n, NO_RANK, np.int64)
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self.rank(symbol[inner], symbol[inner + 1])
        active = np.flatnonzero(rank < NO_RANK)
        order = active[np.argsort(rank[active], kind="stable")]
        ranks, first = np.unique(rank[order], return_index=True)
        positions, first = order.tolist(), [*first.tolist(), len(order)]
        index: list[list[int] | None] = [None] * len(self.results)
        ranks = ranks.tolist()
        for r, a, b in zip(ranks, first[:-1], first[1:], strict=True):
            index[r] = positions[a:b]
        symbols = [*symbol.tolist(), -1]  # what -1 points to
        self._merge(symbols, [*rank.tolist(), NO_RANK], [*after.tolist(), -1], [*before.tolist(), -1], index, ranks)
        symbol = np.array(symbols[:-1], np.int64)
        alive = symbol >= 0
        bounds = np.concatenate([[0], np.cumsum(np.bincount(word[alive], minlength=len(words)))]).tolist()
        return symbol[alive].tolist(), bounds

    def _merge(self, symbol: list[int], rank: list[int], after: list[int], before: list[int], index: list[list[int] | None], heap: list[int]) -> None:
        """Apply all merges in ascending rank. ``index``: positions by rank; ``heap``: the ranks that have some, ascending."""
        none: dict[int, int] = {}
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            r = pop(heap)
            places, new, index[r] = index[r], self.results[r], None
            places.sort()
            right, left = self.right_of.get(new, none).get, self.left_of.get(new, none).get
            for p in places:
                if rank[p] != r:  # its pair is gone
                    continue
                q = after[p]
                symbol[p], symbol[q], rank[q] = new, -1, NO_RANK
                far = after[p] = after[q]
                before[far] = p
                k = right(symbol[far])
                if k is None:
                    rank[p] = NO_RANK
                else:
                    rank[p] = k
                    if (own := index[k]) is None:
                        index[k] = [p]
                        push(heap, k)
                    else:
                        own.append(p)
                near = before[p]
                k = left(symbol[near])
                if k is None:
                    rank[near] = NO_RANK
                else:
                    rank[near] = k
                    if (own := index[k]) is None:
                        index[k] = [near]
                        push(heap, k)
                    else:
                        own.append(near)

    @staticmethod
    def lines(line: list[str], text: list[str], flat: list[int], bounds: list[int]) -> list[str]:
        """The texts of each word's ids, joined by one space: one join over all words, split where they end."""
        out = " ".join(map(line.__getitem__, flat)).removesuffix("\n").split("\n ") if flat else []
        if len(out) != len(bounds) - 1:  # a vocabulary without some byte, where a word may have no end or nothing at all
            out = [" ".join([text[i] for i in flat[a:b]]) for a, b in zip(bounds, bounds[1:], strict=False)]
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, as the file names no decoder."""
        return " ".join([self.token_text[i] for i in ids])


def chunks(text: str) -> list[str]:
    """The normalised text between white space."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # no final sigma rule: each character is lowered by itself
            text = text.replace("Σ", "σ")
    text = text.lower()
    return text.split() if _SEPARATORS.isdisjoint(text) else [c for c in _SPACE.split(text) if c]


class Encoder:
    """Keeps, per chunk of text, its ids and its tokens as joined strings.

    A chunk is what stands between white space; a line feed before it marks a special token, a space a piece that is whole.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.ids, self.shown, self.pattern = vocabulary, {}, {}, vocabulary.pieces
        self.older: tuple[dict[str, str], dict[str, str]] = {}, {}  # pieces that weren't used lately
        self.unassigned, self.plain = vocabulary.unassigned, set()

    def chunks(self, text: str) -> list[str]:
        if not text.isascii() and (new := set(text) - self.plain):
            if self.unassigned.search("".join(new)):
                return [" " + piece for piece in self.vocabulary.library_pieces(text)]
            self.plain |= new
        return chunks(text)

    def words(self, chunk: str) -> list[str]:
        if chunk[0] == " ":
            return [chunk[1:]]
        if chunk[-1] in _MARKS and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return (_ASCII_PIECES if chunk.isascii() else self.pattern).findall(chunk)

    def learn(self, pieces: set[str]) -> None:
        v = self.vocabulary
        whole = [c for c in pieces if c.isalpha()]
        split = [(c, self.words(c)) for c in pieces.difference(whole)]
        place = dict(zip(whole, range(len(whole)), strict=True))
        for _, ws in split:
            for w in ws:
                place.setdefault(w, len(place))
        flat, bounds = v.sweep(list(place))
        ids, shown = v.lines(v.id_line, v.id_text, flat, bounds), v.lines(v.token_line, v.token_text, flat, bounds)
        self.ids.update(zip(whole, ids, strict=False))
        self.shown.update(zip(whole, shown, strict=False))
        for c, ws in split:
            at = [place[w] for w in ws]
            self.ids[c] = " ".join([x for k in at if (x := ids[k])])
            self.shown[c] = " ".join([x for k in at if (x := shown[k])])

    def texts(self, texts: list[str]) -> list[tuple[str, str]]:
        """Ids and tokens of each text, both joined by one space."""
        v = self.vocabulary
        parts: list[list[str]] = []
        for text in texts:
            if any(special in text for special in v.special):
                own, at = [], 0
                for m in v.special_pattern.finditer(text):
                    own += [*self.chunks(text[at : m.start()]), "\n" + m[0]]
                    at = m.end()
                parts.append(own + self.chunks(text[at:]))
            else:
                parts.append(self.chunks(text))
        wanted = set().union(*parts) if parts else set()
        if len(self.ids) + len(wanted) > CACHE_PIECES // 2:
            self.older, self.ids, self.shown = (self.ids, self.shown), {}, {}
        missing = wanted.difference(self.ids)
        for own, older in zip((self.ids, self.shown), self.older, strict=True):
            own.update({c: older[c] for c in missing if c in older})
        missing.difference_update(self.older[0])
        marks = {c for c in missing if c[0] == "\n"}
        self.learn(missing - marks)
        for c in marks:
            self.ids[c], self.shown[c] = str(v.special[c[1:]]), c[1:]
        ids, shown = self.ids.__getitem__, self.shown.__getitem__
        if all(map(ids, wanted)):
            return [(" ".join(map(ids, p)), " ".join(map(shown, p))) for p in parts]
        return [(" ".join(filter(None, map(ids, p))), " ".join(filter(None, map(shown, p)))) for p in parts]


def _vocabulary(content: str) -> Vocabulary:
    """One vocabulary per worker process; encoders, which keep pieces, live for one task."""
    kept = sys.__dict__.setdefault("_lattica_bpe", {})
    key = hash(content)
    if key not in kept:
        kept[key] = Vocabulary(content)
    return kept[key]


@functools.cache
def _categories() -> bytes:
    """The first letter of every code point's category in Python's Unicode tables; U for unassigned."""
    return "".join(map(unicodedata.category, map(chr, range(sys.maxunicode + 1)))).replace("Cn", "Ux").encode()[::2]


def character_class(category: str) -> str:
    """All code points whose category starts with a letter, as ranges for a pattern."""
    return "".join(f"\\U{m.start():08X}-\\U{m.end() - 1:08X}" for m in re.finditer(b"%s+" % category.encode(), _categories()))


def unassigned_pattern() -> regex.Pattern:
    """Code points that Python's tables don't know; texts with one get their pieces from the library's own tables."""
    return regex.compile(f"[{character_class('U')}]")


def pieces_pattern() -> regex.Pattern:
    """The pattern of a piece, with letters and numbers as in Python's Unicode tables."""
    letters, numbers = character_class("L"), character_class("N")
    return regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\p{{White_Space}}{letters}{numbers}]+")


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_decode(docs: DataFrame, vocabulary_path: str, keep_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, and with ``keep_ids`` also ``ids`` and ``decoded``.

    No shuffle. The vocabulary is read on the driver and broadcast; its size is fixed by the file.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_vocabulary(shared.value))
        gc.disable()  # no cycles here, only many strings, which a collection would walk through again and again
        try:
            for batch in batches:
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for lo, hi in blocks(texts, BLOCK_BYTES):
                    done = encoder.texts(texts[lo:hi])
                    columns = [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array([i.count(" ") + 1 if i else 0 for i, _ in done], pa.int64()),
                        pa.array([hashlib.sha256(i.encode()).hexdigest() for i, _ in done]),
                        pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in done]),
                    ]
                    if keep_ids:
                        columns += [pa.array([[int(x) for x in i.split()] for i, _ in done], pa.list_(pa.int32())), pa.array([d for _, d in done], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])
        finally:
            gc.enable()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), schema)
