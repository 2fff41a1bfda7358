"""Token alignment, transaction logs and line dedup against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lattica.llm import alignment, line_dedup, queries, txlog

A, B = queries.vocabulary_path("byte_bpe_50k.json"), queries.vocabulary_path("piece_bpe_32k.model")
DOCS = "doc_id long, text string"


# Alignment


def encoded(text):
    """Both tokenizers on the whole text: [(id, start, end)] of A and of B, or nothing if the bytes don't come back."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = encoded.__dict__.setdefault("both", (Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)))
    a.encode_special_tokens = True
    if not text:
        return [], []
    letters = alignment._byte_alphabet()
    sides = [[(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids],
             [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]]
    if any(b"".join(t for _, t in side) != (" " + text).encode() for side in sides):
        return [], []
    out = []
    for side in sides:
        at, spans = 0, []
        for i, t in side:
            spans.append((i, at, at + len(t)))
            at += len(t)
        out.append(spans)
    return out


def brute_alignment(docs):
    both = [encoded(t) for _, t in docs]
    links = [[(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] for a, b in both]
    count = Counter(p for each in links for p in set(each))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for (doc_id, _), (a, b), link in zip(docs, both, links):
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, lo, products = [], 0, 0
        for hi in ends:
            left, right = [x[0] for x in a if lo <= x[1] < hi], [y[0] for y in b if lo <= y[1] < hi]
            groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
            products += len(left) * len(right)
            lo = hi
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc_id, len(a), len(b), len(ends), len(link), products, sum(count[p] == best[p[0]] for p in link), sum(count[p] for p in link), sha))
    return sorted(out, key=repr)


TEXTS = [None, "", " ", "  ", "\n", "a", "it's  two  spaces\n\n and\ttabs ", "<|endoftext|> </s> <s> <0x41> plain", "under▁score", "naïve café 東京 🙂🙂 ́e", "x" * 300, "don't we'LL 'tis 12345 67", "\x00 nul \x1c sep \x85 next   wide　ideographic",
         "line one\r\nline two \r\n", "a b", "word " * 50, "١٢٣ हिन्दी ไทย"]


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_products", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


def test_alignment_equals_brute_force_over_odd_texts(spark):
    rng = random.Random(5)
    alphabet = ["the", " quick", "Über", "'s", " ", "  ", "\n", "\t", "123", "東", "🙂", "▁", "\x85", "\xa0", ".", "…", "é", "́", "<|endoftext|>", "İ"]
    docs = list(enumerate(TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(1, 30))) for _ in range(150)]))
    docs += [(3, "a repeated row"), (3, "a repeated row"), (None, "a b c"), (None, None)]
    frame = spark.createDataFrame(docs, DOCS).withColumns({"chunk": F.lit(1), "n_a": F.lit("x"), "pairs": F.lit(2)}).repartition(3)
    assert found(alignment.align(frame, A, B)) == brute_alignment(docs)


def test_chunks_and_forgotten_segments_change_nothing(spark, monkeypatch):
    docs = [(i, f"document {i % 7} tells of {i} apples, and of {i * 31} pears.") for i in range(60)]
    want = brute_alignment(docs)
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 200)
    monkeypatch.setattr(alignment, "SEGMENTS", 20)
    monkeypatch.setattr(alignment, "blocks", lambda texts, limit=0: ((i, i + 1) for i in range(len(texts))))
    assert found(alignment.align(spark.createDataFrame(docs, DOCS).coalesce(1), A, B)) == want


def test_alignment_of_no_documents(spark):
    empty = spark.createDataFrame([], DOCS)
    assert alignment.align(empty, A, B).collect() == [] and alignment.group_products(empty, A, B).collect() == []


def test_group_products_list_each_pair_of_a_group(spark, monkeypatch):
    docs = list(enumerate(TEXTS)) + [(None, "hello world")]
    for rows in (100_000, 3):
        monkeypatch.setattr(alignment._rounds, "__defaults__", (rows,))
        got = Counter(tuple(r) for r in alignment.group_products(spark.createDataFrame(docs, DOCS), A, B).collect())
        want = Counter()
        for doc_id, text in docs:
            a, b = encoded(text)
            lo = 0
            for g, hi in enumerate(sorted({x[2] for x in a} & {y[2] for y in b})):
                for x in a:
                    for y in b:
                        if lo <= x[1] < hi and lo <= y[1] < hi:
                            want[doc_id, g, x[0], y[0], x[1], x[2], y[1], y[2], x[1] < y[2] and y[1] < x[2]] += 1
                lo = hi
        assert got == want


# Transaction log


def simulated(log, per_epoch=4):
    """One record after the other."""
    rows, store, pending, saved = [], {}, defaultdict(list), defaultdict(list)
    n = epoch = 0

    def state():
        marks = list(store.values())
        rows.append(("state", epoch, len(marks), sum(marks)))

    for seq, source, action, key, mark in sorted(log, key=lambda r: r[0]):
        if action == "change":
            pending[source].append((seq, key, mark))
        elif action == "savepoint":
            saved[source].append(len(pending[source]))
        elif action == "rollback":
            at = saved[source].pop() if saved[source] else 0
            rows.extend(("rollback", s, seq, k) for s, k, _ in pending[source][at:])
            del pending[source][at:]
        else:
            if action == "commit":
                for _, k, m in pending[source]:
                    store.pop(k, None)
                    if m is not None:
                        store[k] = m
            else:
                rows.extend(("abort", s, seq, k) for s, k, _ in pending[source])
            pending[source], saved[source] = [], []
            if action == "commit":
                n += 1
                if n % per_epoch == 0:
                    epoch += 1
                    state()
    if n % per_epoch:
        epoch += 1
        state()
    for each in pending.values():
        rows.extend(("abort", s, None, k) for s, k, _ in each)
    return sorted(rows, key=repr)


LOG = "seq long, source string, action string, key long, mark long"


@pytest.mark.parametrize("n, width, partitions", [(1, 64, "4"), (400, 2, "7"), (3000, 5, "16"), (3000, 64, "3")])
def test_log_equals_a_sequential_replay(spark, n, width, partitions):
    rng = random.Random(n + width)
    actions = ["commit"] * 3 + ["abort", "savepoint", "savepoint", "savepoint", "rollback", "rollback", "rollback"] + ["change"] * 12
    log = [(i * 3 - 500, rng.choice([None, "", "hot", "hot", "hot", "b", "c"]), rng.choice(actions), rng.randrange(9), rng.choice([None, 5, 6, 7])) for i in range(n)]
    if n == 1:
        log = [(7, None, "change", 1, 1)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        frame = spark.createDataFrame(log, LOG).withColumns({"block": F.lit("x"), "txn": F.lit(1), "src": F.lit(2), "level": F.lit(3)}).repartition(5)
        got = sorted((tuple(r) for r in txlog.reassemble(frame, width=width).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == simulated(log)


def test_log_of_odd_records(spark):
    assert txlog.reassemble(spark.createDataFrame([], LOG)).collect() == []
    # Without seq: none. Rows of one seq: the largest (source, mark). A null key is a key. Commits without changes count.
    log = [(None, "a", "commit", 1, 1), (1, "a", "change", None, 4), (1, "a", "change", None, 9), (1, None, "change", None, 99), (2, "a", "commit", None, None), (2, "a", "commit", None, None)]
    got = sorted(tuple(r) for r in txlog.reassemble(spark.createDataFrame(log, LOG)).collect())
    assert got == [("state", 1, 1, 9)]


def test_log_of_documents(spark):
    docs = [(i, None if i % 11 == 0 else f"text {i}", f"s{i % 3}" if i % 4 else None) for i in range(600)] + [(None, "t", "s1")]
    labels = [(i, i % 2) for i in range(0, 600, 5)] + [(None, 1), (5, 1), (5, 0)]
    toxic = {i for i, t in labels if t == 1}
    log = []
    for i, text, source in docs[:-1]:
        h = zlib.crc32(str(i).encode())
        r, key = h % 23, h // 100 % 300
        action = "commit" if r < 2 else "abort" if r == 2 else "savepoint" if r < 5 else "rollback" if r < 7 else "change"
        log.append((i, source, action, key, None if text is None or i in toxic else zlib.crc32(f"{key}:{text}".encode())))
    got = txlog.reassemble(txlog.from_documents(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, toxic int")))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == simulated(log)


def test_prefix_combines_all_earlier_blocks(spark):
    rng = random.Random(2)
    parts = [(rng.randrange(40), rng.choice("ab"), rng.randrange(100)) for _ in range(200)]
    got = txlog.prefix(spark.createDataFrame(parts, "block long, k string, v long"), ["k"], {"v": F.sum("v")})
    want = {(b, k, sum(v for b2, k2, v in parts if k2 == k and b2 < b)) for b, k, _ in parts if any(k2 == k and b2 < b for b2, k2, _ in parts)}
    assert {tuple(r) for r in got.select("block", "k", "v").collect()} == want


# Lines


def without_lines(docs, min_docs, min_chars=1):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))
    where = defaultdict(set)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            where[key(line)].add(doc_id)
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(where[key(x)]) < min_docs]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot, min_docs, min_chars", [(4096, 10, 1), (1, 3, 1), (1, 2, 4)])
def test_lines_equal_brute_force(spark, monkeypatch, hot, min_docs, min_chars):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rng = random.Random(3)
    lines = ["Share", " share\t", "SHARE\r", "", " ", "ÄÖ", "äö", "tail\x0b", "only", "a.b", "né", "\x85x", "\xa0x"] + [f"line {i}" for i in range(40)]
    docs = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 12)))) for i in range(80)]
    docs += [(100, None), (101, ""), (102, "\n"), (103, "\n\n share"), (5, docs[5][1]), (5, "other\nrow\nshare"), (None, "Share\nx"), (None, "x\nshare"), (104, "share\n" * 3000 + "end")]
    frame = spark.createDataFrame(docs, DOCS).withColumns({"n_lines": F.lit("x"), "h1": F.lit(1), "position": F.lit(2), "_gone": F.lit(3), "a.b": F.lit(4)})
    got = line_dedup.drop_lines(frame, min_docs, min_chars)
    assert set(got.columns) == {*frame.columns, "n_dropped"}
    assert sorted((tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr) == without_lines(docs, min_docs, min_chars)


def test_lines_of_no_documents(spark):
    assert line_dedup.drop_lines(spark.createDataFrame([], DOCS)).collect() == []
