"""Small fixtures for the operators: brute force, round trips, nulls, empty tables, long texts, ties, clashing columns."""

import hashlib
import itertools
import json
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lattica.llm import bpe, decontaminate, exact_dedup, filters, html_extract, langid, near_dedup, quality, tool_calls, toxicity, warc
from lattica.llm._text import BY_LETTER, BY_SPACE, Words
from lattica.plans.lineage import cut

DOC = "doc_id long, text string, lang string, source string, n_chars long, bucket string, id long"


def docs(spark, texts, ids=None):
    """Documents with two extra columns whose names the operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 7) for i, t in zip(ids, texts, strict=True)], DOC)


def prose(seed, n, words=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


def test_words_and_hashes():
    w = Words([b"ab cd", b"", b"cd"], BY_SPACE)
    h = w.hashes()
    assert w.bounds.tolist() == [0, 2, 2, 3] and h[1] == h[2] and h[0] != h[1]
    assert Words([b"x" * 3_000_000], BY_LETTER).hashes().shape == (1,)


def test_perfect_hash_is_minimal_and_checks_bytes():
    keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(3000)), np.uint8).reshape(-1, 32)
    ph = exact_dedup.PerfectHash.build(keys)
    assert sorted(ph.slots(keys).tolist()) == list(range(3000))
    assert exact_dedup.PerfectHash.build(keys[:0]).slots(keys[:2]).tolist() == [-1, -1]


def test_exact_dedup_against_brute_force(spark):
    texts = ["a", "b", "a", None, "", "c" * 200_000, "a", "B", "b "] * 2
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        group = [k for k, u in enumerate(texts) if (u or "") == (t or "")]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(group), len(group), i == max(group), hashlib.sha256((t or "").encode()).hexdigest())
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0
    assert [r.kept for r in exact_dedup.exact_dedup(docs(spark, ["a", "a"], [None, 4])).orderBy("doc_id").collect()] == [False, True]


def test_exact_dedup_with_history(spark):
    past = docs(spark, ["old", "old", "older"])
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs(spark, ["new", "old", "new"], [10, 11, 12]), past).collect()}
    assert (got[11].keep_id, got[11].kept, got[11].in_history) == (1, False, True)
    assert (got[10].keep_id, got[10].kept, got[12].kept, got[12].group_size) == (12, False, True, 2)


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    return root, [len(s) for s in sets]


def near_texts():
    base = prose(1, 200)
    words = base.split()
    out = [base]
    r = random.Random(5)
    for k in range(70):  # a chain: each copy changes a little more
        words = words.copy()
        words[r.randrange(200)] = f"new{k}"
        out.append(" ".join(words))
    passage = prose(2, 60)
    out += [f"{prose(100 + k, 30)} {passage} {prose(200 + k, 30)}" for k in range(20)]
    return out + ["one two", "ONE two", "one", None, "", " \n\t", "a b c d e", "A b\tc d e", "x y z", base.upper(), "é É", "É É", prose(9, 20_000)]


def test_near_dedup_against_brute_force(spark, monkeypatch):
    texts = near_texts()
    root, sizes = brute_components(texts)
    for small in (32, 2):  # the second puts buckets of three or more through the blocks
        monkeypatch.setattr(near_dedup, "SMALL_BUCKET", small)
        monkeypatch.setattr(near_dedup, "BLOCK", 8)
        got = {r.doc_id: r for r in near_dedup.near_dedup(docs(spark, texts)).collect()}
        assert [got[i].component_id for i in range(len(texts))] == root
        assert [got[i].n_shingles for i in range(len(texts))] == sizes
        assert all(got[i].kept == (got[i].component_id == i) for i in got)


def test_near_dedup_edges(spark):
    assert near_dedup.near_dedup(docs(spark, [])).count() == 0
    rows = near_dedup.near_dedup(docs(spark, ["a b c d e f"] * 3, [None, 4, 4])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (4, 4, True), (4, 4, True)]


def test_sketch_estimates_jaccard():
    a = near_dedup.shingle_sets([prose(3, 3000, 100_000).encode()])[0]
    for share in (0.5, 0.75, 0.9):
        n = int(len(a) * share)
        b = np.sort(np.concatenate([a[:n], np.arange(len(a) - n, dtype=np.uint64)]))
        r = near_dedup.sketches([a, b])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(near_dedup.estimate(r[:1], r[1:])[0] - true) < 0.15


def test_filters_keep_columns(spark):
    d = docs(spark, ["t one two three four five", "t one two three four five", "other"], [1, 2, None])
    exact = filters.drop_repeats(d)
    assert exact.columns == d.columns and {r.doc_id for r in exact.collect()} == {2, None}
    near = filters.drop_near_copies(d)
    assert near.columns == d.columns and {r.doc_id for r in near.collect()} == {1, None}


def test_forward_backward_against_enumeration():
    r = np.random.default_rng(0)
    emit, trans, init = r.normal(size=7), r.normal(size=(2, 2)), r.normal(size=2)
    starts = np.array([1, 0, 0, 1, 0, 0, 0], bool)
    p, *_ = toxicity.forward_backward(emit, starts, trans, init)
    total, mass = 0.0, np.zeros(7)
    for tags in itertools.product((0, 1), repeat=7):
        s = sum(emit[t] * tags[t] + (init[tags[t]] if starts[t] else trans[tags[t - 1], tags[t]]) for t in range(7))
        total += np.exp(s)
        mass += np.exp(s) * np.array(tags)
    assert np.allclose(p, mass / total)


def test_scan_blocks_agree_with_steps():
    p = np.random.default_rng(1).random((4, 1000))
    assert np.allclose(toxicity._scan(p, 8), toxicity._scan(p, 1000))


def toxic_rows(n):
    return [f"{prose(i, 40)} {'idiot' if i % 4 == 0 else 'friend'} {prose(1000 + i, 40)}" for i in range(n)]


def test_toxicity_learns_held_out_and_spans(spark):
    texts = [*toxic_rows(200), None, "", "???", "İdiot idiot", prose(7, 20_000)]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)] + [(None, 1, 1), (3, None, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(d, labels)
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(200))
    assert [texts[0][s.start : s.end] for s in got[0].spans] == ["idiot"]
    assert got[203].predicted == 1 and texts[203][got[203].spans[-1].start : got[203].spans[-1].end] == "idiot"
    assert all(got[i].predicted == 0 and 0 <= got[i].score < 0.5 for i in (200, 201, 202, 204))
    kept = toxicity.drop_toxic(d, model)
    assert kept.columns == d.columns and kept.count() == 205 - 51
    none = toxicity.train(d, labels.where("doc_id < 0"))
    assert toxicity.score(d, none).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.score(docs(spark, []), model).count() == 0


def test_language_identification(spark):
    a, b = "the house and water", "der garten und wasser"
    rows = [(i, f"{a if i % 2 else b} {i}", "en" if i % 2 else "de") for i in range(80)] + [(90, None, "en"), (91, "123 ...", "de"), (92, "", None), (93, "THE WATER", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(d, langid.train(d)).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(80))
    assert [got[i].lang_pred for i in (90, 91, 92, 93)] == ["und", "und", "und", "en"]
    assert langid.predict(d, langid.train(d.where("doc_id < 0"))).where("lang_pred <> 'und'").count() == 0


def test_language_identification_against_brute_force(spark):
    """Naive Bayes by counting n-grams in dictionaries; n-grams that share a bucket count as one."""
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklabmn"}
    r = random.Random(3)
    word = lambda x: "".join(r.choice(letters[x]) for _ in range(r.randrange(2, 7)))
    rows = [(i, " ".join(word(x) for _ in range(12)), x) for i in range(300) for x in [r.choice(["aa", "bb", "cc"])]]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), smoothing=0.5)
    import zlib

    def grams(text):
        t = f" {text} "
        own = [t[i : i + 2] for i in range(len(t) - 1)] + [t[i : i + 3] for i in range(len(t) - 2)]
        buckets = langid._grams([text])[0].tolist()
        assert len(buckets) == len(own) and len(set(zip(own, buckets, strict=True))) == len(set(own))  # one bucket for each n-gram
        return buckets

    learned = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 4 != 2]
    counts, total = {x: {} for x in letters}, {}
    for _, text, x in learned:
        for g in grams(text):
            counts[x][g] = counts[x].get(g, 0) + 1
    for x in letters:
        total[x] = sum(counts[x].values()) + 0.5 * langid.BUCKETS
    size = {x: sum(y == x for _, _, y in learned) for x in letters}
    held = [t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    want = np.array([[sum(np.log((counts[x].get(g, 0) + 0.5) / total[x]) for g in grams(t)) + np.log((size[x] + 1) / (len(learned) + 3)) for x in sorted(letters)] for t in held])
    found = langid._scores(model, held)
    assert model.langs == sorted(letters) and np.allclose(want, found, atol=1e-3)


def test_training_takes_repeated_rows_once(spark, monkeypatch):
    taken = []
    original = langid.with_texts
    monkeypatch.setattr(langid, "with_texts", lambda *a: (taken.append(original(*a).select("row").distinct().count()), original(*a))[1])
    d = spark.createDataFrame([(i % 40, f"word number {i % 40}", "en" if i % 2 else "de") for i in range(1600)], "doc_id long, text string, lang string")
    model = langid.train(d)
    assert taken[0] <= 40 and model.langs == ["de", "en"]
    ratings = spark.createDataFrame([(i % 40, i % 2) for i in range(400)], "doc_id long, grade int")
    assert quality.score(d, quality.train(d, ratings)).count() == 1600
    rare = spark.createDataFrame([(i, "the house and water", "en") for i in range(3000)] + [(5000 + i, "der garten und wasser", "de") for i in range(8)], "doc_id long, text string, lang string")
    model = langid.train(rare, max_rows=50)
    assert model.langs == ["de", "en"] and model.prior[1] - model.prior[0] > 5
    empty = langid.train(rare.where("doc_id < 0"))
    assert langid.predict(rare.where("doc_id < 0"), empty).count() == 0 and empty.langs == []
    small = langid.with_texts(rare, rare.select("doc_id", F.col("lang").alias("label")).limit(100), 100, 200)
    assert small.agg(F.sum(F.octet_length("text"))).first()[0] <= 220


def test_cumulative_link_fit_against_gradient_by_differences():
    """At the optimum no small step of any weight or threshold raises the likelihood, computed grade by grade."""
    r = np.random.default_rng(7)
    x = r.normal(size=(400, 2))
    y = np.digitize(x @ np.array([1.5, -1.0]) + r.logistic(size=400), [-1.0, 1.0])
    model = quality.fit(y, [(np.array([0, 1]), row) for row in x], steps=800, rate=0.1, l2=0.0)

    def likelihood(w, cuts):
        out = 0.0
        for row, g in zip(x, y, strict=True):
            below = [1 / (1 + np.exp(-(c - row @ w))) for c in cuts]
            out += np.log(([*below, 1.0][g]) - ([0.0, *below][g]))
        return out / len(y)

    w, cuts = model.weights[:2], model.thresholds
    best = likelihood(w, cuts)
    for k in range(4):
        for step in (-0.05, 0.05):
            d = np.zeros(4)
            d[k] = step
            assert likelihood(w + d[:2], cuts + d[2:]) < best + 1e-5
    assert np.allclose(w, [1.5, -1.0], atol=0.4) and np.allclose(cuts, [-1, 1], atol=0.4)


def test_toxicity_covers_features_beyond_the_chains(spark):
    texts = [f"{prose(i, 30)} {('idiot', 'moron', 'friend', 'pal')[i % 4 if i % 40 > 3 else 1 + i % 3]} {prose(9000 + i, 30)}" for i in range(400)]
    d = docs(spark, texts)
    toxic = [int("idiot" in t or "moron" in t) for t in texts]
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)] * 2 + [(0, 1, 1 - toxic[0])], "doc_id long, quality int, toxic int")
    model = toxicity.train(d, labels, max_chains=8)
    got = {r.doc_id: r.predicted for r in toxicity.score(d.union(d), model).collect()}
    assert all(got[i] == toxic[i] for i in range(1, 400))


def test_quality_orders_grades(spark):
    texts = [f"{prose(i, 60)}." if i % 3 else "junk | " * 40 for i in range(150)]
    d = docs(spark, [*texts, None, ""])
    ratings = spark.createDataFrame([(i, 2 if i % 3 else 0) for i in range(150)] + [(None, 1), (5, None)], "doc_id long, grade int")
    got = {r.doc_id: r for r in quality.score(d, quality.train(d, ratings)).collect()}
    assert all(got[i].selected == bool(i % 3) for i in range(150))
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in got.values())
    assert quality.score(d, quality.train(d, ratings.where("grade > 5"))).where("selected").count() == 0


def test_ordinal_thresholds_are_ordered():
    r = np.random.default_rng(2)
    y = r.integers(0, 4, 300)
    rows = [(np.array([int(g), 10]), np.array([1.0, 1.0])) for g in y]
    model = quality.fit(y, rows)
    assert (np.diff(model.thresholds) > 0).all()
    s = np.array([model.weights[[g, 10]].sum() for g in range(4)])
    assert (np.diff(s) > 0).all()


def test_bpe_equals_the_library_and_round_trips(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["Hello, World! aaaaaaa", None, "", " \n", "it's I'LL 1234", "<|endoftext|> x<|startoftext|>y", "a\x1cb\x00c\x85d\xa0e", "ΑΣ İ ǅ 가 é é", "zz" * 5000, "\U0001f600 x", "Ɤ new letters Ᲊ"]
    texts += ["".join(chr(c) for c in range(a, a + 400)) for a in (0x20, 0x250, 0x600, 0x1F00, 0x3040, 0x1F300)]
    for r in bpe.encode_decode(docs(spark, texts), path, keep_ids=True).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.ids == ids and r.decoded == decoded and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode_decode(docs(spark, []), path).count() == 0


def test_decontamination_finds_copies_and_paraphrases(spark):
    items = [prose(50 + i, 24 + 3 * i, 5000) for i in range(8)]
    changed = items[3].split()
    changed[4], changed[11] = "other", "words"
    texts = [f"{prose(i, 90, 5000)} {items[i].upper()}. {prose(70 + i, 77, 5000)}" for i in range(3)]
    texts += [f"{prose(9, 50, 5000)} {' '.join(changed)} end", f"say {prose(77, 3)} zebra crossing now", prose(5, 20_000, 5000), None, "", "w1"]
    bench = spark.createDataFrame([*enumerate(items), (20, "zebra crossing"), (21, None), (22, "  "), (23, "?!")], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.kind) for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert found == {(0, 0, "copy"), (1, 1, "copy"), (2, 2, "copy"), (3, 3, "copy"), (4, 20, "short")}
    kept = decontaminate.drop_contaminated(docs(spark, texts), bench)
    assert kept.columns == docs(spark, []).columns and {r.doc_id for r in kept.collect()} == {5, 6, 7, 8}
    assert decontaminate.contaminated(docs(spark, texts), bench.where("item_id < 0")).count() == 0
    assert decontaminate.contaminated(docs(spark, []), bench).count() == 0


def test_decontamination_finds_widely_copied_items(spark):
    item = prose(60, 16, 5000)
    rare = [" ".join(f"r{i}x{j}" for j in range(80)) for i in range(30)]
    texts = [f"{t[:300]} {item} {t[300:]}" if i % 2 == 0 else t for i, t in enumerate(rare)]
    bench = spark.createDataFrame([(1, item), (2, prose(61, 30, 5000))], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.kind, r.common) for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert found == {(i, 1, "copy", 1.0) for i in range(0, 30, 2)}
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs(spark, texts), bench).collect()} == set(range(1, 30, 2))


def test_decontamination_finds_what_the_confirmation_accepts(spark):
    r = random.Random(12)
    items = [prose(300 + i, 24, 2000) + ". " + prose(400 + i, 6, 2000) for i in range(30)] + [prose(500 + i, 8 + i % 5, 2000) for i in range(10)]
    texts = []
    for i, item in enumerate(items):
        words = item.split()
        if i < 30:  # half of the words in place, the answer among them
            for j in r.sample(range(24), 15):
                words[j] = f"w{r.randrange(2000)}"
        texts.append(f"{prose(600 + i, 100 + i, 2000)} {' '.join(words)} {prose(700 + i, 90, 2000)}")

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *itertools.accumulate(range(len(b)), lambda left, j, x=x, old=row: max(left, old[j] + 1 if x == b[j] else old[j + 1]), initial=0)][1:]
        return row[-1]

    plain = [t.replace(".", "").split() for t in texts]
    for i, item in enumerate(items):
        assert common(item.replace(".", "").split(), plain[i]) >= (0.5 if i < 30 else 1.0) * len(item.split())
    found = {(x.doc_id, x.item_id): x.kind for x in decontaminate.contaminated(docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert all((i, i) in found for i in range(40)) and all(found[i, i] == "copy" for i in range(30, 40))
    assert set(found) == {(i, i) for i in range(40)}


def test_decontamination_finds_long_items(spark):
    items = [prose(800 + i, n, 5000) for i, n in enumerate((150, 300, 800, 5000))]
    texts = [f"{prose(810 + i, 333, 5000)} {t} {prose(820 + i, 250, 5000)}" for i, t in enumerate(items)] + [prose(830, 4000, 5000)]
    found = {(r.doc_id, r.item_id, r.common) for r in decontaminate.contaminated(docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert found == {(i, i, 1.0) for i in range(4)}


def test_decontamination_against_all_pairs(spark):
    """Every document with every item, by dynamic programming over every stretch."""
    r = random.Random(21)
    items = [prose(900 + i, n, 3000) + ". " + prose(950 + i, max(2, n // 5), 3000) for i, n in enumerate([8, 10, 14, 20, 25, 33, 40, 60, 90] * 4)]
    texts = []
    for i, item in enumerate(items):
        words = item.replace(".", "").split()
        for j in r.sample(range(int(0.8 * len(words))), int((0.0, 0.2, 0.45)[i % 3] * len(words))):
            words[j] = f"w{r.randrange(3000)}"
        texts.append(f"{prose(1000 + i, 60 + i, 3000)} {' '.join(words)} {prose(1100 + i, 50, 3000)}")
    texts += [texts[0], prose(1200, 300, 3000)]

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *itertools.accumulate(range(len(b)), lambda left, j, x=x, old=row: max(left, old[j] + 1 if x == b[j] else old[j + 1]), initial=0)][1:]
        return row[-1]

    want, verbatim = set(), set()
    for d, text in enumerate(texts):
        t = text.replace(".", "").split()
        for i, item in enumerate(items):
            w, last = item.replace(".", "").split(), decontaminate.answer_words(item)
            if len(set(w) & set(t)) < 0.5 * len(w):
                continue
            for s in range(0, len(t), 8):
                stretch = t[s : s + int(np.ceil(1.5 * len(w))) + 8]
                share = common(w, stretch) / len(w)
                if share >= 0.75 or share >= 0.5 and common(w[-last:], stretch) >= last:
                    want.add((d, i))
                    if share == 1:
                        verbatim.add((d, i))
    found = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert len(verbatim) >= 13 and verbatim <= found
    assert len(want & found) >= 0.95 * len(want) and len(want) >= 35
    assert found <= want | {(d, i) for d, i in found if i == d}


def latent_index(texts):
    items = [(i, Words([t.encode()], BY_LETTER).hashes(), 4) for i, t in enumerate(texts)]
    frequency = {}
    for _, h, _ in items:
        for w in set(h.tolist()):
            frequency[w] = frequency.get(w, 0) + 1
    return decontaminate.Index(items, [(i, o) for i, x in enumerate(items) for o in decontaminate.cuts(len(x[1]), 32)], frequency, len(items))


def test_latent_space_is_small_and_decides(spark):
    texts = [prose(1300 + i, 36, 6000) for i in range(60)]
    index = latent_index(texts).project(spark)
    rank = index.weights.shape[1]
    assert len(index.rows) > 2 * rank - 2 and rank < len(index.parts) * 3 and rank < len(index.vocabulary) / 4
    planted = [f"{prose(1400 + i, 50, 6000)} {t} {prose(1500 + i, 50, 6000)}".encode() for i, t in enumerate(texts)]
    assert all(i in {m[0] for m in found} for i, found in enumerate(decontaminate.find([index], planted)))
    without = latent_index(texts)  # any other space of so many dimensions loses items or passes far more candidates
    without.place_in(np.eye(len(without.vocabulary))[:, : rank // 4])
    hits = [i in {m[0] for m in found} for i, found in enumerate(decontaminate.find([without], planted))]
    assert sum(hits) < 45


def test_randomised_svd_against_numpy(spark):
    r = np.random.default_rng(4)
    topics = r.random((12, 500)) * (r.random((12, 500)) < 0.1)
    rows = []
    for _ in range(120):
        x = r.random(12) ** 4 @ topics + 0.02 * (r.random(500) < 0.02)
        c = np.flatnonzero(x)
        rows.append((c, x[c].astype(np.float32)))
    full = np.zeros((120, 500))
    for i, (c, x) in enumerate(rows):
        full[i, c] = x
    v, exact = decontaminate.randomized_svd(spark, rows, 500, 10), np.linalg.svd(full, full_matrices=False)[2][:10]
    assert v.shape == (500, 10) and np.allclose(v.T @ v, np.eye(10), atol=1e-6)
    assert np.linalg.norm(full @ v) >= 0.999 * np.linalg.norm(full @ exact.T)


def test_common_subsequence_against_dynamic_programming():
    r = random.Random(3)
    for _ in range(50):
        a, b = [r.randrange(6) for _ in range(20)], [r.randrange(6) for _ in range(30)]
        table = [[0] * 31 for _ in range(21)]
        for i, j in itertools.product(range(20), range(30)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        mask = {}
        for i, w in enumerate(a):
            mask[w] = mask.get(w, 0) | 1 << i
        assert decontaminate.common_subsequence(mask, 20, b) == table[20][30]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header><h1>Site name</h1></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies, fine?</div><main><article><h1>Head &amp; line</h1><p>First   para&shy;, with <a href=x>a link</a>.<br>More<p>Second one, longer than the rest of it.
<ul><li>item a<li>item b</ul><form><input>Search</form><aside>Aside, text.</aside><section id="comments"><p>Nice one, really.</p></section></article></main><div class="ad">Buy, now.</div><footer>&copy; us</footer></body></html>"""


def test_html_extraction(spark):
    assert html_extract.main_text(PAGE) == "Head & line First para­, with a link. More Second one, longer than the rest of it. item a item b"
    assert [html_extract.main_text(x) for x in (None, "", "<p>", "plain text", "<p>a &am b", "<body><nav>x</nav></body>", "<p cla")] == ["", "", "", "plain text", "a &am b", "", ""]
    d = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (3, "u", "<p>" + "word " * 100_000, "z")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract(d).collect()}
    assert got[2].text == "" and got[2].n_chars == 0 and got[3].n_chars == 499_999 and got[1].n_chars == len(got[1].text)
    assert html_extract.extract(d.where("page_id < 0")).count() == 0


LONG = "<p>The council met on Monday, and it decided, after a long debate, to rebuild the old bridge over the river. Work begins soon.</p>"
MORE = "<p>Residents had asked for this for years, and many were pleased, though some worried about the cost, which may reach two million.</p>"
STORY = "T The council met on Monday, and it decided, after a long debate, to rebuild the old bridge over the river. Work begins soon. {}Residents had asked for this for years, and many were pleased, though some worried about the cost, which may reach two million.{}"


@pytest.mark.parametrize(
    ("page", "between", "after"),
    [
        (f"<body><div class='col with-sidebar'><article><h1>T</h1>{LONG}{MORE}</article></div><div class='sidebar'><p>About us, here.</p></div>", "", ""),
        (f"<article><h1>T</h1>{LONG}<div class='recipe cookie'><p>Mix the flour, then bake.</p></div>{MORE}</article>", "Mix the flour, then bake. ", ""),
        (f"<div class=story><h1>T</h1>{LONG}{MORE}<div class='links-row'><a href=a>One</a> <a href=b>Two</a></div><div class='readers'><p>Nice one.</p><p>Me too!</p></div></div><div>(c) us</div>", "", ""),
        (f"<body><div><a href=1>Home</a> <a href=2>News</a></div><div><h1>T</h1>{LONG}<h2>Sub</h2><p>Short.</p>{MORE}<ul><li>one<li>two</ul></div><div><p>Sign up.</p></div>", "Sub Short. ", " one two"),
        (f"<article><h1>T</h1>{LONG}{MORE}<div id=comments>{LONG * 3}</div></article><div class=ad>{LONG}</div>", "", ""),
        (f"<body class='no-sidebar'><div class='a1'><h1>T</h1>{LONG}<div class='b2'><a href=x>See</a> <a href=y>also</a></div>{MORE}<table><tr><td>1<td>2</table></div><div class='c3'><p>All rights, reserved.</p></div>", "", " 1 2"),
    ],
)
def test_html_content_is_chosen_by_ratios(page, between, after, monkeypatch):
    assert html_extract.main_text(page) == STORY.format(between, after)


def test_html_without_ratios_is_wrong(monkeypatch):
    pages = ["<body><div>" + "<p>Home</p><p>News</p>" * 20 + f"</div><div class=s><h1>T</h1>{LONG}{MORE}</div><div class=t><p>Sign up.</p></div>", f"<div class=story><h1>T</h1>{LONG}{MORE}<div class='readers'><p>Nice one.</p></div></div><div><p>Ok.</p></div>"]
    assert all(html_extract.main_text(p) == STORY.format("", "") for p in pages)
    monkeypatch.setattr(html_extract, "path_ratios", lambda blocks: ([1.0] * len(blocks), [1.0] * len(blocks)))
    assert all(html_extract.main_text(p) != STORY.format("", "") for p in pages)


def test_html_path_ratios_against_brute_force():
    page = f"<body><div class='m1'><a href=x>Go, now.</a></div><div class=s><h1>T</h1>{LONG}<p>So, it is.</p>{MORE}</div><div class='m2'><a href=y>Up</a> a.</div>"
    found = html_extract.text_blocks(page)
    texts = ["Go, now.", "T", re.sub("<.*?>", "", LONG), "So, it is.", re.sub("<.*?>", "", MORE), "Up a."]
    paths, linked = ["div.m", "h1", "p", "p", "p", "div.m"], [8, 0, 0, 0, 0, 2]
    assert [t for _, t, _ in found] == texts

    def mean(of, i):
        own = [j for j in range(6) if paths[j] == paths[i]]
        return sum(of(j) for j in own) / len(own)

    length = [mean(lambda j: len(texts[j]), i) for i in range(6)]
    marks = [mean(lambda j: len(re.findall("[.,]", texts[j])), i) for i in range(6)]
    free = [1 - mean(lambda j: linked[j], i) / length[i] for i in range(6)]
    around = lambda x, i: (x[max(i - 1, 0)] + 2 * x[i] + x[min(i + 1, 5)]) / 4
    smoothed, own = html_extract.path_ratios(found)
    assert np.allclose(smoothed, [np.sqrt((around(length, i) + 1) * (around(marks, i) + 1)) * free[i] for i in range(6)])
    assert np.allclose(own, [np.sqrt((length[i] + 1) * (marks[i] + 1)) * free[i] for i in range(6)])


def test_html_long_pages_and_repeated_rows(spark):
    body = "<article>" + f"{LONG}{MORE}<p>Of.</p>" * 3000 + "</article>"
    d = spark.createDataFrame([(1, "u", body, 1), (1, "u", body, 2), (None, None, None, None)], "page_id long, url string, html string, n_chars int")
    got = html_extract.extract(d).collect()
    assert got[0] == got[1] and got[0].text.count("Of.") == 3000 and got[2].text == "" and got[2].page_id is None


@pytest.mark.parametrize("script", ["for(i=0;i<n;i++){f(i)}", 's="<!-- "', "if(a<b){}", "x='<![CDATA['", 's="</scripts>"', "a = '<?'", "var q='<a title=\\''"])
def test_html_after_scripts(script):
    page = f"<body><script>{script}</SCRIPT ><article><p>First one, here.</p><style>a<b</style><p>Second one, there.</p></article><script>{script}"
    assert html_extract.main_text(page) == "First one, here. Second one, there."


def calls(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, call_id string, seq long, name string, arguments string, depends_on array<string>, status string")


SCHEMAS = [("add", "x", "integer", True), ("add", "y", "number", False)]


def test_tool_calls(spark):
    c = calls(spark, [
        (1, "b", 1, "add", '{"y":2,"x":1}', ["a"], "!"), (1, "a", 2, "add", '{"x":"1"}', None, "!"), (1, "c", 3, "add", "[1]", ["zz", None], "!"), (1, "a", 9, "add", '{"x":1}', None, "!"),
        (2, "p", 1, "add", '{"x":1,"q":{"b":1,"a":[1, 2]}}', ["q"], "!"), (2, "q", 2, "nope", None, ["p"], "!"), (None, "a", 1, "add", "{}", None, "!"), (3, None, 1, "add", "{}", None, "!"),
    ])
    r = spark.createDataFrame([(1, "a", 5, "late"), (1, "a", 4, "first"), (1, "lost", 6, "orphan"), (None, None, 1, "x")], "conv_id long, call_id string, seq long, content string")
    s = spark.createDataFrame(SCHEMAS, "name string, param string, type string, required boolean")
    got = {(x.conv_id, x.call_id, x.seq): x for x in tool_calls.link_tool_calls(c, r, s).collect()}
    assert len(got) == 10 and got[None, "a", 1].status == got[3, None, 1].status == "no_result" and got[None, None, 1].status == "orphan_result"
    assert got[None, "a", 1].position is None and got[None, "a", 1].errors == "missing: x"
    assert [got[1, k, n].position for k, n in (("a", 2), ("b", 1), ("c", 3))] == [1, 2, 3]
    assert got[1, "a", 2].errors == "type: x" and got[1, "a", 2].status == "linked" and json.loads(got[1, "a", 2].record)["result"] == "first"
    assert got[1, "b", 1].valid and got[1, "b", 1].record == '{"arguments":{"x":1,"y":2},"depends_on":["a"],"id":"b","name":"add"}'
    assert got[1, "c", 3].errors == "arguments are no JSON object; missing: x; dependency: zz"
    assert got[1, "a", 9].status == "duplicate_call" and got[1, "lost", 6].status == "orphan_result" and got[1, "lost", 6].position is None
    assert "cycle" in got[2, "p", 1].errors and "unknown: q" in got[2, "p", 1].errors and '"q":{"a":[1,2],"b":1}' in got[2, "p", 1].record
    assert "unknown tool: nope" in got[2, "q", 2].errors
    assert tool_calls.link_tool_calls(c.where("seq < 0"), r.where("seq < 0"), s).count() == 0


def test_tool_call_order_on_random_graphs(spark):
    r = random.Random(8)
    rows = [(v, f"c{i}", r.randrange(600), "add", '{"x":1}', [f"c{j}" for j in r.sample(range(i), min(i, 2))], "") for v in range(5) for i in range(30)]
    s = spark.createDataFrame(SCHEMAS, "name string, param string, type string, required boolean")
    got = {(x.conv_id, x.call_id): x.position for x in tool_calls.link_tool_calls(calls(spark, rows), spark.createDataFrame([], "conv_id long, call_id string, seq long, content string"), s).collect()}
    for v, call, _, _, _, deps, _ in rows:
        assert all(got[v, d] < got[v, call] for d in deps)
    assert all(sorted(p for (w, _), p in got.items() if w == v) == list(range(1, 31)) for v in range(5))


def linked(spark, rows, results=()):
    s = spark.createDataFrame(SCHEMAS, "name string, param string, type string, required boolean")
    return tool_calls.link_tool_calls(calls(spark, rows), spark.createDataFrame(list(results), "conv_id long, call_id string, seq long, content string"), s)


def test_tool_call_cycles_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(tool_calls, "cut", lambda df, name="": (rounds.append(name), cut(df, name))[1])
    rows = [(1, f"c{i}", i, "add", '{"x":1}', [f"c{i - 1}"] if i else [], "") for i in range(1000)]
    rows[300] = (1, "c300", 300, "add", '{"x":1}', ["c301"], "")  # c300 and c301 wait for one another, and all behind them
    rows += [(2, f"d{i}", 1000 - i, "add", '{"x":1}', [f"d{i - 1}", f"d{max(i - 2, 0)}"] if i else [], "") for i in range(60)]  # a ladder against the sequence
    got = {(x.conv_id, x.call_id): x for x in linked(spark, rows).collect()}
    assert rounds.count("peeled") < 15
    assert all((got[1, f"c{i}"].errors == "cycle") == (i >= 300) and got[1, f"c{i}"].position == i + 1 for i in range(1000))
    assert all(got[2, f"d{i}"].position == i + 1 and got[2, f"d{i}"].valid for i in range(60))


@pytest.mark.parametrize("text", ['{"x":1} trailing', '{"x":1}{"x":2}', '{"x":1},{"x":2}', '{"x":1}]', '{"x":1}}', '{"x":1},"y":2', '{"x":1,"x":2}', '{"x":1}] {"x":1}', '{"x":NaN}', "", "null", "1"])
def test_tool_call_arguments_are_one_object(spark, text):
    row = linked(spark, [(1, "a", 1, "add", text, None, "")]).first()
    assert row.valid is False and "arguments are no JSON object" in row.errors and json.loads(row.record)["arguments"] == text


def test_tool_call_repeated_rows_and_long_arguments(spark):
    long = json.dumps({"x": 1, "y": 2.5, "z": "w" * 3_000_000})
    got = linked(spark, [(1, "a", 1, "add", '{"x":1}', None, "")] * 3 + [(1, "b", 2, "add", long, None, "")], [(1, "a", 5, "r")] * 2).collect()
    assert sorted(r.status for r in got) == ["duplicate_call", "duplicate_call", "linked", "no_result"]
    assert [r.errors for r in got if r.call_id == "b"] == ["unknown: z"]


def test_tool_calls_stay_native(spark):
    c = calls(spark, [(1, "b", 1, "add", "{}", [], "")])
    plan = tool_calls.link_tool_calls(c, spark.createDataFrame([], "conv_id long, call_id string, seq long, content string"), spark.createDataFrame(SCHEMAS, "name string, param string, type string, required boolean"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "ShuffledHashJoin" in plan


@pytest.mark.parametrize("ranges", [1, 7])
def test_warc_against_brute_force(spark, ranges):
    r = random.Random(2)
    urls = ["http://www.A.com/x/", "https://a.com/x?utm_source=q", "https://a.com/x#f", "http://b.com/?b=2&a=1", "http://m.b.com:80?a=1&b=2", "not a url", None]
    rows = []
    for i in range(400):
        kind = r.choice(["response", "revisit"])
        url = urls[0] if i % 3 == 0 else r.choice(urls)  # a hot URL
        rows.append((i, url, r.randrange(80) if i % 50 else None, kind, r.choice([None, '"e1"', 'W/"e1"', '"e2"']), r.choice([None, "mon"]), r.choice([None, "d1", "d2"]), {"date": f"t{i}", "content-length": str(i)} if i % 7 else None, "x"))
    d = spark.createDataFrame(rows, "record_id long, url string, captured_at long, kind string, etag string, last_modified string, digest string, headers map<string,string>, part string")
    keys = {x.u: x.c for x in spark.createDataFrame([(u,) for u in urls], "u string").select("u", warc.canonical_url(F.col("u")).alias("c")).collect()}
    assert keys[urls[0]] == keys[urls[1]] == keys[urls[2]] == "a.com/x" and keys[urls[3]] == keys[urls[4]] == "b.com?a=1&b=2"
    got = {x.record_id: x for x in warc.resolve_revisits(d, ranges).collect()}
    assert len(got) == sum(x[3] == "revisit" for x in rows)
    weak = lambda e: e.removeprefix("W/")
    for i, url, t, kind, etag, modified, digest, headers, _ in rows:
        if kind != "revisit":
            continue
        before = [x for x in rows if x[3] == "response" and url is not None and x[1] is not None and keys[x[1]] == keys[url] and x[2] is not None and t is not None and x[2] < t]
        hit = max(before, key=lambda x: (x[2], x[0]), default=None)
        if hit is None:
            want = "no earlier response"
        elif etag and hit[4]:
            want = "etag" if weak(etag) == weak(hit[4]) else "etag differs"
        elif modified and hit[5]:
            want = "last-modified" if modified == hit[5] else "last-modified differs"
        elif digest and hit[6]:
            want = "digest" if digest == hit[6] else "digest differs"
        else:
            want = "unverified"
        assert (got[i].response_id, got[i].reason) == (hit and hit[0], want)
        if got[i].resolved:
            merged = dict(hit[7] or {}) | {k: v for k, v in (headers or {}).items() if k in warc.PERMITTED}
            assert json.loads(got[i].headers) == merged
    assert warc.resolve_revisits(d.where("record_id < 0")).count() == 0


def test_warc_repeated_records_and_long_values(spark):
    schema = "record_id long, url string, captured_at long, kind string, etag string, last_modified string, digest string, headers map<string,string>"
    long = "http://a.com/" + "p" * 100_000
    rows = [(1, long, 1, "response", '"e"', None, "d", {"x": v}) for v in ("1", "3", "2")] + [(2, long, 5, "revisit", '"e"', None, "d", {"date": v * 100_000}) for v in "ab"]
    for order in (rows, rows[::-1]):
        got = warc.resolve_revisits(spark.createDataFrame(order, schema).repartition(3)).collect()
        assert len(got) >= 2 and all(json.loads(r.headers) == {"x": "3", "date": "b" * 100_000} and r.response_id == 1 for r in got)
