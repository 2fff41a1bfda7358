"""The corpus pipeline against brute-force versions of its stages on a planted corpus, and on the smallest dataset."""

import collections
import hashlib
import random

import corpus_pipeline
import public_tokenizers
from test_small import brute_components, prose
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def planted(spark, folder):
    """Documents with toxic words, exact copies, near copies and benchmark passages; returns what brute force keeps."""
    r = random.Random(31)
    items = [prose(7000 + i, 30, 4000) + ". " + prose(7100 + i, 6, 4000) for i in range(5)]
    texts = [f"{prose(2000 + i, 60, 4000)} {'idiot' if i % 5 == 0 else 'friend'} {prose(4000 + i, 60, 4000)}" for i in range(200)]
    texts += [texts[r.randrange(200)] for _ in range(30)]  # exact copies
    for i in r.sample(range(200), 30):  # near copies: a word of 121 changed
        words = texts[i].split()
        words[r.randrange(121)] = f"new{i}"
        texts.append(" ".join(words))
    texts += [f"{prose(9000 + i, 80, 4000)} {items[i % 5].upper()} {prose(9100 + i, 80, 4000)}" for i in range(12)]
    texts += [None, "", "  ", "short", "Short one"]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    toxic = {i for i, t in zip(ids, texts, strict=True) if t and "idiot" in t.split()}
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in ids], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    kept = {i: t for i, t in zip(ids, texts, strict=True) if i not in toxic}
    steps = [set(kept)]
    last = {}
    for i, t in sorted(kept.items()):
        last[t or ""] = i
    kept = {i: kept[i] for i in last.values()}
    steps.append(set(kept))
    order = sorted(kept)
    root, _ = brute_components([kept[i] for i in order])
    kept = {i: kept[i] for k, i in enumerate(order) if root[k] == k}
    steps.append(set(kept))
    plain = [t.replace(".", "") for t in items]
    kept = {i: t for i, t in kept.items() if not any(p in (t or "").lower().replace(".", "") for p in plain)}
    steps.append(set(kept))
    return kept, steps


def test_run_against_brute_force(spark, tmp_path):
    kept, steps = planted(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], steps, strict=True):
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        assert {r.doc_id for r in docs.collect()} == want, name
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(kept)
    for i, t in kept.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_stages_take_nulls_and_empty_tables(spark, tmp_path):
    planted(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "a b c d e f", "en", None, 1), (1, None, None, None, None), (1, None, None, None, None)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("doc_id < 0"), str(tmp_path)).count() == 0, name
        assert stage(spark, odd, str(tmp_path)).count() >= 2, name


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, before, SF).collect(), docs.schema)
        assert after.columns == docs.columns
        old, new = {r.doc_id: r.text for r in before.collect()}, {r.doc_id: r.text for r in after.collect()}
        assert all(old[i] == t for i, t in new.items())
        if name == "exact dedup":
            last = {t: i for i, t in sorted(old.items())}
            assert new == {i: t for t, i in last.items()}
        before = after
    assert collections.Counter(r.doc_id for r in before.collect()).most_common(1)[0][1] == 1
    final = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in final.collect()} == {r.doc_id for r in before.collect()}
    assert final.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
