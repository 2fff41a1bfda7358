"""Cases that once went wrong."""

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from lattica.llm import _sample, decontaminate, filters, html_extract, near_dedup, tool_calls, toxicity


def prose(seed, n):
    r = random.Random(seed)
    return [f"w{r.randrange(4000)}" for _ in range(n)]


def test_moved_sentences_are_found(spark):
    """The answer's own words count, wherever a paraphrase has moved the item's sentences."""
    item = [f"item{i}" for i in range(20)]
    text = " ".join(item[:14]) + ". " + " ".join(item[14:])
    around = prose(1, 200)
    texts = {1: around[:100] + item[8:] + item[:8] + around[100:], 2: item[8:] + item[:8] + around, 3: item[8:] + around[:4] + item[:4] + around[4:], 4: item[14:] + item[:14], 5: around + item, 6: around}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    kept = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert kept == {6}


def test_passes_over_the_documents(spark, monkeypatch):
    """Many passes keep what one does; each is a stage of its own."""
    monkeypatch.setattr(decontaminate, "PASSAGES", 3)
    monkeypatch.setattr(decontaminate, "GROUPS", 1)
    items = [[f"q{k}x{i}" for i in range(25)] for k in range(8)] + [["short", "run", "here"]]
    texts = {k: prose(k, 60) + item + prose(k + 50, 60) for k, item in enumerate(items)} | {100 + k: prose(k + 200, 150) for k in range(4)}
    docs = spark.createDataFrame([(i, " ".join(t), i * 2) for i, t in texts.items()] + [(None, None, 7)], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {(r.doc_id, r.item_id) for r in kept.collect()} == {(None, 7)} | {(100 + k, 200 + 2 * k) for k in range(4)}
    assert kept._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == {(k, k) for k in range(9)}


def test_answer_is_counted_by_itself():
    words = np.arange(1, 21, dtype=np.uint64)
    item = decontaminate.Item(1, words, 6)
    assert item.common([*range(9, 21), *range(1, 9)]) == (12 / 20, "paraphrase")
    assert item.common([*range(1, 13)])[1] == "" and item.common([*range(1, 21)])[1] == "copy"


def test_quotes_inside_values_are_text_of_the_value():
    body = "First words of it, and more. It goes on, for long enough; to be a text.</p><p>It's the second paragraph, with commas, too. And it's not short at all."
    want = "First words of it, and more. It goes on, for long enough; to be a text. It's the second paragraph, with commas, too. And it's not short at all."
    for p in ("<p title=don't>", "<p alt=John's data-x=\"a>b\">", "<p data-x = 'a>b' title=it's>", "<p '>", '<p ">'):
        assert html_extract.main_text(f"<article>{p}{body}</p></article>") == want
    assert html_extract.main_text(f"<article><p>{body}<img alt=John's><a href=/o'reilly>link</a></p></article>") == want + " link"


def test_pages_of_any_depth_take_bounded_memory():
    page = "<div>" * 200_000 + "<p>" + "A sentence, of some words; and more. " * 20 + "</p>" + "</div>" * 200_000
    tracemalloc.start()
    text = html_extract.main_text(page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert text.count("A sentence") == 20 and peak < 300e6
    assert html_extract.main_text("<div>text, here. " * 3000).count("text, here.") > 2000  # the deepest element with four fifths of it


def test_rows_of_one_id_link_their_texts(spark):
    x, y = " ".join(prose(3, 60)), " ".join(prose(4, 60))
    rows = [(5, x), (5, y), (1, y), (9, x), (7, " ".join(prose(5, 60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_dedup(docs).collect()}
    assert got == {(5, 1, False), (1, 1, True), (9, 1, False), (7, 7, True)}
    assert sorted(r.doc_id for r in filters.drop_near_copies(docs).collect()) == [1, 7]


def test_parameter_names_with_quotes(spark):
    names = ["it's", 'say "so"', "both ' and \"", "", "plain"]
    schemas = spark.createDataFrame([("t", n, "string", True) for n in names], "name string, param string, type string, required boolean")
    calls = spark.createDataFrame([(1, "a", 1, "t", '{"it\'s": 1, "say \\"so\\"": 2, "both \' and \\"": 3, "": 4, "plain": 5}', None)], "conv_id long, call_id string, seq long, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([], "conv_id long, call_id string, seq long, content string")
    r = tool_calls.link_tool_calls(calls, results, schemas).first()
    assert set(r.errors.split("; ")) == {"type: it's", 'type: say "so"', "type: plain"}


def test_toxicity_learns_from_small_samples_and_keeps_unlike_documents():
    r = np.random.default_rng(1)
    clean = [r.integers(0, 5000, (toxicity.N_FEATURES, 40), dtype=np.int32) for _ in range(30)]
    toxic = [np.concatenate([r.integers(0, 5000, (toxicity.N_FEATURES, 30), dtype=np.int32), np.full((toxicity.N_FEATURES, 3), 9000, np.int32)], axis=1) for _ in range(4)]
    assert len(toxicity._without_copies(clean + toxic)) == 34
    near = [np.concatenate([clean[0], clean[0][:, :1]], axis=1)]
    assert toxicity._without_copies(clean + near) == list(range(30))
    model = toxicity.fit(np.array([0] * 30 + [1] * 4), clean + toxic)
    assert not model.empty and model.weights[9000] > 0


def test_samples_by_a_hot_value_are_cut_before_the_window(spark):
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, "b").when(F.col("id") % 999 == 1, None).otherwise("a").alias("lang"))
    got = {r.lang: r["count"] for r in _sample.sample(rows, 500, "lang").groupBy("lang").count().collect()}
    assert got == {"a": 500, "b": 500, None: rows.where("lang is null").count()}
    plan = _sample.sample(rows, 500, "lang")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Join LeftOuter")  # the threshold lies below the window
