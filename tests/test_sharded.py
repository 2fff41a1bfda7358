"""Factorisation by strata and learners by parameter mixing."""

import itertools
import pathlib
import random
import urllib.parse

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import sharded


def rated(seed, users, items, share, hot=0):
    r = np.random.default_rng(seed)
    p, q = r.normal(size=(users, 2)), r.normal(size=(items, 2))
    return [(u, i, float(3 + p[u] @ q[i])) for u in range(users) for i in range(items) if r.random() < share or u < hot]


def rmse(spark, model, rows):
    pairs = spark.createDataFrame(rows, "u long, i long, r double")
    return sharded.predict_ratings(pairs, model, "u", "i").agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("r"), 2)))).first()[0]


def test_factors_predict_held_out_ratings_with_a_hot_user(spark):
    rows = rated(1, 40, 30, 0.6, hot=1)
    held_out, kept = rows[::9], [r for n, r in enumerate(rows) if n % 9]
    frame = spark.createDataFrame([*kept, (None, 1, 2.0), (1, 2, None)], "u long, i long, r double")
    model = sharded.factorize(frame, "u", "i", "r", rank=3, epochs=8, blocks=3, rate=0.25, l2=0.01, decay=1.0)
    spread = float(np.std([r[2] for r in held_out]))
    assert rmse(spark, model, kept) < 0.5 * spread and rmse(spark, model, held_out) < 0.75 * spread
    assert model.users.count() == 40 and model.items.count() == 30
    # Later ratings of a new user go on from these factors; others stay.
    later = [(99, i, r) for u, i, r in kept if u == 0]
    more = sharded.factorize(spark.createDataFrame(later, "u long, i long, r double"), "u", "i", "r", rank=3, epochs=2, blocks=2, start=model)
    assert more.users.count() == 41 and more.items.count() == 30
    old, new = ({r.id: r.factors for r in m.users.collect()} for m in (model, more))
    assert all(new[u] == old[u] for u in old)
    # The best items equal brute force over the learned factors, ties and unknown users included.
    users = spark.createDataFrame([(0,), (7,), (7,), (99,), (12345,)], "id long")
    p, q = {r.id: np.array(r.factors) for r in more.users.collect()}, {r.id: np.array(r.factors) for r in more.items.collect()}
    want = [(u, i) for u in (0, 7, 99) for i in sorted(q, key=lambda i: (-p[u] @ q[i], i))[:5]]
    got = [(r.user, r.item) for r in sharded.best_items(more, users, 5, block=7).orderBy("user", "rank").collect()]
    assert got == want


def test_items_that_all_batches_have_do_not_leave_users_behind(spark):
    """Thousands of users rate few items: what the first users have learned must still fit when the last have taught."""
    n = 10000
    rows = spark.range(10 * n).select(F.pmod("id", F.lit(n)).alias("u"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)).alias("i"), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(5000)) / 1000).alias("r")).persist()
    model = sharded.factorize(rows, "u", "i", "r", rank=4, epochs=6, blocks=2, rate=0.2, l2=0.01)
    error = sharded.predict_ratings(rows, model, "u", "i").agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("r"), 2)))).first()[0]
    assert error < 1.23  # their spread is 1.44
    rows.unpersist()


def test_passes_move_lists_of_examples_and_leave_no_models_behind(spark, monkeypatch):
    """Every example is in one list, none of which is long; the lists and former models are deleted."""
    written, examples, cut = [], [], sharded.cut

    def noted(df, name="cut", **rest):
        out = cut(df, name, **rest)
        written.append(pathlib.Path(urllib.parse.urlparse(out.inputFiles()[0]).path.split(f"/{name}-")[0], next(x for x in out.inputFiles()[0].split("/") if x.startswith(f"{name}-"))))
        if name == "strata":
            examples.append(out.selectExpr("count(*)", "sum(size(r))", "max(size(r))").first())
        return out

    monkeypatch.setattr(sharded, "cut", noted)
    frame = spark.range(6000).select((F.col("id") % 700).alias("u"), (F.col("id") % 3).alias("i"), F.lit(1.5).alias("r"))
    model = sharded.factorize(frame, "u", "i", "r", rank=2, epochs=2, blocks=2)
    assert model.users.count() == 700 and model.items.count() == 3
    lists, n, longest = examples[0]
    assert n == 6000 and longest <= sharded._CHUNK and lists < 600
    assert len(written) > 6 and [any(p.rglob("*.parquet")) for p in written] == [False] * (len(written) - 1) + [True]


def test_factors_of_nothing(spark):
    model = sharded.factorize(spark.createDataFrame([], "u long, i long, r double"), "u", "i", "r", epochs=1, blocks=2)
    assert model.users.count() == 0 and rmse(spark, model, [(1, 1, 2.0)]) == 2.0


def simulated(examples, step, width, start, epochs):
    w = {}
    for _ in range(epochs):
        seen = {}
        for shard in sorted({e[0] for e in examples}):
            own = {}
            n = {}
            for _, _, label, features in sorted((e for e in examples if e[0] == shard and e[2] is not None and e[3]), key=lambda e: e[1]):
                names = list(features)
                m = np.array([own.get(f, w.get(f, start(f))) for f in names], float).reshape(len(names), width)
                change = step(label, np.array([features[f] for f in names]), m)
                for k, f in enumerate(names):
                    own[f] = m[k] + (0 if change is None else change[k])
                    n[f] = n.get(f, 0) + 1
            for f, v in own.items():
                seen.setdefault(f, []).append((v, n[f]))
        w |= {f: sum(v * n for v, n in vs) / sum(n for _, n in vs) for f, vs in seen.items()}
    return w


EXAMPLES = "shard long, id long, label string, features map<string,double>"


@pytest.mark.parametrize("classes", [None, ["a", "b", "c"]])
def test_mixing_equals_a_sequential_simulation(spark, classes):
    r = random.Random(3)
    labels = classes or ["-1", "1"]
    examples = [(r.randrange(3), n, r.choice([*labels, *labels, None]), {f"f{k}": r.uniform(-1, 1) for k in r.sample(range(8), r.randint(0, 4))} or None) for n in range(80)]
    learner = sharded.multiclass_passive_aggressive(classes, 0.5) if classes else sharded.passive_aggressive(0.5)
    frame = spark.createDataFrame(examples, EXAMPLES)
    model = sharded.mixed(frame, learner, 2)
    want = simulated(examples, learner.step, learner.width, lambda f: [0.0] * learner.width, 2)
    got = {x.feature: x.w for x in model.collect()}
    assert set(got) == set(want) and all(np.allclose(got[f], want[f]) for f in want)
    again = sharded.mixed(frame.where("id < 5"), learner, 1, start=model)
    assert again.count() == len(want)
    scored = {x.id: x.scores for x in sharded.scores(frame, model).collect()}
    for _, i, _, features in examples:
        total = sum((np.array(want[f]) * x for f, x in (features or {}).items()), np.zeros(learner.width))
        assert np.allclose(scored[i] or 0, total if scored[i] else 0) and (scored[i] or not features)


def test_factorization_machine_learns_a_product(spark):
    """The label is the product of two signs, which no linear model can tell; held-out rows are told."""
    r = random.Random(8)
    rows = []
    for n in range(600):
        a, b = r.choice("xy"), r.choice("xy")
        rows.append((n % 2, n, "1" if a == b else "-1", {f"a={a}": 1.0, f"b={b}": 1.0, f"noise={r.randrange(5)}": 1.0}))
    train, test = spark.createDataFrame(rows[:500], EXAMPLES), spark.createDataFrame(rows[500:], EXAMPLES)
    model = sharded.mixed(train, sharded.factorization_machine(4, 0.2, 0.0005), 6)
    got = {x.id: x.scores[0] for x in sharded.scores(test, model, machine=True).collect()}
    right = sum((got[n] > 0) == (label == "1") for _, n, label, _ in rows[500:])
    assert right >= 95
    linear = {x.id: x.scores[0] for x in sharded.scores(test, sharded.mixed(train, sharded.passive_aggressive(), 3)).collect()}
    assert sum((linear[n] > 0) == (label == "1") for _, n, label, _ in rows[500:]) < 80
