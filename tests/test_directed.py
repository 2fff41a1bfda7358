"""Directed clustering and census against all triples."""

import itertools
import math
import random

import re

import pytest

from lattica.operators import directed


def graph(seed, n, m):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n)) for _ in range(m)]


#: One edge list for each type; fixed definitions.
SHAPES = {"012": "ab", "102": "ab ba", "021D": "ba bc", "021U": "ab cb", "021C": "ab bc", "111D": "ac ca bc", "111U": "ac ca cb", "030T": "ab cb ac", "030C": "ba cb ac", "201": "ab ba ac ca",
          "120D": "bc ba ac ca", "120U": "ab cb ac ca", "120C": "ab bc ac ca", "210": "ab bc cb ac ca", "300": "ab ba bc cb ac ca"}


def edges_of(shape):
    return {("abc".index(e[0]), "abc".index(e[1])) for e in shape.split()}


def kind(es):
    for name, shape in SHAPES.items():
        if any({(p[x], p[y]) for x, y in edges_of(shape)} == es for p in itertools.permutations(range(3))):
            return name
    return "003"


@pytest.mark.parametrize("edges", [graph(1, 9, 20), graph(2, 12, 90), graph(3, 30, 60), [(1, 1), (2, 3)], [(0, 1), (1, 2), (2, 0), (0, 1)]])
def test_census_and_clustering_over_all_triples(spark, edges):
    frame = spark.createDataFrame(edges, "src long, dst long")
    simple = {(x, y) for x, y in edges if x != y}
    ids = sorted({v for e in edges for v in e})
    want = dict.fromkeys(directed.TRIADS, 0)
    for triple in itertools.combinations(ids, 3):
        want[kind({(triple.index(x), triple.index(y)) for x, y in simple if x in triple and y in triple})] += 1
    assert {r.type: int(r.n) for r in directed.triadic_census(frame).collect()} == want
    near = {v: {y for x, y in simple if x == v} | {x for x, y in simple if y == v} for v in ids}
    local = {}
    for v in ids:
        d = len(near[v])
        links = sum(x in near[v] and y in near[v] for x, y in simple)
        local[v] = (d, links, links / (d * (d - 1)) if d > 1 else 0.0)
    assert {r.id: (r.degree, r.links, round(r.local, 9)) for r in directed.clustering(frame).collect()} == {v: (d, n, round(x, 9)) for v, (d, n, x) in local.items()}
    g = directed.global_clustering(frame).first()
    triplets = sum(len(x) * (len(x) - 1) // 2 for x in near.values())
    closed = sum(y in near[x] for v in ids for x, y in itertools.combinations(near[v], 2))
    assert (g.triplets or 0, g.closed) == (triplets, closed) and g.average_coefficient == pytest.approx(sum(x[2] for x in local.values()) / len(ids))


@pytest.mark.parametrize("block", [3, 1024])
def test_pairs_are_made_behind_their_last_shuffle(spark, monkeypatch, block):
    import itertools
    import math

    from lattica.operators import graph

    monkeypatch.setattr(graph, "PAIR_BLOCK", block)
    edges = {(a, 100 + b) for a in range(12) for b in range(6) if (a * b) % 4 < 2 or a == 3}
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    both = {p: near[p[0]] & near[p[1]] for p in itertools.combinations(sorted(near), 2) if near[p[0]] & near[p[1]]}
    got = graph.shared_neighbors(df)
    assert {(r.a, r.b): (r.shared, round(r.jaccard, 9), round(r.adamic_adar, 6)) for r in got.collect()} == {p: (len(m), round(len(m) / len(near[p[0]] | near[p[1]]), 9), round(sum(1 / math.log(len(near[x])) for x in m), 6)) for p, m in both.items()}
    tops = graph.bipartite_projection(df)
    assert {(r.a, r.b): r.shared for r in tops.collect()} == {p: len(m) for p, m in both.items() if p[1] < 100}
    for frame in (got, tops):
        assert not re.search(r"hashpartitioning\(a#\w+, b#", frame._jdf.queryExecution().toString())


def test_label_propagation_takes_more_tasks_for_more_links(spark, monkeypatch):
    from lattica.operators import graph as g

    edges = spark.createDataFrame([(i, j) for i in range(0, 120, 3) for j in (i + 1, i + 2)] + [(i + 1, i + 2) for i in range(0, 120, 3)], "src long, dst long")
    few = {tuple(r) for r in g.label_propagation(edges, 3).collect()}
    monkeypatch.setattr(g, "LINKS_A_TASK", 10)
    many = g.label_propagation(edges, 3)
    assert len(many.inputFiles()) > int(spark.conf.get("spark.sql.shuffle.partitions")) and {tuple(r) for r in many.collect()} == few


def test_triangles_shuffle_edges_once_each_way(spark, monkeypatch):
    """Edges are not shuffled in both directions; what would go to vertices without targets is left; with that set too large for a broadcast the same."""
    from lattica.operators import graph as g

    written, cut = [], g.cut

    def noted(df, name="cut", **rest):
        written.append(cut(df, name, **rest))
        return written[-1]

    monkeypatch.setattr(g, "cut", noted)
    edges = {(a, b) for a in range(40) for b in range(a, 40) if (a * b + a + b) % 7 < 2} | {(a, 90 + b) for a in range(40) for b in range(3)} | {(95, a) for a in range(0, 40, 2)}
    frame = spark.createDataFrame([*edges, *[(b, a) for a, b in list(edges)[:9]], (None, 3), (3, None)], "src long, dst long")
    near: dict = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {t for t in itertools.combinations(sorted(near), 3) if t[1] in near[t[0]] and t[2] in near[t[0]] and t[2] in near[t[1]]}
    for most in (g.BROADCAST_SINKS if hasattr(g, "BROADCAST_SINKS") else 0, 0):
        monkeypatch.setattr(g, "BROADCAST_SINKS", most, raising=False)
        got = [tuple(r) for r in g.triangles(frame).collect()]
        assert len(got) == len(want) and set(got) == want
        rows = {r.id: (r.degree, r.triangles) for r in g.clustering_coefficients(frame).collect()}
        assert rows == {v: (len(n), sum(v in t for t in want)) for v, n in near.items()}
    assert max(f.count() for f in written) <= len(near)  # no list of links in both directions
    assert g.triangles(frame.limit(0)).count() == 0 and g.clustering_coefficients(frame.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1024, 4])
def test_pairs_are_packed_and_counted_without_a_table(spark, monkeypatch, block):
    """Neighbours lie on both sides of a vertex, ids are far apart, a hub has several blocks; no aggregate holds the pairs."""
    from lattica.operators import graph

    monkeypatch.setattr(graph, "PAIR_BLOCK", block)
    r = random.Random(6)
    ids = [-(2**63), -(2**40), *range(-9, 9), 2**33, 2**62, 2**63 - 1]
    edges = {(a, b) for a in ids for b in ids if a != b and r.random() < 0.15} | {(0, b) for b in ids if b}
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    both = {p: near[p[0]] & near[p[1]] for p in itertools.combinations(sorted(near), 2) if near[p[0]] & near[p[1]]}
    got = graph.shared_neighbors(spark.createDataFrame([*edges, (3, 3), (None, 1)], "src long, dst long"))
    rows = [(r.a, r.b, r.shared, round(r.jaccard, 9), round(r.adamic_adar, 6)) for r in got.collect()]
    assert sorted(rows) == [(*p, len(m), round(len(m) / len(near[p[0]] | near[p[1]]), 9), round(sum(1 / math.log(len(near[x])) for x in m), 6)) for p, m in sorted(both.items())]
    assert not re.search(r"HashAggregate\(keys=\[[^\]]*\ba#\w+L?, [^\]]*\bb#\w+L?\], functions=\[[^\]]*(count|sum)", got._jdf.queryExecution().executedPlan().toString())
    small = graph.bipartite_projection(spark.createDataFrame([(1, 9), (2, 9), (1, 8), (2, 8), (3, 8)], "src int, dst int"))
    assert small.dtypes[0] == ("a", "int") and {tuple(r) for r in small.collect()} == {(1, 2, 2), (1, 3, 1), (2, 3, 1)}
