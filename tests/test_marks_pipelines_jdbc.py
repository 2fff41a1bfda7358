"""Watermarks by strategy, pipelines, JDBC in transactions, cached files, pairs of hubs and iterations that don't settle."""

import itertools
import uuid

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from lattica.operators import graph as G
from lattica.operators import pipelines as P
from lattica.sources import connectors as C
from lattica.streaming import watermarks as M

SCHEMA = "k string, t long, v double, src string, mark long, stop boolean"


def fed(spark, base, batches, strategy, **options):
    """Rows ``(k, t in us, v, src, mark, stop)`` come batch by batch; windows of 10 us."""
    out = None
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("t")).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(f"{SCHEMA}, ts timestamp").parquet(f"{base}/in")
        out = M.windows_by_mark(stream, "k", "ts", "v", 10, strategy, base, **options)
    return sorted(map(tuple, out.windows.collect()), key=repr), sorted(r["t"] for r in out.late.collect())


def row(t, v=1.0, k="a", src="x", mark=None, stop=False):
    return (k, t, v, src, mark, stop)


def test_punctuation_alone_moves_the_level(spark, tmp_path):
    batches = [[row(1), row(99), row(None)], [row(3, None), row(12, stop=True)], [row(5), row(14, k=None), row(25, stop=True)]]
    windows, late = fed(spark, f"file://{tmp_path}", batches, M.punctuated("stop"))
    assert windows == [("a", 0, 2, 1, 1.0, 1), ("a", 10, 1, 1, 1.0, 2), (None, 10, 1, 1, 1.0, 2)]
    assert late == [5]


def test_preserved_marks_and_times_before_the_epoch(spark, tmp_path):
    windows, late = fed(spark, f"file://{tmp_path}", [[row(-15), row(4, mark=0)], [row(-3), row(9, mark=10)], [row(8, mark=2)]], M.preserved("mark"))
    assert windows == [("a", -20, 1, 1, 1.0, 0), ("a", 0, 2, 2, 2.0, 1)]
    assert late == [-3, 8]


@pytest.mark.parametrize(("idle", "closed"), [(None, []), (1, [(0, 1), (10, 2)]), (2, [(0, 2), (10, 2)])])
def test_idle_sources(spark, tmp_path, idle, closed):
    batches = [[row(1), row(2, src="slow")], [row(15)], [row(35), row(36, src=None)]]
    windows, late = fed(spark, f"file://{tmp_path}", batches, M.periodic(), source="src", idle_batches=idle)
    assert [(w[1], w[5]) for w in windows] == closed
    assert late == []


def test_level_waits_for_a_source_without_mark_and_empty_batches(spark, tmp_path):
    windows, _ = fed(spark, f"file://{tmp_path}", [[], [row(1), row(None, src="y")], [row(40)], [row(50, src="y")]], M.periodic(), source="src")
    assert [w[1] for w in windows] == [0]
    with pytest.raises(ValueError):
        M.windows_by_mark(spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in"), "k", "t", "v", 0, M.periodic(), f"file://{tmp_path}")


def test_pipeline_freezes_what_it_learned(spark):
    rows = spark.createDataFrame([(float(x), 3.0 + 2 * x + x * x, 7.0) for x in range(-5, 6)] + [(None, 1.0, 7.0)], "x double, y double, flat double")
    stages = [P.Scaled(["x", "flat"]), P.Powers("x", 2), P.Mapped(lambda d: d.withColumn("half", F.col("x") / 2)), P.Descent(["x", "x_2"], "y", steps=400, rate=1.0)]
    model = Pipeline(stages=stages).fit(rows)
    pairs = P.evaluate(model, spark.createDataFrame([(2.0, 11.0, 7.0)], rows.schema), "y").first()
    assert pairs["truth"] == 11.0 and abs(pairs["prediction"] - 11.0) < 0.2
    out = model.transform(rows)
    assert out.where("x is null").first()["prediction"] is None and {r["flat"] for r in out.select("flat").collect()} == {0.0}
    mixed = Pipeline(stages=[P.Scaled(["x"]), VectorAssembler(inputCols=["x", "y"], outputCol="features")]).fit(rows.dropna())
    assert mixed.transform(rows.dropna()).where("size(array(features)) = 1").count() == 11
    with pytest.raises(ValueError):
        P.Powers("x", 0)


@pytest.fixture
def database(spark):
    url = f"jdbc:derby:memory:d{uuid.uuid4().hex};create=true"
    C._transact(spark, url, ["CREATE TABLE t (id BIGINT PRIMARY KEY, v DOUBLE)", "CREATE TABLE done (batch BIGINT PRIMARY KEY)"])
    return url


def test_jdbc_reads_in_parts_and_applies_in_one_transaction(spark, database):
    rows = spark.range(100).select(F.col("id").alias("ID"), (F.col("id") / 2).alias("V"))
    C.apply_jdbc(rows, database, "stage", ["INSERT INTO t SELECT \"ID\", \"V\" FROM stage"])
    parts = C.read_jdbc(spark, database, "t", "ID", 0, 100, 4)
    assert parts.rdd.getNumPartitions() == 4 and parts.agg(F.sum("ID")).first()[0] == 4950
    parted = C.read_jdbc(spark, database, "t", predicates=["id < 10", "id >= 10"])
    assert parted.rdd.getNumPartitions() == 2 and parted.count() == 100
    more = spark.createDataFrame([(5, 1.0), (500, 2.0)], "ID long, V double")
    with pytest.raises(Exception, match="(?i)duplicate"):  # the first statement is taken back with the second
        C.apply_jdbc(more, database, "stage", ["DELETE FROM t WHERE id = 7", "INSERT INTO t SELECT \"ID\", \"V\" FROM stage"])
    assert C.read_jdbc(spark, database, "t").count() == 100


def test_jdbc_sink_applies_a_repeated_batch_once(spark, database, tmp_path):
    path, statements = f"file://{tmp_path}", ["INSERT INTO t SELECT \"ID\", \"V\" FROM stage"]
    for part, checkpoint in ((0, "c"), (1, "c"), (0, "again")):  # a new checkpoint begins with batch 0 again
        spark.range(part * 10, part * 10 + 10).select(F.col("id").alias("ID"), F.lit(1.0).alias("V")).write.mode("overwrite").parquet(f"{path}/in/{part}")
        stream = spark.readStream.schema("ID long, V double").parquet(f"{path}/in/*")
        C.jdbc_sink(stream, database, "stage", statements, f"{path}/{checkpoint}", "done").awaitTermination()
    assert sorted(r[0] for r in C.read_jdbc(spark, database, "t").select("ID").collect()) == list(range(20))


def test_cached_file_is_bounded(spark):
    with pytest.raises(ValueError, match="3 rows"):
        C.cached_file(spark.range(4), 3)
    assert C.cached_file(spark.range(3), 3).endswith(".parquet")


def test_pairs_of_a_hub_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(G, "PAIR_BLOCK", 3)
    links = [(i, 100) for i in range(11)] + [(i, 101 + i % 3) for i in range(11)] + [(4, 4)]
    near: dict = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {(a, b, len(near[a] & near[b]), len(near[a] & near[b]) / len(near[a] | near[b])) for a, b in itertools.combinations(sorted(near), 2) if near[a] & near[b]}
    edges = spark.createDataFrame(links + links[:3], "src long, dst long")
    assert {tuple(r)[:4] for r in G.shared_neighbors(edges).collect()} == want
    tops: dict = {}
    for a, b in set(links):
        tops.setdefault(b, set()).add(a)
    shared: dict = {}
    for group in tops.values():
        for pair in itertools.combinations(sorted(group), 2):
            shared[pair] = shared.get(pair, 0) + 1
    assert {(r["a"], r["b"]): r["shared"] for r in G.bipartite_projection(edges).collect()} == shared
    assert G.bipartite_projection(edges.limit(0)).count() == 0


def test_iterations_say_that_they_have_not_settled(spark):
    start = spark.createDataFrame([(1, 0), (2, 5)], "id long, v long")
    grow = lambda s: s.withColumn("v", F.col("v") + 1)
    assert sorted(map(tuple, G.bulk_iterate(start, grow, 3).collect())) == [(1, 3), (2, 8)]
    with pytest.raises(RuntimeError, match="3 supersteps"):
        G.bulk_iterate(start, grow, 3, done=lambda s: False, settle=True)
    step = lambda s, w: grow(w.where("v < 7"))
    assert sorted(map(tuple, G.delta_iterate(start, start, "id", step, 20, settle=True).collect())) == [(1, 7), (2, 7)]
    assert sorted(map(tuple, G.delta_iterate(start, start, "id", step, 2).collect())) == [(1, 2), (2, 7)]
    with pytest.raises(RuntimeError, match="still change"):
        G.delta_iterate(start, start, "id", step, 2, settle=True)
