import os

import pytest
from pyspark.sql import functions as F

from lattica.cli import Client
from lattica.functions import scalars as S
from lattica.operators import graph as G
from lattica.operators import ml, relational as R
from lattica.plans import dialect, validation
from lattica.plans.lineage import cut
from lattica.sources import connectors as C
from lattica.streaming import cep, stateful
from lattica.streaming import windows as W


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    got = dict(G.connected_components(edges(spark, chain + star + [(500, 500)])).collect())
    assert {got[i] for i in range(41)} == {0}
    assert {got[100 + i] for i in range(30)} == {100}
    assert got[500] == 500
    assert G.connected_components(edges(spark, [])).count() == 0


def test_pagerank_sums_to_one_and_sssp(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4)])
    ranks = dict(G.pagerank(e, steps=20).collect())
    assert abs(sum(ranks.values()) - 1) < 1e-9
    d = dict(G.sssp(e.withColumn("value", F.lit(2.0)), 1).collect())
    assert d == {1: 0.0, 2: 2.0, 3: 4.0, 4: 6.0}
    h = G.hits(e, 5).collect()
    assert abs(sum(r.hub**2 for r in h) - 1) < 1e-9


def test_triangles_census_and_clustering(spark):
    k4 = G.complete_graph(spark, 4)
    assert G.triangles(k4).count() == 4
    assert G.global_clustering(k4).first().global_coefficient == 1.0
    c = G.triad_counts(edges(spark, [(1, 2), (2, 3), (1, 3), (3, 4)])).first()
    assert (c.closed, c.two_edges, c.one_edge, c.no_edge) == (1, 2, 1, 0)


def test_generators(spark):
    assert G.cycle_graph(spark, 5).count() == 10
    assert G.path_graph(spark, 5).count() == 8
    assert G.star_graph(spark, 5).count() == 8
    assert G.grid_graph(spark, 2, 3).count() == 14
    assert G.hypercube_graph(spark, 3).count() == 24
    assert G.singleton_edge_graph(spark, 3).count() == 6
    echo = {(r.src, r.dst) for r in G.echo_graph(spark, 10, 3).collect()}
    assert echo == {(i, (i + k) % 10) for i in range(10) for k in (4, 5, 6)}
    assert {(r.src, r.dst) for r in G.echo_graph(spark, 9, 2).collect()} == {(i, (i + k) % 9) for i in range(9) for k in (4, 5)}
    for wrong in ((5, 3), (6, 2), (8, 8), (1, 1)):
        with pytest.raises(ValueError):
            G.echo_graph(spark, *wrong)
    for make in (lambda: G.cycle_graph(spark, 2), lambda: G.complete_graph(spark, 1), lambda: G.grid_graph(spark, 1, 3), lambda: G.circulant_graph(spark, 5, [5]), lambda: G.hypercube_graph(spark, 0), lambda: G.singleton_edge_graph(spark, 0), lambda: G.star_graph(spark, 1), lambda: G.path_graph(spark, 1)):
        with pytest.raises(ValueError):
            make()
    assert G.rmat_graph(spark, 5, 100).where("src >= 32 OR dst >= 32 OR src < 0").count() == 0


def test_label_propagation_closure_and_projection(spark):
    two = edges(spark, [(1, 2), (2, 3), (1, 3), (7, 8), (8, 9), (7, 9)])
    labels = dict(G.label_propagation(two, 5).collect())
    assert len({labels[i] for i in (1, 2, 3)} & {labels[i] for i in (7, 8, 9)}) == 0
    assert G.community_detection(two, 3).count() == 6
    assert G.transitive_closure(edges(spark, [(1, 2), (2, 3), (3, 4)])).count() == 6
    assert [tuple(r) for r in G.bipartite_projection(edges(spark, [(1, 9), (2, 9), (1, 8), (2, 8)])).collect()] == [(1, 2, 2)]


def test_iterations(spark):
    df = spark.createDataFrame([(1, 0)], "id int, v int")
    assert G.bulk_iterate(df, lambda d: d.withColumn("v", F.col("v") + 1), 5).first().v == 5
    step = lambda s, w: w.where("v < 3").withColumn("v", F.col("v") + 1)
    assert G.delta_iterate(df, df, "id", step, 10).first().v == 3


def test_dialect_rewrites():
    text = dialect.rewrite("SELECT HOP_END(ts, INTERVAL '1' MINUTE, INTERVAL '1' HOUR) FROM e GROUP BY HOP(ts, INTERVAL '1' MINUTE, INTERVAL '1' HOUR)")
    assert "window.end" in text and "window(ts, '1 hour', '1 minute')" in text
    assert "session_window(ts, '5 minute')" in dialect.rewrite("SELECT 1 FROM e GROUP BY SESSION(ts, INTERVAL '5' MINUTE)")


def test_scalar_edges(spark):
    one = spark.range(1)
    r = one.select(S.lpad(F.lit("abc"), -1, "x").alias("a"), S.lpad(F.lit("abc"), 2, "x").alias("b"), S.int_divide(F.lit(-7), F.lit(2)).alias("c"), S.at(F.array(F.lit(1)), 5).alias("d"), S.element(F.array(F.lit(3))).alias("e")).first()
    assert tuple(r) == (None, "ab", -3, None, 3)
    with pytest.raises(Exception, match="positive"):
        one.select(S.log(F.lit(2.0), F.lit(0.0))).collect()
    with pytest.raises(ValueError):
        S.date_format(F.lit("x"), "%U")
    d = one.select(S.date_format(F.expr("TIMESTAMP_NTZ'2024-12-30 05:06:07'"), "%x-W%v %Y/%c/%e")).first()[0]
    assert d == "2025-W01 2024/12/30"


def test_validation(spark):
    stream = spark.readStream.format("rate").load()
    for op in ("intersect", "minus", "union_distinct", "distinct_aggregate"):
        with pytest.raises(validation.UnsupportedStreamingOp):
            validation.check(op, stream)
    validation.check("intersect", spark.range(1))
    with pytest.raises(validation.InvalidQuery):
        validation.check_limit(False, strict=True)
    with pytest.raises(validation.UnsupportedStreamingOp):
        validation.check_stream_sort([("v", True)], "ts")
    with pytest.raises(validation.InvalidQuery):
        validation.check_set_operation(spark.range(1), spark.range(1).select(F.col("id").cast("string")))


def E(n, t):
    return {"id": n, "type": t, "t": float(n)}


def names(runs):
    return sorted(tuple(e["id"] for v in r.events.values() for e in v) for r in runs)


def test_cep_follow_kinds():
    a, b = (lambda e: e["type"] == "a"), (lambda e: e["type"] == "b")
    events = [E(1, "a"), E(2, "c"), E(3, "b"), E(4, "b")]
    strict = cep.Pattern.begin("x").where(a).next("y").where(b)
    relaxed = cep.Pattern.begin("x").where(a).followed_by("y").where(b)
    every = cep.Pattern.begin("x").where(a).followed_by_any("y").where(b)
    assert names(cep.find(strict, events, "t")[0]) == []
    assert names(cep.find(relaxed, events, "t")[0]) == [(1, 3)]
    assert names(cep.find(every, events, "t")[0]) == [(1, 3), (1, 4)]


def test_cep_quantifiers_negation_time_and_skip():
    a, b, c = ((lambda e, k=k: e["type"] == k) for k in "abc")
    a, b, c = (lambda e: e["type"] == "a"), (lambda e: e["type"] == "b"), (lambda e: e["type"] == "c")
    events = [E(1, "a"), E(2, "a"), E(3, "b")]
    twice = cep.Pattern.begin("x").where(a).times(2).followed_by("y").where(b)
    assert names(cep.find(twice, events, "t")[0]) == [(1, 2, 3)]
    no_c = cep.Pattern.begin("x").where(a).not_followed_by("n").where(c).followed_by("y").where(b)
    assert names(cep.find(no_c, [E(1, "a"), E(2, "c"), E(3, "b")], "t")[0]) == []
    assert names(cep.find(no_c, [E(1, "a"), E(3, "b")], "t")[0]) == [(1, 3)]
    slow = cep.Pattern.begin("x").where(a).followed_by("y").where(b).within(2)
    matches, late = cep.find(slow, [E(1, "a"), E(5, "b")], "t")
    assert names(matches) == [] and names(late) == [(1,)]
    past = cep.Pattern.begin("x").where(a).followed_by("y").where(b).after_match("skip_past_last_event")
    assert names(cep.find(past, events, "t")[0]) == [(1, 3)]
    with pytest.raises(ValueError):
        cep.find(cep.Pattern.begin("x").not_followed_by("y"), [], "t")
    maybe = cep.Pattern.begin("x").where(a).next("m").where(c).optional().next("y").where(b)
    assert names(cep.find(maybe, [E(1, "a"), E(2, "b")], "t")[0]) == [(1, 2)]


def test_time_sort_and_changelog_on_a_stream(spark, tmp_path):
    rows = [("k", i, float(i), t) for i, t in enumerate(["2024-01-01 00:00:03", "2024-01-01 00:00:01", "2024-01-01 00:00:02"])]
    spark.createDataFrame(rows, "key string, id long, v double, ts string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, id long, v double, ts string").parquet(str(tmp_path / "in"))
    got = W.run_to_end(stateful.time_sort(stream, "key", "ts", "id", "v", "0 seconds")).orderBy("ms").collect()
    assert [(r.id, r.pos) for r in got] == [(1, 1), (2, 2), (0, 3)]
    log = W.run_to_end(stateful.retracting_aggregate(stream, "key", "v"))
    assert [tuple(r) for r in stateful.materialize(log).select("n", "s").collect()] == [(3, 3.0)]


def test_sources_and_sinks(spark, tmp_path):
    with pytest.raises(ValueError):
        C.Source("kafka").validate()
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    C.write_csv(df, str(tmp_path / "csv"), sep="|", files=1)
    assert C.read_csv(spark, str(tmp_path / "csv"), "a int, b string", sep="|").orderBy("a").collect() == df.orderBy("a").collect()
    spark.sql("CREATE TABLE IF NOT EXISTS lattica_t (a INT, b STRING) USING parquet LOCATION '" + str(tmp_path / "t") + "'")
    C.insert_into(spark, df, "lattica_t")
    assert spark.table("lattica_t").count() == 2
    with pytest.raises(ValueError):
        C.insert_into(spark, df.select("a"), "lattica_t")
    spark.sql("DROP TABLE lattica_t")
    spark.dataSource.register(C.SequenceSource)
    stream = spark.readStream.format("sequence").options(**{"from": "1", "to": "10", "perBatch": "4"}).load()
    assert stream.isStreaming


def test_ml(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "vec_id long, embedding array<double>")
    near = {(r.query_id, r.neighbor_id) for r in ml.knn(df, df.where("vec_id = 5"), 3).collect()}
    assert near == {(5, 5), (5, 4), (5, 6)}
    m = spark.createDataFrame([(0, 0, 2.0), (0, 1, 1.0)], "row int, col int, value double")
    assert {tuple(r) for r in ml.matrix_add(m, m, -1).collect()} == {(0, 0, 0.0), (0, 1, 0.0)}
    assert ml.tug_of_war(spark.range(100).select((F.col("id") % 5).alias("x")), "x", 256).first()[0] == pytest.approx(2000, rel=0.5)
    train, test = ml.holdout(df, "vec_id", 30)
    assert train.count() + test.count() == 20
    out = ml.stochastic_outliers(spark.createDataFrame([(0, [0.0]), (1, [0.1]), (2, [9.0])], "id long, v array<double>"), "v", "id").collect()
    assert max(out, key=lambda r: r.outlier_probability).id == 2


def test_relational(spark):
    df = spark.createDataFrame([(1, 2.0), (1, float("nan")), (2, None)], "k int, x double")
    s = {r["column"]: r for r in R.summarize(df).collect()}
    assert (s["x"].n, s["x"].nulls, s["x"].nans, s["x"].max) == (2, 1, 1, 2.0)
    assert [r["index"] for r in R.zip_with_index(spark.range(10).repartition(3)).orderBy("index").collect()] == list(range(10))
    assert R.checksum(df).first() == R.checksum(df.repartition(2)).first()
    assert cut(df).count() == 3
    assert R.fixed_size_sample(spark.range(100), 7).count() == 7
    assert "Window" in R.top_k(df, ["k"], [F.col("x")], 1)._jdf.queryExecution().optimizedPlan().toString()


def test_filter_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_quantity > 45").select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in plan and "l_comment" not in plan


def test_cli(spark):
    spark.range(3).createOrReplaceTempView("lattica_cli")
    c = Client(spark)
    assert c.run("SELECT count(*) AS n FROM lattica_cli;") == "n\n3"
    assert c.run("DESCRIBE lattica_cli") == "id bigint"
    assert c.run("QUIT") is None
    assert "Range" in c.run("EXPLAIN SELECT * FROM lattica_cli")
    assert c.run("SET spark.sql.shuffle.partitions=4")
    assert c.run("RESET") == "reset"


def test_components_spread_the_links_of_a_hub(spark, monkeypatch):
    from lattica.operators import components

    n = 100_000
    star = spark.range(1, n + 1, 1, 4).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    placed = components.with_least(star, 256).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(placed) == 4 and max(r["count"] for r in placed) <= n / 4
    high = star.select(F.col("dst").alias("src"), F.lit(n + 7).cast("long").alias("dst"))  # the hub has the largest id
    got = G.connected_components(high.union(spark.createDataFrame([(n + 50, n + 51)], "src long, dst long")))
    assert got.where("component = 1").count() == n + 1 and got.where(f"component = {n + 50}").count() == 2
    monkeypatch.setattr(components, "LEAST_HUB", 2)
    chain = edges(spark, [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(9)])
    assert dict(G.connected_components(chain).collect()) == {i: 0 for i in range(61)} | {200 + i: 200 for i in range(9)}


def batch(spark, tmp_path, rows, schema, files=1):
    """A stream of rows, in so many files that come one after the other."""
    import uuid

    path = str(tmp_path / uuid.uuid4().hex)
    step = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * step : (i + 1) * step], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_words_are_counted_again_when_a_count_is_taken_back(spark, tmp_path):
    """Words by their number of occurrences: as a word's count grows it leaves the lower count."""
    words = "hello hello hello world world flag state state state state".split()
    log = W.run_to_end(stateful.retracting_aggregates(batch(spark, tmp_path, [(w, 1.0) for w in words], "word string, num double"), "word", "num"))
    assert {tuple(r) for r in stateful.materialize(log.select("key", "n", "_op")).collect()} == {("hello", 3), ("world", 2), ("flag", 1), ("state", 4)}
    changes = [(r.n, 1.0, r._op) for r in log.collect()]
    second = W.run_to_end(stateful.retracting_aggregates(batch(spark, tmp_path, changes, "n long, one double, _op int"), "n", "one"))
    assert {tuple(r) for r in stateful.materialize(second.select("key", "n", "_op")).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1)}


def test_extremes_and_distinct_values_survive_retraction(spark, tmp_path):
    rows = [("a", 5.0, 1), ("a", 9.0, 1), ("a", 1.0, 1), ("a", 9.0, 1), ("a", None, 1), ("a", 1.0, -1), ("a", 9.0, -1), ("b", 2.0, 1), ("b", 2.0, -1), ("c", 7.0, -1), ("c", 7.0, 1), ("c", 8.0, 1)]
    for files in (1, 4):
        log = W.run_to_end(stateful.retracting_aggregates(batch(spark, tmp_path, rows, "k string, v double, _op int", files), "k", "v"))
        got = {r.key: (r.n, r.c, r.s, r.lo, r.hi, r.d) for r in stateful.materialize(log).collect()}
        assert got == {"a": (3, 2, 14.0, 5.0, 9.0, 2), "c": (1, 1, 8.0, 8.0, 8.0, 1)}


def test_streams_agree_with_their_batch_twins_on_nulls(spark, tmp_path):
    rows = [("k", i, v, f"2024-01-01 00:00:{i:02d}") for i, v in enumerate([1.0, None, 3.0, None, None, 2.0])]
    schema = "k string, id long, v double, ts string"
    table = spark.createDataFrame(rows, schema)
    for make in (lambda d: stateful.over_rows(d, "k", "ts", "id", "v", 1), lambda d: stateful.count_windows(d, "k", "ts", "id", "v", 2), lambda d: stateful.rolling_aggregate(d, "k", "ts", "id", "v")):
        want = sorted(tuple(r) for r in make(table).select(*make(table).columns).collect())
        assert sorted((tuple(r) for r in W.run_to_end(make(batch(spark, tmp_path, rows, schema))).collect()), key=repr) == sorted(want, key=repr)


def test_state_that_is_not_touched_expires(spark, tmp_path):
    import time

    schema = "k string, v double"
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    seen = []
    for i in range(2):
        spark.createDataFrame([("a", float(i))], schema).write.mode("append").parquet(path)
        log = stateful.retracting_aggregates(spark.readStream.schema(schema).parquet(path), "k", "v", ttl_ms=1)
        log.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start().awaitTermination()
        time.sleep(0.2)
        seen = sorted(r.n for r in spark.read.parquet(out).where("_op = 1").collect())
    assert seen == [1, 1]


def test_patterns_go_on_over_micro_batches(spark, tmp_path):
    rows = [(1, i, t, f"2024-01-01 00:0{i}:00") for i, t in enumerate("abcab")]
    stream = batch(spark, tmp_path, rows, "u long, id long, t string, ts string", files=5)
    p = cep.Pattern.begin("x").where(lambda e: e["t"] == "a").followed_by("y").where(lambda e: e["t"] == "b")
    got = W.run_to_end(cep.match_stream(stream, p, "u", "ts", "id", lambda m: (m["x"][0]["id"], m["y"][0]["id"]), "a long, b long"))
    assert sorted(tuple(r) for r in got.collect()) == [(0, 1), (3, 4)]


def test_ranks_and_communities_of_small_graphs(spark):
    """Ranks by solving the linear system; two dense groups with one link between them are two communities."""
    import numpy as np

    pairs = [(1, 2), (1, 3), (2, 3), (3, 1), (3, 4), (4, 5), (5, 3)]
    n = 5
    m = np.zeros((n, n))
    for s, d in pairs:
        m[d - 1, s - 1] = 1 / sum(a == s for a, _ in pairs)
    want = np.linalg.solve(np.eye(n) - 0.85 * m, np.full(n, 0.15 / n))
    got = dict(G.pagerank(edges(spark, pairs), steps=60).collect())
    assert all(abs(got[i + 1] - want[i]) < 1e-4 for i in range(n))
    groups = [(a, b) for g in ((1, 2, 3, 4), (11, 12, 13, 14)) for a in g for b in g if a < b] + [(4, 11)]
    labels = {r.id: r.label for r in G.community_detection(edges(spark, groups), 5, 0.5).collect()}
    assert len({labels[i] for i in (1, 2, 3)}) == 1 and len({labels[i] for i in (12, 13, 14)}) == 1 and labels[1] != labels[14]


def test_bloom_filter_holds_all_and_few_others(spark):
    held = spark.range(20_000).select((F.col("id") * 7).alias("k"))
    bloom = ml.bloom_filter(held, "k", rate=0.01)
    assert ml.might_contain(held, "k", bloom).where("NOT maybe").count() == 0
    assert ml.might_contain(spark.range(20_000).select((-1 - F.col("id")).alias("k")), "k", bloom).where("maybe").count() < 400
    assert ml.might_contain(held, "k", ml.bloom_filter(held.where("k < 0"), "k")).where("maybe").count() == 0


def test_iterations_that_do_not_end_raise(spark):
    ring = edges(spark, [(1, 2), (2, 3), (3, 1)]).withColumn("value", F.lit(-1.0))
    with pytest.raises(RuntimeError, match="still change"):
        G.sssp(ring, 1, max_steps=4)


def test_queries_over_streams_are_checked(spark):
    stream, table = spark.readStream.format("rate").load(), spark.range(3).withColumnRenamed("id", "value")
    for text in ("SELECT value FROM v INTERSECT SELECT value FROM v", "SELECT value FROM v UNION SELECT value FROM v", "SELECT count(DISTINCT value) FROM v", "SELECT value FROM v LIMIT 3", "SELECT value FROM v WHERE value IN (SELECT value FROM v)", "SELECT count(*) FROM v GROUP BY CUBE (value)"):
        with pytest.raises(validation.UnsupportedStreamingOp):
            dialect.sql(spark, text, v=stream)
        dialect.sql(spark, text, v=table)
    assert dialect.operations("SELECT 'UNION LIMIT' AS x FROM v UNION ALL SELECT 'a' FROM v") == set()
    assert dialect.sql(spark, "SELECT value FROM v UNION ALL SELECT value FROM v", v=stream).isStreaming


def test_scratch_deletes_what_is_not_kept(spark):
    from lattica.plans.lineage import cut, scratch

    with scratch(spark):
        inner = cut(spark.range(5))
        kept = cut(inner.selectExpr("id + 1 AS id"), keep=True)
        path = inner.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert kept.count() == 5 and not os.path.exists(path)


def test_rows_and_queries_meet_in_blocks(spark):
    a, b = spark.range(50).withColumnRenamed("id", "x"), spark.range(7).withColumnRenamed("id", "y")
    got = ml.in_blocks(a, b, block=2)
    assert got.count() == 350 and got.distinct().count() == 350
    assert ml.in_blocks(a.limit(0), b).count() == 0


def test_reduce_by_a_function_of_two_rows(spark, monkeypatch):
    rows = [(None if n % 7 == 0 else n % 5, float(n), f"t{n % 3}") for n in range(200)]
    frame = spark.createDataFrame(rows, "k long, v double, t string").repartition(6)
    combine = lambda a, b: {"v": a["v"] + b["v"], "t": max(a["t"], b["t"])}
    want = {k: (sum(v for k2, v, _ in rows if k2 == k), "t2") for k in {k for k, _, _ in rows}}
    for most in (100_000, 1):
        monkeypatch.setattr(R, "REDUCED", most)
        assert {r.k: (r.v, r.t) for r in R.reduce_rows(frame, "k", combine).collect()} == want
    assert R.reduce_rows(frame.limit(0), "k", combine).collect() == []


def test_components_merge_before_stars_turn(spark, monkeypatch):
    """A dense graph with a hub shrinks to nothing by merging; ids may be strings, and chains are left to the stars."""
    from lattica.operators import components

    stars, least = [], components.with_least
    monkeypatch.setattr(components, "with_least", lambda *a: stars.append(1) or least(*a))
    links = spark.range(4000).selectExpr("5 + id AS src", "-1 - pmod(xxhash64(id), 40) AS dst").union(spark.range(600).selectExpr("7 AS src", "-100 - id AS dst")).union(spark.range(1).selectExpr("9000L", "9000L"))
    got = dict(G.connected_components(links).collect())
    whole = {i for i in range(5, 4005)} | {-1 - i for i in range(40)} | {-100 - i for i in range(600)}
    edges_ = [tuple(r) for r in links.collect()]
    up = {v: v for e in edges_ for v in e}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in edges_:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    assert whole <= set(got) and got == {v: root(v) for v in up} and not stars
    named = spark.createDataFrame([("b", "a"), ("b", "c"), ("x", "y")], "src string, dst string")
    assert dict(G.connected_components(named).collect()) == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
