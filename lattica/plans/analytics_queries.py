"""Queries of directed graphs, feedback streams, acknowledged sources, sketches by time and sharded learning."""

from __future__ import annotations

import pandas as pd
from pyspark import SparkFiles
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.operators import directed, graph, ml, outliers, pipelines, relational, sharded, sketches
from lattica.plans.frame_queries import _scratch, query
from lattica.session import read_table, stream_table
from lattica.sources import ack_source, connectors
from lattica.streaming import learning, supervise, windows as W


# directed graphs
_STEPS = "e AS MATERIALIZED (SELECT DISTINCT x.user_id AS src, y.user_id AS dst FROM events x JOIN events y ON y.event_id = x.event_id + 1)"
_PAIRS = "p AS MATERIALIZED (SELECT src, dst, bit_or(bit) AS code FROM (SELECT src, dst, 1 AS bit FROM e WHERE src <> dst UNION ALL SELECT dst, src, 2 FROM e WHERE src <> dst) GROUP BY ALL)"


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each event's user to the next event's."""
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id")
    following = e.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("dst"))
    return e.join(following, "event_id").select(F.col("user_id").alias("src"), "dst")


@query(f"""WITH {_STEPS}, {_PAIRS}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
t AS (SELECT a.id AS a, b.id AS b, c.id AS c, coalesce(ab.code, 0) AS ab, coalesce(ac.code, 0) AS ac, coalesce(bc.code, 0) AS bc FROM v a JOIN v b ON a.id < b.id JOIN v c ON b.id < c.id
  LEFT JOIN p ab ON ab.src = a.id AND ab.dst = b.id LEFT JOIN p ac ON ac.src = a.id AND ac.dst = c.id LEFT JOIN p bc ON bc.src = b.id AND bc.dst = c.id),
codes AS (SELECT ab, ac, bc, count(*) AS n FROM t GROUP BY ALL),
k AS (SELECT *, (ab = 3)::INT + (ac = 3)::INT + (bc = 3)::INT AS m, (ab IN (1, 2))::INT + (ac IN (1, 2))::INT + (bc IN (1, 2))::INT AS s,
  [(ab = 1)::INT + (ac = 1)::INT, (ab = 2)::INT + (bc = 1)::INT, (ac = 2)::INT + (bc = 2)::INT] AS outs, [(ab = 2)::INT + (ac = 2)::INT, (ab = 1)::INT + (bc = 2)::INT, (ac = 1)::INT + (bc = 1)::INT] AS ins,
  [(ab = 3)::INT + (ac = 3)::INT, (ab = 3)::INT + (bc = 3)::INT, (ac = 3)::INT + (bc = 3)::INT] AS tied FROM codes),
named AS (SELECT n, m || '' || s || '' || (3 - m - s) || CASE WHEN (m, s) IN ((0, 2), (1, 2)) THEN CASE WHEN list_max(outs) = 2 THEN 'D' WHEN list_max(ins) = 2 THEN 'U' ELSE 'C' END
  WHEN (m, s) = (1, 1) THEN CASE WHEN tied[list_position(ins, 1)] = 1 THEN 'D' ELSE 'U' END WHEN (m, s) = (0, 3) THEN CASE WHEN list_max(outs) = 2 THEN 'T' ELSE 'C' END ELSE '' END AS type FROM k),
types AS (SELECT unnest(['{"', '".join(directed.TRIADS)}']) AS type)
SELECT types.type, coalesce(sum(n), 0)::BIGINT AS n FROM types LEFT JOIN named USING (type) GROUP BY ALL""")
def g12_triadic_census(spark, sf_dir):
    """The sixteen types over the users' successions; the twin names every triple of users."""
    return directed.triadic_census(_steps(spark, sf_dir)).select("type", F.col("n").cast("long").alias("n"))


@query(f"""WITH {_STEPS}, {_PAIRS}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), d AS (SELECT src AS id, count(*) AS degree FROM p GROUP BY 1),
l AS (SELECT x.src AS id, count(*) AS links FROM p x JOIN p y ON x.src = y.src JOIN p z ON z.src = x.dst AND z.dst = y.dst AND z.code <> 2 GROUP BY 1)
SELECT id, coalesce(degree, 0) AS degree, coalesce(links, 0) AS links, round(CASE WHEN degree > 1 THEN coalesce(links, 0) / (degree * (degree - 1)) ELSE 0.0 END, 9) AS local FROM v LEFT JOIN d USING (id) LEFT JOIN l USING (id)""")
def g11_directed_clustering(spark, sf_dir):
    return directed.clustering(_steps(spark, sf_dir)).withColumn("local", F.round("local", 9))


@query(f"""WITH {_STEPS}, {_PAIRS}, d AS (SELECT src AS id, count(*) AS degree FROM p GROUP BY 1), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
c AS (SELECT x.src AS id, count(*) AS closed, sum(CASE WHEN z.code <> 2 THEN 1 ELSE 0 END) AS links FROM p x JOIN p y ON x.src = y.src JOIN p z ON z.src = x.dst AND z.dst = y.dst GROUP BY 1)
SELECT (sum(degree * (degree - 1)) // 2)::BIGINT AS triplets, (sum(closed) // 2)::BIGINT AS closed, round(sum(closed) / sum(degree * (degree - 1)), 9) AS global_coefficient,
  round(avg(CASE WHEN degree > 1 THEN coalesce(links, 0) / (degree * (degree - 1)) ELSE 0.0 END), 9) AS average_coefficient FROM v LEFT JOIN d USING (id) LEFT JOIN c USING (id)""")
def g11_directed_global(spark, sf_dir):
    g = directed.global_clustering(_steps(spark, sf_dir))
    return g.select("triplets", "closed", F.round("global_coefficient", 9).alias("global_coefficient"), F.round("average_coefficient", 9).alias("average_coefficient"))


def _community_twin(steps: int, delta: float) -> str:
    """The rounds written out: scores that decay as they travel, the label of the largest sum wins."""
    sql = "WITH links AS MATERIALIZED (SELECT DISTINCT user_id AS src, -1 - hour(ts) AS dst FROM events), b AS MATERIALIZED (SELECT src, dst FROM links UNION ALL SELECT dst, src FROM links), s0 AS (SELECT DISTINCT src AS id, src AS label, 1.0::DOUBLE AS score FROM b)"
    for i in range(1, steps + 1):
        sql += f""", t{i} AS (SELECT b.src, label, round(sum(score), 6) AS total, max(score) AS best FROM b JOIN s{i - 1} s ON s.id = b.dst GROUP BY ALL),
w{i} AS (SELECT * FROM t{i} QUALIFY row_number() OVER (PARTITION BY src ORDER BY total DESC, label DESC) = 1),
s{i} AS MATERIALIZED (SELECT w.src AS id, w.label, CASE WHEN w.label = o.label THEN best ELSE best - {delta} / {i} END AS score FROM w{i} w JOIN s{i - 1} o ON o.id = w.src)"""
    return sql + f" SELECT id, label, round(score, 6) AS score FROM s{steps}"


@query(_community_twin(4, 0.5))
def g10_community_detection(spark, sf_dir):
    """Communities of users and the hours in which they are active."""
    edges = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("src"), (-1 - F.hour("ts")).cast("long").alias("dst")).distinct()
    return graph.community_detection(edges, 4, 0.5).withColumn("score", F.round("score", 6))


# sharded learning
def _ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user"), F.substring("o_orderpriority", 1, 1).cast("long").alias("item"), (F.col("o_totalprice") / 100000).alias("rating"))


@query("SELECT count(*) AS n, true AS close FROM orders")
def g26_matrix_factorization(spark, sf_dir):
    """Customers by priorities: the error over all orders is at most 5 % above that of alternating least squares of the same rank."""
    r = _ratings(spark, sf_dir)
    model = sharded.factorize(r, "user", "item", "rating", rank=4, epochs=10, blocks=3, rate=0.2, l2=0.01)
    error = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("rating"), 2))).alias("e"))
    ours = error(sharded.predict_ratings(r, model, "user", "item"))
    theirs = error(ml.als(r.selectExpr("cast(user as int) user", "cast(item as int) item", "cast(rating as float) rating"), "user", "item", "rating", rank=4, steps=5)).select(F.col("e").alias("a"))
    return ours.crossJoin(theirs).select("n", (F.col("e") <= 1.05 * F.col("a")).alias("close"))  # one row each


@query("SELECT o_custkey AS user, rank, true AS same FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 100 = 0), (SELECT unnest([1, 2, 3]) AS rank)")
def g26_best_items(spark, sf_dir):
    """The three best items of every hundredth customer, from blocks, against all pairs."""
    model = sharded.factorize(_ratings(spark, sf_dir), "user", "item", "rating", rank=4, epochs=1, blocks=3)
    users = model.users.where("id % 100 = 0").select("id")
    found = sharded.best_items(model, users, 3).select("user", "rank", "item")
    pairs = users.select(F.col("id").alias("user")).crossJoin(model.items.select(F.col("id").alias("item")))
    by = Window.partitionBy("user").orderBy(F.desc("prediction"), "item")
    every = sharded.predict_ratings(pairs, model, "user", "item").withColumn("rank", F.row_number().over(by)).where("rank <= 3").select("user", "rank", F.col("item").alias("other"))
    return found.join(every, ["user", "rank"], "full").select("user", "rank", F.col("item").eqNullSafe(F.col("other")).alias("same"))


_C = 0.1


def _shipped(orders: DataFrame) -> DataFrame:
    """Orders as examples of the label fulfilled (1) or not (-1), in four shards."""
    age = (F.year("o_orderdate") - 1995) / 3.0
    return orders.where("o_totalprice is not null and o_orderdate is not null and o_orderstatus is not null").select((F.col("o_orderkey") % 4).alias("shard"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "1").otherwise("-1").alias("label"),
        F.create_map(F.lit("bias"), F.lit(1.0), F.lit("price"), F.col("o_totalprice") / 200000, F.lit("age"), age).alias("features"), (F.floor(F.col("o_orderkey") / 4) % 3).alias("part"))


_EXAMPLES = "x AS MATERIALIZED (SELECT o_orderkey AS id, o_orderkey % 4 AS shard, o_orderkey // 4 % 3 AS part, o_totalprice / 200000 AS p, (year(o_orderdate) - 1995) / 3.0 AS g, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE -1.0 END AS y FROM orders WHERE o_totalprice IS NOT NULL AND o_orderdate IS NOT NULL AND o_orderstatus IS NOT NULL)"


def _fold(step: int, where: str = "") -> str:
    """One round of mixing in SQL: each shard's examples folded in order from the weights m(step - 1), then the mean by their number."""
    tau = f"(CASE WHEN 1 - e.y * (a.w0 + a.w1 * e.p + a.w2 * e.g) > 0 THEN least({_C}, (1 - e.y * (a.w0 + a.w1 * e.p + a.w2 * e.g)) / (1 + e.p * e.p + e.g * e.g)) ELSE 0 END * e.y)"
    return f""", l{step} AS (SELECT shard, count(*) AS n, list({{'w0': 0::DOUBLE, 'w1': 0::DOUBLE, 'w2': 0::DOUBLE, 'p': p::DOUBLE, 'g': g::DOUBLE, 'y': y::DOUBLE}} ORDER BY id) AS xs FROM x {where} GROUP BY shard),
f{step} AS (SELECT n, list_reduce(list_prepend({{'w0': m.w0, 'w1': m.w1, 'w2': m.w2, 'p': 0::DOUBLE, 'g': 0::DOUBLE, 'y': 0::DOUBLE}}, xs), lambda a, e: {{'w0': a.w0 + {tau}, 'w1': a.w1 + {tau} * e.p, 'w2': a.w2 + {tau} * e.g, 'p': 0::DOUBLE, 'g': 0::DOUBLE, 'y': 0::DOUBLE}}) AS w FROM l{step}, m{step - 1} m),
m{step} AS MATERIALIZED (SELECT sum(w.w0 * n) / sum(n) AS w0, sum(w.w1 * n) / sum(n) AS w1, sum(w.w2 * n) / sum(n) AS w2 FROM f{step})"""


_M0 = "m0 AS (SELECT 0::DOUBLE AS w0, 0::DOUBLE AS w1, 0::DOUBLE AS w2)"


@query(f"WITH {_EXAMPLES}, {_M0}{_fold(1)}{_fold(2)} SELECT unnest(['bias', 'price', 'age']) AS feature, round(unnest([w0, w1, w2]), 6) AS w FROM m2")
def g26_passive_aggressive(spark, sf_dir):
    """Two rounds over all orders in four shards; the twin folds each shard in SQL."""
    model = sharded.mixed(_shipped(read_table(spark, sf_dir, "orders")), sharded.passive_aggressive(_C), 2)
    return model.select("feature", F.round(F.col("w")[0], 6).alias("w"))


@query("SELECT o_orderpriority AS kind, count(*) AS n, true AS accurate FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1")
def g26_factorization_machine(spark, sf_dir):
    """Whether an order's key and its customer's are both odd or both even, from features that tell it together only; held-out orders."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    one = F.lit(1.0)
    features = F.create_map(F.concat(F.lit("order="), F.col("o_orderkey") % 2), one, F.concat(F.lit("customer="), F.col("o_custkey") % 2), one, F.concat(F.lit("priority="), F.col("o_orderpriority")), one)
    rows = o.select(F.pmod(F.xxhash64("o_orderkey"), F.lit(4)).alias("shard"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == F.col("o_custkey") % 2, "1").otherwise("-1").alias("label"), features.alias("features"), "o_orderpriority")
    model = sharded.mixed(rows.where("id % 5 <> 0"), sharded.factorization_machine(4, 0.2, 0.0005), 3)
    scored = sharded.scores(rows.where("id % 5 = 0"), model, machine=True).join(rows.select("id", "label", "o_orderpriority"), "id")
    right = F.avg(((F.col("scores")[0] > 0) == (F.col("label") == "1")).cast("double"))
    return scored.groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count(F.lit(1)).alias("n"), (right > 0.9).alias("accurate"))


@query(f"WITH {_EXAMPLES}, {_M0}{_fold(1, 'WHERE part = 0')}{_fold(2, 'WHERE part = 1')} " + " UNION ALL ".join(f"SELECT id, {k}::BIGINT AS batch, round({'w0 + w1 * p + w2 * g' if k else 'NULL::DOUBLE'}, 6) AS score FROM x, m{k} WHERE part = {k}" for k in range(3)))
def g28_streaming_classifier(spark, sf_dir):
    """Orders come in three batches; each is scored by what the batches before have taught, and then taught."""
    base, rows = _scratch(spark), _shipped(read_table(spark, sf_dir, "orders"))
    schema, out = rows.drop("part").schema, None
    for part in range(3):
        rows.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{base}/in")
        out = learning.learn(spark.readStream.schema(schema).parquet(f"{base}/in"), sharded.passive_aggressive(_C), base)
    return out.select("id", F.col("batch").cast("long").alias("batch"), F.round(F.get("scores", F.lit(0)), 6).alias("score"))


@query(f"WITH {_EXAMPLES}, {_M0}{_fold(1, 'WHERE part = 0')}{_fold(2, 'WHERE part = 1')} SELECT id, v AS version, round(CASE v WHEN 1 THEN m1.w0 + m1.w1 * p + m1.w2 * g ELSE m2.w0 + m2.w1 * p + m2.w2 * g END, 6) AS score FROM x, m1, m2, (SELECT unnest([1, 2])::BIGINT AS v)")
def g28_versioned_predictions(spark, sf_dir):
    """A second stream of all orders asks for the model after the first and after the second batch."""
    base, rows = _scratch(spark), _shipped(read_table(spark, sf_dir, "orders"))
    for part in range(2):
        rows.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{base}/in")
        learning.learn(spark.readStream.schema(rows.drop("part").schema).parquet(f"{base}/in"), sharded.passive_aggressive(_C), base)
    asked = _shipped(stream_table(spark, sf_dir, "orders")).withColumn("version", F.explode(F.array(F.lit(1), F.lit(2))))
    asked.writeStream.foreachBatch(lambda batch, n: learning.predict(batch, base).write.mode("overwrite").parquet(f"{base}/asked/batch={n}")).option("checkpointLocation", f"{base}/asking").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/asked").select("id", "version", F.round(F.col("scores")[0], 6).alias("score"))


# feedback, acknowledgement
@query("WITH RECURSIVE r AS (SELECT event_id, value, 0 AS steps FROM events UNION ALL SELECT event_id, value / 2, steps + 1 FROM r WHERE value >= 1) SELECT event_id, steps, value FROM r WHERE value < 1 OR value IS NULL")
def s18_feedback(spark, sf_dir):
    """Values are halved and sent back until they are under one."""
    start = read_table(spark, sf_dir, "events").select("event_id", "value", F.lit(0).alias("steps"))
    done = F.coalesce(F.col("value") < 1, F.lit(True))
    step = lambda batch: (batch.where(done), batch.where(~done).select("event_id", (F.col("value") / 2).alias("value"), (F.col("steps") + 1).alias("steps")))
    return supervise.feedback(start, step, _scratch(spark)).select("event_id", "steps", "value")


@query("SELECT event_id, user_id FROM events")
def a26_acknowledged_source(spark, sf_dir):
    """Each tenth message is sent twice; each comes once, and all are acknowledged but those of the last batch."""
    path = _scratch(spark)
    sent = read_table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    sent.unionByName(sent.where("event_id % 10 = 0")).repartition(8).write.json(f"{path}/pending")
    return W.run_to_end(ack_source.read_once(spark, path, sent.schema, "event_id", "us", "60 days", 3).select("event_id", "user_id"), drain=True)


# sketches by time
@query("SELECT strftime(d, '%Y-%m-%d') AS upto, true AS near FROM (SELECT DISTINCT date_trunc('day', ts) AS d FROM events)")
def g27_time_aware_moments(spark, sf_dir):
    """The second moment of user_id over the week that ends with each day, from day slices, within 4 / sqrt(64) of the exact one."""
    e = sketches.slices(read_table(spark, sf_dir, "events"), "ts", "1 day")
    ranges = e.select(F.col("slice").alias("day")).distinct().select(F.date_format("day", "yyyy-MM-dd").alias("range"), (F.col("day") - F.expr("INTERVAL 6 DAYS")).alias("lo"), (F.col("day") + F.expr("INTERVAL 1 DAY")).alias("hi"))
    found = sketches.second_moment(sketches.tug_of_war(e, "user_id"), ranges)
    by_user = e.groupBy("slice", "user_id").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(ranges), (F.col("slice") >= F.col("lo")) & (F.col("slice") < F.col("hi"))).groupBy("range", "user_id").agg(F.sum("n").alias("n"))
    exact = by_user.groupBy("range").agg(F.sum(F.col("n") * F.col("n")).alias("exact"))
    return found.join(exact, "range").select(F.col("range").alias("upto"), (F.abs(F.col("f2") - F.col("exact")) <= F.col("exact") * 0.5).alias("near"))


@query("SELECT a.event_type AS a, b.event_type AS b, true AS near FROM (SELECT DISTINCT event_type FROM events) a JOIN (SELECT DISTINCT event_type FROM events) b ON a.event_type < b.event_type")
def g27_time_aware_minhash(spark, sf_dir):
    """How alike the users of two event types are in January's second week, within five standard errors of the exact share."""
    e = sketches.slices(read_table(spark, sf_dir, "events"), "ts", "1 day")
    lo, hi = F.lit("2024-01-08").cast("timestamp"), F.lit("2024-01-15").cast("timestamp")
    found = sketches.resemblance(sketches.minhash(e, "event_type", "user_id"), "event_type", lo, hi)
    users = e.where((F.col("slice") >= lo) & (F.col("slice") < hi)).groupBy("event_type").agg(F.collect_set("user_id").alias("users"))
    x, y = users.select(F.col("event_type").alias("a"), F.col("users").alias("x")), users.select(F.col("event_type").alias("b"), F.col("users").alias("y"))
    exact = x.join(y, F.col("a") < F.col("b")).select("a", "b", (F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("exact"))
    return found.join(exact, ["a", "b"]).select("a", "b", (F.abs(F.col("jaccard") - F.col("exact")) <= 5 * 0.5 / 256**0.5).alias("near"))


@query("SELECT vec_id, true AS valid, true AS same FROM embeddings WHERE vec_id % 100 = 0")
def g24_stochastic_outliers(spark, sf_dir):
    """Of every hundredth vector against all: the probability from large blocks, the same from small ones, within a millionth."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = e.where("vec_id % 100 = 0").select("vec_id")
    a, b = (outliers.stochastic_outliers(e, "embedding", "vec_id", 30.0, asked, block).withColumnRenamed("outlier_probability", name) for block, name in ((1024, "p"), (200, "q")))
    return a.join(b, "vec_id").select("vec_id", F.col("p").between(0, 1).alias("valid"), (F.abs(F.col("p") - F.col("q")) <= 1e-6).alias("same"))


# losses
def _descent(slope: str, steps: int, rate: float) -> str:
    """Gradient descent written out: one CTE a step."""
    sql = "WITH d AS MATERIALIZED (SELECT o_totalprice / 200000 AS x, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE -1.0 END::DOUBLE AS y FROM orders), g0 AS (SELECT 0::DOUBLE AS w, 0::DOUBLE AS b)"
    for k in range(1, steps + 1):
        sql += f", g{k} AS MATERIALIZED (SELECT w - {rate} / sqrt({k}) * avg({slope} * x) AS w, b - {rate} / sqrt({k}) * avg({slope}) AS b FROM d, g{k - 1} GROUP BY w, b)"
    return sql + f" SELECT 'x' AS name, round(w, 6) AS weight FROM g{steps} UNION ALL SELECT 'intercept', round(b, 6) FROM g{steps}"


def _fitted(spark: SparkSession, sf_dir: str, loss: str, steps: int, rate: float) -> DataFrame:
    rows = read_table(spark, sf_dir, "orders").select((F.col("o_totalprice") / 200000).alias("x"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(-1.0).alias("y"))
    w = ml.gradient_descent(rows, ["x"], "y", loss, steps, rate)
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in sorted(w.items())], "name string, weight double")


@query(_descent("(-y / (1 + exp(y * (w * x + b))))", 8, 0.5))
def g22_logistic(spark, sf_dir):
    return _fitted(spark, sf_dir, "logistic", 8, 0.5)


@query(_descent("(CASE WHEN y * (w * x + b) < 1 THEN -y ELSE 0 END)", 8, 0.1))
def g22_hinge(spark, sf_dir):
    """The loss of a support vector machine."""
    return _fitted(spark, sf_dir, "hinge", 8, 0.1)


@query("SELECT l_suppkey AS key, min(l_shipdate) AS first, max(l_quantity) AS most, CAST(sum(l_quantity) AS DOUBLE) AS total FROM lineitem GROUP BY 1")
def d20_general_reduce(spark, sf_dir):
    """A reduction by a function of two rows, combined in the tasks before the shuffle and after it again."""
    rows = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_shipdate").alias("first"), F.col("l_quantity").cast("double").alias("most"), F.col("l_quantity").cast("double").alias("total"))
    return relational.reduce_rows(rows, "key", lambda a, b: {"first": min(a["first"], b["first"]), "most": max(a["most"], b["most"]), "total": a["total"] + b["total"]})


# pipelines
def _pipeline_twin(steps: int, rate: float) -> str:
    """Scaled by the moments of the training orders, squared, and the descent written out."""
    slope = "(w1 * x + w2 * x * x + b - y)"
    sql = f"""WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS status, CAST(o_totalprice AS DOUBLE) AS p, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END::DOUBLE AS y, o_orderkey % 5 <> 0 AS teaches FROM orders WHERE o_totalprice IS NOT NULL),
k AS (SELECT avg(p) AS m, stddev_pop(p) AS d FROM o WHERE teaches), z AS MATERIALIZED (SELECT id, status, (p - m) / d AS x, y, teaches FROM o, k), d AS (SELECT * FROM z WHERE teaches), g0 AS (SELECT 0::DOUBLE AS w1, 0::DOUBLE AS w2, 0::DOUBLE AS b)"""
    for i in range(1, steps + 1):
        r = f"{rate} / sqrt({i})"
        sql += f", g{i} AS MATERIALIZED (SELECT w1 - {r} * avg({slope} * x) AS w1, w2 - {r} * avg({slope} * x * x) AS w2, b - {r} * avg({slope}) AS b FROM d, g{i - 1} GROUP BY w1, w2, b)"
    return sql + f" SELECT id, y AS truth, round(w1 * x + w2 * x * x + b, 6) AS prediction FROM z, g{steps} WHERE NOT teaches"


@query(_pipeline_twin(6, 0.2))
def g21_pipeline(spark, sf_dir):
    """Scaling, squares and regression as one pipeline, learned from four fifths of the orders and evaluated on the fifth."""
    o = read_table(spark, sf_dir, "orders").where("o_totalprice is not null")
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("x"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("y"))
    stages = [pipelines.Scaled(["x"]), pipelines.Powers("x", 2), pipelines.Descent(["x", "x_2"], "y", steps=6, rate=0.2)]
    model = Pipeline(stages=stages).fit(rows.where("id % 5 <> 0"))
    return model.transform(rows.where("id % 5 = 0")).select("id", F.col("y").alias("truth"), F.round("prediction", 6).alias("prediction"))


# cached files
@query("SELECT c_custkey, upper(n_name) AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def v16_distributed_cache(spark, sf_dir):
    """Customers with the name that a function looks up in a file that every node got once."""
    name = connectors.cached_file(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), 1000)

    def named(frames):
        held = pd.read_parquet(SparkFiles.get(name)).set_index("n_nationkey")["n_name"].str.upper()
        for frame in frames:
            frame["nation"] = frame.pop("c_nationkey").map(held).astype(object).where(lambda s: s.notna(), None)
            yield frame

    customers = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return customers.mapInPandas(named, f"c_custkey {customers.schema['c_custkey'].dataType.simpleString()}, nation string")


# generated graphs
_GRID = 16


@query(f"""WITH c AS (SELECT c_custkey AS id, c_acctbal AS bal FROM customer), n AS (SELECT max(id) + 1 AS n FROM c), v AS (SELECT unnest(range(n)) AS i, n FROM n), h AS (SELECT i, n, CAST(floor(log2(n)) AS INT) AS d FROM v),
e AS (SELECT 'path' AS kind, i AS src, i + unnest([-1, 1]) AS dst, n FROM v UNION ALL SELECT 'star', 0, i, n FROM v WHERE i > 0 UNION ALL SELECT 'star', i, 0, n FROM v WHERE i > 0
  UNION ALL SELECT 'circulant', i, (i + unnest([1, -1, 3, -3]) + n) % n, n FROM v UNION ALL SELECT 'pairs', i, xor(i, 1), n // 2 * 2 FROM v WHERE i < n // 2 * 2
  UNION ALL SELECT 'grid', i, i + unnest([-{_GRID}, {_GRID}]), n // {_GRID} * {_GRID} FROM v WHERE i < n // {_GRID} * {_GRID}
  UNION ALL SELECT 'grid', i, i - 1, n FROM v WHERE i < n // {_GRID} * {_GRID} AND i % {_GRID} > 0 UNION ALL SELECT 'grid', i, i + 1, n FROM v WHERE i < n // {_GRID} * {_GRID} AND i % {_GRID} < {_GRID} - 1
  UNION ALL SELECT 'hypercube', i, xor(i, CAST(pow(2, k) AS BIGINT)), n FROM (SELECT i, n, d, unnest(range(d)) AS k FROM h) WHERE i < pow(2, d)
  UNION ALL SELECT 'echo', i, (i + (n - k + 1) // 2 + unnest(range(k))) % n, n FROM (SELECT i, n, 2 + (n + 1) % 2 AS k FROM v))
SELECT kind, src, count(*) AS links, round(sum(bal), 2) AS balance FROM e JOIN c ON c.id = dst WHERE dst >= 0 AND dst < n GROUP BY ALL""")
def g16_generated_neighbors(spark, sf_dir):
    """Customers as vertices of generated graphs: what each vertex's neighbours have together."""
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("dst"), "c_acctbal")
    n = c.agg(F.max("dst")).first()[0] + 1
    graphs = {"path": graph.path_graph(spark, n), "star": graph.star_graph(spark, n), "circulant": graph.circulant_graph(spark, n, [1, 3]), "pairs": graph.singleton_edge_graph(spark, n // 2),
        "grid": graph.grid_graph(spark, n // _GRID, _GRID), "hypercube": graph.hypercube_graph(spark, n.bit_length() - 1), "echo": graph.echo_graph(spark, n, 2 + (n + 1) % 2)}
    edges = None
    for kind, g in graphs.items():
        g = g.select(F.lit(kind).alias("kind"), "src", "dst")
        edges = g if edges is None else edges.union(g)
    return edges.join(c, "dst").groupBy("kind", "src").agg(F.count(F.lit(1)).alias("links"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
