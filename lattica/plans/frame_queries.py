"""Queries through the library's own operators, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import scalars as S
from lattica.operators import graph as G
from lattica.operators import ml, relational as R
from lattica.plans import dialect
from lattica.plans.lineage import shared_dir
from lattica.session import read_table, stream_table
from lattica.sources import connectors as C
from lattica.streaming import cep, stateful, windows as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            ORACLE_SQL[key] = sql
        return fn

    return add


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lattica/files-{uuid.uuid4().hex}"


# sources and sinks
_ORDERS = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"


def _round_trip(spark: SparkSession, sf_dir: str, format: str, **options: str) -> DataFrame:
    path = _scratch(spark)
    df = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    df.write.format(format).options(**options).save(path)
    return spark.read.format(format).schema(df.schema).options(**options).load(path)


for _name, _format, _options in (("a14_csv", "csv", {"sep": "|", "header": "true"}), ("a19_binary", "parquet", {}), ("a20_compressed", "json", {"compression": "gzip"}), ("a31_orc", "orc", {}), ("a33_json", "json", {}), ("a45_table_sink", "parquet", {"compression": "zstd"})):
    query(_ORDERS, _name)(lambda spark, sf_dir, f=_format, o=_options: _round_trip(spark, sf_dir, f, **o))


@query("SELECT event_id, user_id, value FROM events")
def a02_stream_scan(spark, sf_dir):
    return W.run_to_end(stream_table(spark, sf_dir, "events").select("event_id", "user_id", "value"))


@query("SELECT c_custkey AS id, c_name AS name, upper(c_mktsegment) AS segment FROM customer")
def a09_field_mapping(spark, sf_dir):
    return C.Source("filesystem", path=f"{sf_dir}/customer.parquet", fields={"id": "c_custkey", "name": "c_name", "segment": "c_mktsegment"}, computed={"segment": "upper(segment)"}).load(spark)


@query("SELECT count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) FROM documents)")
def a16_text_lines(spark, sf_dir):
    path = _scratch(spark)
    read_table(spark, sf_dir, "documents").select("text").write.text(path)
    return C.read_lines(spark, path).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS value FROM orders")
def a17_primitives(spark, sf_dir):
    path = _scratch(spark)
    read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string")).write.text(path)
    return C.read_primitives(spark, path, "bigint")


@query("SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def a22_replicating_source(spark, sf_dir):
    region = read_table(spark, sf_dir, "region")  # a fixed list
    return read_table(spark, sf_dir, "nation").join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")


@query("SELECT range AS value, count(o_orderkey) AS n FROM range(1, 501) LEFT JOIN orders ON o_custkey = range GROUP BY range")
def a25_generator_source(spark, sf_dir):
    """Orders of the first customers, with those that have none."""
    spark.dataSource.register(C.SequenceSource)
    numbers = spark.read.format("sequence").options(**{"from": "1", "to": "500"}).load()
    return numbers.join(read_table(spark, sf_dir, "orders"), F.col("value") == F.col("o_custkey"), "left").groupBy("value").agg(F.count("o_orderkey").alias("n"))


@query("SELECT event_id, user_id FROM events")
def a40_bucketing_sink(spark, sf_dir):
    path = _scratch(spark)
    C.write_buckets(read_table(spark, sf_dir, "events"), path, "ts", "yyyy-MM-dd")
    return spark.read.parquet(path).select("event_id", "user_id")


@query("SELECT event_type AS key, count(*) AS n FROM events GROUP BY event_type")
def a43_retract_sink(spark, sf_dir):
    log = W.run_to_end(stateful.retracting_aggregate(stream_table(spark, sf_dir, "events"), "event_type", "value"))
    return stateful.materialize(log).select("key", "n")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 5 <> 0")
def a44_upsert_sink(spark, sf_dir):
    base = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    gone = base.where("c_custkey % 5 = 0").select("*", F.lit(-1).alias("_op"), F.lit(2).alias("_seq"))
    new = base.where("c_custkey % 3 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(1).alias("_op"), F.lit(1).alias("_seq"))
    return C.upsert(base, gone.union(new), ["c_custkey"], F.col("_seq"))


# projection, sampling
@query("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS q2 FROM lineitem")
def b05_map_partition(spark, sf_dir):
    df = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return R.map_partition(df, lambda frames: (f.assign(q2=f.l_quantity * 2).drop(columns="l_quantity") for f in frames), "l_orderkey long, l_linenumber int, q2 double")


@query("SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents")
def b06_flat_map(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))


_SAMPLED = "SELECT l_returnflag, true AS plausible, 0 AS strange FROM lineitem GROUP BY l_returnflag"


def _plausible(df: DataFrame, drawn: DataFrame, share: float, most: int | None) -> DataFrame:
    """By flag: whether about ``share`` of the rows were drawn, and how many were drawn that don't exist or too often."""
    keys = ["l_returnflag", "l_orderkey", "l_linenumber"]
    there = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("t"))
    got = drawn.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    both = there.join(got, keys, "full")
    strange = F.col("t").isNull() | (F.col("n") > F.col("t") * most if most else F.lit(False))
    out = both.groupBy("l_returnflag").agg(F.sum("t").alias("t"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(strange, 1)).alias("strange"))
    return out.select("l_returnflag", (F.abs(F.col("n") - F.col("t") * share) <= 6 * F.sqrt(F.col("t") * share)).alias("plausible"), "strange")


@query(_SAMPLED)
def b21_bernoulli(spark, sf_dir):
    df = read_table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber")
    return _plausible(df, df.sample(False, 0.1, 7), 0.1, 1)


@query(_SAMPLED)
def b22_poisson(spark, sf_dir):
    df = read_table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber")
    return _plausible(df, df.sample(True, 1.0, 7), 1.0, None)


@query("SELECT 50 AS n, 50 AS d, 0 AS strange")
def b23_fixed_size_sample(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    drawn = R.fixed_size_sample(orders, 50, 3)
    known = orders.withColumn("known", F.lit(1))
    return drawn.join(known, ["o_orderkey", "o_totalprice"], "left").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("d"), F.count(F.when(F.col("known").isNull(), 1)).alias("strange"))


# joins
for _hint in ("broadcast_second", "repartition_hash_second", "repartition_sort_merge"):
    query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", f"c09_hint_{_hint}")(
        lambda spark, sf_dir, h=_hint: R.join_with_hint(read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), hint=h).select("o_orderkey", "c_name")
    )


@query("SELECT coalesce(c.k, s.k) AS k, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON c.k = s.k")
def c15_co_group(spark, sf_dir):
    a = read_table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    b = read_table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return R.co_group(a, b, ["k"], lambda key, x, y: pd.DataFrame([(key[0], int(x.n.sum()), int(y.n.sum()))], columns=["k", "customers", "suppliers"]), "k int, customers long, suppliers long")


@query("SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.ts BETWEEN b.ts - INTERVAL 300 SECOND AND b.ts + INTERVAL 600 SECOND WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def c17_interval_join(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    a = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("a"), F.col("ts").alias("ta"))
    b = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("b"), F.col("ts").alias("tb"))
    return R.range_join(a, b, ["user_id"], "ta", "tb", 300, 600).select("a", "b")


@query("SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.ts BETWEEN b.ts - INTERVAL 300 SECOND AND b.ts + INTERVAL 600 SECOND WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def c17_interval_join_stream(spark, sf_dir):
    e = W.with_rowtime(stream_table(spark, sf_dir, "events"), "ts", "1 hour")
    a = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("a"), F.col("ts").alias("ta"))
    b = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("b"), F.col("ts").alias("tb"))
    return W.run_to_end(W.interval_join(a, b, "user_id", "ta", "tb", "5 MINUTES", "10 MINUTES").select("a", "b"))


@query("SELECT event_id, user_id, e.event_type, k.n FROM events e JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) k ON e.event_type = k.event_type")
def c20_side_input(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    side = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return W.run_to_end(stream_table(spark, sf_dir, "events").join(side, "event_type").select("event_id", "user_id", "event_type", "n"))


# aggregates
@query("SELECT o_orderstatus, o_orderpriority, 1 - grouping(o_orderstatus) AS g, (1 - grouping(o_orderstatus)) + 2 * (1 - grouping(o_orderpriority)) AS gid, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def d16_grouping_legacy(spark, sf_dir):
    df = read_table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority")
    return df.agg(R.grouping_legacy("o_orderstatus").alias("g"), R.group_id_legacy(["o_orderstatus", "o_orderpriority"]).alias("gid"), F.count(F.lit(1)).alias("n"))


@query("SELECT c_nationkey, sum(n) AS total, count(*) AS kinds FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) GROUP BY c_nationkey")
def d11_collect_multiset(spark, sf_dir):
    m = R.collect_multiset(["c_nationkey"], "c_mktsegment", read_table(spark, sf_dir, "customer"))
    return m.select("c_nationkey", F.aggregate(F.map_values("multiset"), F.lit(0).cast("long"), lambda s, v: s + v).alias("total"), F.size("multiset").alias("kinds"))


@query("SELECT l_returnflag, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity, l_extendedprice, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def d19_min_by(spark, sf_dir):
    df = read_table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return R.min_row(df, ["l_returnflag"], ["l_quantity", "l_extendedprice"]).select("l_returnflag", "l_orderkey", "l_linenumber")


@query("SELECT l_returnflag, max(l_quantity) AS m FROM lineitem GROUP BY l_returnflag")
def d20_reduce(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.max("l_quantity").alias("m"))


@query("SELECT o_custkey, count(*) AS n, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY o_custkey")
def d22_reduce_group(spark, sf_dir):
    return R.reduce_group(read_table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice"), ["o_custkey"], lambda g: pd.DataFrame({"o_custkey": [g.o_custkey.iloc[0]], "n": [len(g)], "spread": [g.o_totalprice.max() - g.o_totalprice.min()]}), "o_custkey long, n long, spread double")


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def d23_combine_group(spark, sf_dir):
    part = R.combine_group(read_table(spark, sf_dir, "lineitem").select("l_returnflag"), ["l_returnflag"], lambda g: pd.DataFrame({"l_returnflag": [g.l_returnflag.iloc[0]], "c": [len(g)]}), "l_returnflag string, c long")
    return part.groupBy("l_returnflag").agg(F.sum("c").alias("n"))


@query("SELECT o_custkey, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS s FROM orders GROUP BY o_custkey")
def d25_fold(spark, sf_dir):
    return R.fold(read_table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], "o_orderstatus", F.lit(""), lambda acc, v: F.concat(acc, v), "s")


@query("SELECT event_id AS id, user_id AS key, count(value) OVER w AS n, round(sum(value) OVER w, 4) AS s, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def d26_rolling_stream(spark, sf_dir):
    out = W.run_to_end(stateful.rolling_aggregate(stream_table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value"))
    return out.withColumn("s", F.round("s", 4))


_SUMMED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_orderkey"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, 0 AS nulls, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 4) AS stddev, NULL::DOUBLE AS max_length FROM lineitem" for c in _SUMMED) + " UNION ALL SELECT 'l_returnflag', count(l_returnflag), 0, NULL, NULL, NULL, NULL, max(length(l_returnflag)) FROM lineitem")
def d28_summarize(spark, sf_dir):
    out = R.summarize(read_table(spark, sf_dir, "lineitem").select(*_SUMMED, "l_returnflag"))
    return out.select("column", "n", "nulls", "min", "max", F.round("mean", 6).alias("mean"), F.round("stddev", 4).alias("stddev"), "max_length")


@query("SELECT l_linenumber AS part, count(*) AS n FROM lineitem GROUP BY 1")
def d29_count_per_partition(spark, sf_dir):
    df = R.partition_custom(read_table(spark, sf_dir, "lineitem").select("l_linenumber"), 8, F.col("l_linenumber"))
    return R.count_per_partition(df).select(F.col("partition").alias("part"), "n")


@query("SELECT o_orderkey, o_custkey, o_orderpriority, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS index FROM orders")
def d30_zip_with_index(spark, sf_dir):
    ordered = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return R.zip_with_index(ordered).drop("o_totalprice")


@query("SELECT c_custkey, c_name, c_mktsegment, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS pos FROM customer")
def o01_order_by(spark, sf_dir):
    """A sort by ranges of the key; positions come from the counts of the ranges, not from one task."""
    ordered = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_name", "c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return R.zip_with_index(ordered, "pos").select("c_custkey", "c_name", "c_mktsegment", (F.col("pos") + 1).alias("pos"))


@query("WITH RECURSIVE e AS (SELECT c_custkey AS src, -100 - c_nationkey AS dst FROM customer UNION SELECT 10000000000 + s_suppkey, -100 - s_nationkey FROM supplier UNION SELECT -100 - n_nationkey, -1 - n_regionkey FROM nation), c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src) SELECT src, dst FROM c")
def x08_transitive_closure(spark, sf_dir):
    c, s, n = (read_table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    nation = lambda x: (-100 - F.col(x)).cast("long")
    edges = c.select(F.col("c_custkey").alias("src"), nation("c_nationkey").alias("dst")).union(s.select(F.col("s_suppkey") + 10_000_000_000, nation("s_nationkey"))).union(n.select(nation("n_nationkey"), (-1 - F.col("n_regionkey")).cast("long")))
    return G.transitive_closure(edges)


# windows
@query("SELECT user_id AS key, w, round(sum(value), 4) AS s FROM (SELECT user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 4 AS w FROM events) GROUP BY user_id, w HAVING count(*) = 4")
def w06_count_window(spark, sf_dir):
    return stateful.count_windows(read_table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value", 4).withColumn("s", F.round("s", 4))


@query("SELECT user_id AS key, w, round(sum(value), 4) AS s FROM (SELECT user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 4 AS w FROM events) GROUP BY user_id, w HAVING count(*) = 4")
def w21_count_trigger_stream(spark, sf_dir):
    return W.run_to_end(stateful.count_windows(stream_table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value", 4)).withColumn("s", F.round("s", 4))


@query("SELECT user_id, CAST(epoch(time_bucket(INTERVAL 20 MINUTE, ts) - to_minutes(20 * k)) AS BIGINT) AS start, count(*) AS n, round(sum(value), 3) AS s FROM events, (SELECT unnest([0, 1, 2]) AS k) GROUP BY ALL")
def w08_sliding_panes(spark, sf_dir):
    return R.sliding_by_panes(read_table(spark, sf_dir, "events"), "ts", 3600, 1200, ["user_id"], "value").withColumn("s", F.round("s", 3))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, count(*) AS n FROM events GROUP BY 1")
def w10_sql_dialect(spark, sf_dir):
    return dialect.sql(spark, "SELECT TUMBLE_START(ts, INTERVAL '1' HOUR) AS s, count(*) AS n FROM w10_events GROUP BY TUMBLE(ts, INTERVAL '1' HOUR)", w10_events=read_table(spark, sf_dir, "events"))


@query("SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def w12_stream_windows(spark, sf_dir):
    e = W.with_rowtime(stream_table(spark, sf_dir, "events"), "ts", "1 hour")
    return W.run_to_end(W.tumble(e, "ts", "30 minutes", ["event_type"], [F.count(F.lit(1)).alias("n")]).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n"), "complete")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n FROM events GROUP BY 1")
def w17_window_all(spark, sf_dir):
    return W.tumble(read_table(spark, sf_dir, "events"), "ts", "1 hour", [], [F.count(F.lit(1)).alias("n")]).select("window_start", "n")


@query("SELECT event_id AS id, user_id AS key, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def w23_evictor_stream(spark, sf_dir):
    return W.run_to_end(stateful.over_rows(stream_table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value", 3)).withColumn("s", F.round("s", 4))


# placement and order
@query("SELECT count(*) AS n, 0 AS misplaced FROM orders")
def o05_sort_partition(spark, sf_dir):
    df = read_table(spark, sf_dir, "orders").select("o_orderkey").repartition(4).sortWithinPartitions("o_orderkey")
    marked = df.withColumn("p", F.spark_partition_id()).withColumn("m", F.monotonically_increasing_id())
    back = F.when(F.lag("o_orderkey").over(Window.partitionBy("p").orderBy("m")) > F.col("o_orderkey"), 1).otherwise(0)
    return marked.withColumn("back", back).agg(F.count(F.lit(1)).alias("n"), F.sum("back").alias("misplaced"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def o06_first_n(spark, sf_dir):
    return R.top_k(read_table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("SELECT count(DISTINCT c_nationkey) AS buckets, count(*) AS n FROM customer")
def o08_partition_custom(spark, sf_dir):
    df = R.partition_custom(read_table(spark, sf_dir, "customer"), 25, F.col("c_nationkey"))
    per = df.groupBy(F.spark_partition_id().alias("p"), "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("buckets"), F.sum("n").alias("n"))


@query("SELECT 'a' AS side, c_custkey AS k, c_mktsegment AS seg, NULL::INT AS nation FROM customer UNION ALL SELECT 'b', s_suppkey, NULL, s_nationkey FROM supplier")
def u06_connect(spark, sf_dir):
    a = read_table(spark, sf_dir, "customer").select(F.lit("a").alias("side"), F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"))
    b = read_table(spark, sf_dir, "supplier").select(F.lit("b").alias("side"), F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT event_id, 'big' AS route FROM events WHERE value > 50 UNION ALL SELECT event_id, 'click' FROM events WHERE event_type = 'click'")
def u07_split(spark, sf_dir):
    parts = R.split(read_table(spark, sf_dir, "events"), big=F.col("value") > 50, click=F.col("event_type") == "click")
    return parts["big"].select("event_id", F.lit("big").alias("route")).union(parts["click"].select("event_id", F.lit("click").alias("route")))


# functions
@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%H:%M:%S') AS t FROM orders")
def f26_date_format(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").select("o_orderkey", S.date_format(F.col("o_orderdate"), "%Y-%m-%d").alias("d"), S.date_format(F.col("o_orderdate"), "%H:%i:%S").alias("t"))


@query("SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#(1|2)[1-3]')")
def f20_similar_to(spark, sf_dir):
    return read_table(spark, sf_dir, "part").where(S.similar_to(F.col("p_brand"), "Brand#(1|2)[1-3]")).select("p_partkey")


@query("SELECT event_id, ts < TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-01 00:00:00' < ts + INTERVAL 1 HOUR AS o FROM events")
def f28_overlaps(spark, sf_dir):
    ts = F.col("ts")
    return read_table(spark, sf_dir, "events").select("event_id", S.temporal_overlaps(ts, ts + F.expr("INTERVAL 1 HOUR"), F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"), F.expr("TIMESTAMP_NTZ'2024-01-02 00:00:00'")).alias("o"))


# event patterns
@query("WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) SELECT a.user_id, a.event_id AS a, b.event_id AS b FROM o a JOIN o b ON a.user_id = b.user_id AND b.rn = a.rn + 1 WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def s24_cep_next(spark, sf_dir):
    return _pairs(spark, sf_dir, "strict")


@query("WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) SELECT a.user_id, a.event_id AS a, (SELECT arg_min(b.event_id, b.rn) FROM o b WHERE b.user_id = a.user_id AND b.rn > a.rn AND b.event_type = 'purchase') AS b FROM o a WHERE a.event_type = 'click' AND EXISTS (SELECT 1 FROM o b WHERE b.user_id = a.user_id AND b.rn > a.rn AND b.event_type = 'purchase')")
def s24_cep_followed_by(spark, sf_dir):
    return _pairs(spark, sf_dir, "relaxed")


def _pairs(spark: SparkSession, sf_dir: str, follow: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    found = cep.sequence(e, "user_id", ["ts", "event_id"], [("a", F.col("event_type") == "click", "strict"), ("b", F.col("event_type") == "purchase", follow)])
    return found.select("a.user_id", F.col("a.event_id").alias("a"), F.col("b.event_id").alias("b"))


# functions of users
@query("SELECT c_custkey, length(c_name) * 2 AS n FROM customer")
def v01_scalar_udf(spark, sf_dir):
    twice = F.pandas_udf(lambda s: s.str.len() * 2, "long")
    return read_table(spark, sf_dir, "customer").select("c_custkey", twice("c_name").alias("n"))


@query("SELECT n_nationkey, unnest(range(1, CAST(n_regionkey + 1 AS BIGINT))) AS i FROM nation")
def v02_table_function(spark, sf_dir):
    @F.udtf(returnType="i long")
    class Upto:
        def eval(self, n: int):
            for i in range(1, n + 1):
                yield (i,)

    spark.udtf.register("lattica_upto", Upto)
    read_table(spark, sf_dir, "nation").createOrReplaceTempView("v02_nation")
    return spark.sql("SELECT n_nationkey, i FROM v02_nation, LATERAL lattica_upto(n_regionkey)")


@query("SELECT o_custkey, round(sum(o_totalprice * o_orderkey) / sum(o_orderkey), 4) AS wavg FROM orders GROUP BY o_custkey")
def v03_aggregate_function(spark, sf_dir):
    @F.pandas_udf("double")
    def wavg(v: pd.Series, w: pd.Series) -> float:
        return float((v * w).sum() / w.sum())

    return read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(wavg("o_totalprice", "o_orderkey"), 4).alias("wavg"))


# graphs over whole tables: suppliers and their parts; orders and their parts (negative identifiers); and both with suppliers
_EDGES = "(SELECT DISTINCT l_suppkey AS src, 10000000000 + l_partkey AS dst FROM lineitem)"
_ORDER_PARTS = "(SELECT DISTINCT l_orderkey AS src, -1 - l_partkey AS dst FROM lineitem)"
_BOTH = f"(SELECT src, dst FROM {_ORDER_PARTS} UNION ALL SELECT dst, src FROM {_ORDER_PARTS})"
_THREE = """(SELECT l_orderkey AS src, 10000000000 + l_partkey AS dst FROM lineitem UNION SELECT l_orderkey, 20000000000 + l_suppkey FROM lineitem
  UNION SELECT 10000000000 + l_partkey, 20000000000 + l_suppkey FROM lineitem)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "lineitem")
    return df.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 10_000_000_000).alias("dst")).distinct()


def _order_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), (-1 - F.col("l_partkey")).alias("dst")).distinct()


def _three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _three_repeated(spark, sf_dir).distinct()


def _three_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With an edge for each line, for operators that make edges distinct themselves."""
    df = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), (F.col("l_partkey") + 10_000_000_000).alias("p"), (F.col("l_suppkey") + 20_000_000_000).alias("s"))
    return df.select(F.explode(F.array(*[F.struct(F.col(x).alias("src"), F.col(y).alias("dst")) for x, y in ("op", "os", "ps")])).alias("e")).select("e.*")


def _event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and all their events; events get negative identifiers, so that none is also a user's."""
    return read_table(spark, sf_dir, "events").select("user_id", "event_id").dropna().select(F.col("user_id").cast("long").alias("src"), (-1 - F.col("event_id")).cast("long").alias("dst")).distinct()


_EVENT_EDGES = "(SELECT DISTINCT user_id AS src, -1 - event_id AS dst FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL)"


@query(f"SELECT coalesce(a.id, b.id) AS id, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree, coalesce(o, 0) + coalesce(i, 0) AS degree FROM (SELECT src AS id, count(*) AS o FROM {_THREE} GROUP BY 1) a FULL JOIN (SELECT dst AS id, count(*) AS i FROM {_THREE} GROUP BY 1) b ON a.id = b.id")
def g30_degrees(spark, sf_dir):
    return G.degrees(_three(spark, sf_dir))


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM {_BOTH}), cc(id, component) USING KEY (id) AS (SELECT src, src FROM e GROUP BY src UNION
  (SELECT e.dst, min(cc.component) FROM cc JOIN e ON cc.id = e.src JOIN recurring.cc AS r ON r.id = e.dst WHERE cc.component < r.component GROUP BY e.dst)) SELECT id, component FROM cc""")
def g07_connected_components(spark, sf_dir):
    return G.connected_components(_order_parts(spark, sf_dir))


@query(f"SELECT x.src AS a, x.dst AS b, y.dst AS c FROM {_THREE} x JOIN {_THREE} y ON x.dst = y.src JOIN {_THREE} z ON z.src = x.src AND z.dst = y.dst")
def g12_triangles(spark, sf_dir):
    return G.triangles(_three_repeated(spark, sf_dir))


@query(f"""WITH b AS MATERIALIZED (SELECT src, dst FROM {_BOTH}), d AS (SELECT src, count(*) AS d FROM b GROUP BY 1),
s AS (SELECT x.src AS a, y.src AS b, count(*) AS n, sum(1 / ln(d.d)) AS aa FROM b x JOIN b y ON x.dst = y.dst AND x.src < y.src JOIN d ON d.src = x.dst GROUP BY ALL)
SELECT s.a, s.b, n AS shared, round(n / (da.d + db.d - n), 9) AS jaccard, round(aa, 6) AS adamic_adar FROM s JOIN d da ON da.src = s.a JOIN d db ON db.src = s.b""")
def g14_similarity(spark, sf_dir):
    return G.shared_neighbors(_order_parts(spark, sf_dir)).select("a", "b", "shared", F.round("jaccard", 9).alias("jaccard"), F.round("adamic_adar", 6).alias("adamic_adar"))


@query(f"WITH d AS (SELECT src, count(*) AS d FROM (SELECT src, dst FROM {_THREE} UNION ALL SELECT dst, src FROM {_THREE}) GROUP BY 1) SELECT count(*) AS vertices, CAST(sum(d) AS BIGINT) // 2 AS edges, max(d) AS max_degree, round(avg(d), 9) AS average_degree, CAST(sum(d * (d - 1) // 2) AS BIGINT) AS triplets FROM d")
def g15_metrics(spark, sf_dir):
    return G.graph_metrics(_three(spark, sf_dir)).withColumn("average_degree", F.round("average_degree", 9))


@query(f"SELECT x.src AS a, y.src AS b, count(*) AS shared FROM {_EDGES} x JOIN {_EDGES} y ON x.dst = y.dst AND x.src < y.src GROUP BY ALL")
def g17_bipartite_projection(spark, sf_dir):
    return G.bipartite_projection(_edges(spark, sf_dir))


def _unrolled(first: str, step: str, n: int, last: str, **parts: str) -> str:
    """``n`` steps as a chain of named tables r0..rn; ``step`` and ``last`` name the table before as {r}."""
    tables = [f"{k} AS MATERIALIZED ({v})" for k, v in parts.items()] + [f"r0 AS ({first})"] + [f"r{i + 1} AS MATERIALIZED ({step.format(r=f'r{i}')})" for i in range(n)]
    return f"WITH {', '.join(tables)} {last.format(r=f'r{n}')}"


@query(_unrolled(
    "SELECT id, 1.0 / (SELECT count(*) FROM v) AS rank FROM v",
    "SELECT v.id, 0.15 / (SELECT count(*) FROM v) + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank), 0) FROM {r} WHERE id NOT IN (SELECT src FROM e)) / (SELECT count(*) FROM v)) AS rank FROM v LEFT JOIN (SELECT e.dst AS id, sum(rank / n) AS got FROM {r} JOIN e ON {r}.id = e.src JOIN o ON o.src = e.src GROUP BY 1) g ON v.id = g.id",
    5, "SELECT id, round(rank, 12) AS rank FROM {r}",
    e=f"SELECT src, dst FROM {_ORDER_PARTS}", v="SELECT src AS id FROM e UNION SELECT dst FROM e", o="SELECT src, count(*)::DOUBLE AS n FROM e GROUP BY 1",
))
def g13_pagerank(spark, sf_dir):
    return G.pagerank(_order_parts(spark, sf_dir), steps=5).withColumn("rank", F.round("rank", 12))


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM {_BOTH}), d(id, value) USING KEY (id) AS (SELECT src, CASE WHEN src = 1 THEN 0.0::DOUBLE ELSE 'infinity'::DOUBLE END FROM e GROUP BY src UNION
  (SELECT e.dst, min(d.value + 1) FROM d JOIN e ON d.id = e.src JOIN recurring.d AS r ON r.id = e.dst WHERE d.value + 1 < r.value GROUP BY e.dst)) SELECT id, value FROM d""")
def g08_sssp(spark, sf_dir):
    e = _order_parts(spark, sf_dir)
    return G.sssp(e.union(e.select("dst", "src")).withColumn("value", F.lit(1.0)), 1)


@query(_unrolled(
    "SELECT DISTINCT src AS id, src AS label FROM e",
    "SELECT src AS id, arg_max(label, struct_pack(n := n, label := label)) AS label FROM (SELECT e.src, {r}.label, count(*) AS n FROM e JOIN {r} ON {r}.id = e.dst GROUP BY ALL) GROUP BY src",
    3, "SELECT id, label FROM {r}", e=f"SELECT src, dst FROM {_BOTH}",
))
def g09_label_propagation(spark, sf_dir):
    return G.label_propagation(_order_parts(spark, sf_dir), 3)


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM {_EVENT_EDGES}), cc(id, component) USING KEY (id) AS (SELECT src, src FROM (SELECT src FROM e UNION SELECT dst FROM e) GROUP BY src UNION
  (SELECT x.dst, min(cc.component) FROM cc JOIN (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) x ON cc.id = x.src JOIN recurring.cc AS r ON r.id = x.dst WHERE cc.component < r.component GROUP BY x.dst)) SELECT id, component FROM cc""")
def g07_components_of_users(spark, sf_dir):
    return G.connected_components(_event_edges(spark, sf_dir))


# neighbourhoods, clustering and other drivers
@query(f"SELECT dst AS id, sum(src) AS value FROM {_ORDER_PARTS} GROUP BY 1")
def g02_reduce_on_neighbors(spark, sf_dir):
    e = _order_parts(spark, sf_dir)
    return G.reduce_on_neighbors(G.vertices_of(e).withColumn("value", F.col("id")), e, "in", F.sum("value"))


@query(f"SELECT v.id, CASE WHEN n IS NULL THEN 0 ELSE n END AS value FROM (SELECT src AS id FROM {_BOTH} GROUP BY 1) v LEFT JOIN (SELECT src AS id, count(*) AS n FROM {_ORDER_PARTS} GROUP BY 1) d ON v.id = d.id")
def g03_join_with_vertices(spark, sf_dir):
    e = _order_parts(spark, sf_dir)
    counts = e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("update"))
    return G.join_with_vertices(G.vertices_of(e).withColumn("value", F.lit(0).cast("long")), counts, lambda value, update: value + update)


@query(f"""WITH b AS MATERIALIZED (SELECT src, dst FROM {_THREE} UNION ALL SELECT dst, src FROM {_THREE}), d AS (SELECT src AS id, count(*) AS degree FROM b GROUP BY 1),
t AS MATERIALIZED (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM {_THREE} x JOIN {_THREE} y ON x.dst = y.src JOIN {_THREE} z ON z.src = x.src AND z.dst = y.dst),
n AS (SELECT id, count(*) AS triangles FROM (SELECT a AS id FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY 1)
SELECT d.id, degree, coalesce(triangles, 0) AS triangles, round(CASE WHEN degree < 2 THEN 0.0 ELSE 2 * coalesce(triangles, 0) / (degree * (degree - 1)) END, 9) AS local FROM d LEFT JOIN n ON d.id = n.id""")
def g11_clustering(spark, sf_dir):
    return G.clustering_coefficients(_three_repeated(spark, sf_dir)).withColumn("local", F.round("local", 9))


@query(f"SELECT src, dst, src_degree, dst_degree FROM {_ORDER_PARTS} e JOIN (SELECT src AS id, count(*) AS src_degree FROM {_BOTH} GROUP BY 1) a ON e.src = a.id JOIN (SELECT src AS id, count(*) AS dst_degree FROM {_BOTH} GROUP BY 1) b ON e.dst = b.id")
def g30_edge_degree_pairs(spark, sf_dir):
    return G.edge_degree_pairs(_order_parts(spark, sf_dir))


@query(f"SELECT count(*) AS n FROM {_THREE}")
def g31_count(spark, sf_dir):
    return R.checksum(_three(spark, sf_dir)).select("n")


@query(_unrolled(
    "SELECT id, 1.0::DOUBLE AS hub, 0.0::DOUBLE AS authority FROM v",
    "SELECT v.id, coalesce(h.h, 0) / sqrt(sum(coalesce(h.h, 0) ** 2) OVER ()) AS hub, coalesce(a.a, 0) AS authority FROM v LEFT JOIN (SELECT id, x / sqrt(sum(x * x) OVER ()) AS a FROM (SELECT e.dst AS id, sum(hub) AS x FROM e JOIN {r} ON {r}.id = e.src GROUP BY 1)) a ON a.id = v.id LEFT JOIN (SELECT e.src AS id, sum(a) AS h FROM e JOIN (SELECT id, x / sqrt(sum(x * x) OVER ()) AS a FROM (SELECT e.dst AS id, sum(hub) AS x FROM e JOIN {r} ON {r}.id = e.src GROUP BY 1)) t ON t.id = e.dst GROUP BY 1) h ON h.id = v.id",
    3, "SELECT id, round(hub, 9) AS hub, round(authority, 9) AS authority FROM {r}", e=f"SELECT src, dst FROM {_ORDER_PARTS}", v="SELECT src AS id FROM e UNION SELECT dst FROM e",
))
def g13_hits(spark, sf_dir):
    return G.hits(_order_parts(spark, sf_dir), 3).select("id", F.round("hub", 9).alias("hub"), F.round("authority", 9).alias("authority"))


@query("SELECT i AS src, (i + k + n) % n AS dst FROM (SELECT row_number() OVER () - 1 AS i, count(*) OVER () AS n FROM customer), (SELECT unnest([1, -1]) AS k)")
def g16_cycle(spark, sf_dir):
    """A cycle of as many vertices as there are customers."""
    return G.cycle_graph(spark, read_table(spark, sf_dir, "customer").count())


# machine learning
@query("SELECT a.vec_id, b.vec_id AS query_id, round(sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: pow(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE), 2)))), 6) AS euclidean, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: abs(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)))), 6) AS manhattan FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0")
def g25_distances(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    met = ml.distances_in_blocks(e.select("vec_id", "embedding"), asked)
    return met.select("vec_id", "query_id", F.round("euclidean", 6).alias("euclidean"), F.round("manhattan", 6).alias("manhattan"))


@query("SELECT query_id, neighbor_id, rank FROM (SELECT q.vec_id AS query_id, t.vec_id AS neighbor_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(q.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])), t.vec_id) AS rank FROM embeddings q, embeddings t WHERE q.vec_id % 100 = 0) WHERE rank <= 5")
def g24_knn(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    return ml.knn(e, e.where("vec_id % 100 = 0"), 5).select("query_id", "neighbor_id", "rank")


@query("SELECT c_custkey, round((c_acctbal - m) / s, 6) AS z FROM customer, (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer)")
def g20_standard_scale(spark, sf_dir):
    return ml.standard_scale(read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).select("c_custkey", F.round("c_acctbal", 6).alias("z"))


@query("SELECT count(*) AS n, 0 AS missed, true AS rare FROM orders")
def g27_bloom(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_custkey")
    bloom = ml.bloom_filter(o, "o_custkey", rate=0.01)
    held = ml.might_contain(o, "o_custkey", bloom).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("maybe"), 1)).alias("missed"))
    absent = ml.might_contain(read_table(spark, sf_dir, "lineitem").select((-1 - F.col("l_orderkey")).alias("k")).distinct(), "k", bloom).agg((F.avg(F.col("maybe").cast("int")) < 0.03).alias("rare"))
    return held.crossJoin(absent)  # one row each


@query("SELECT l_suppkey AS row, l_linenumber AS col, sum(CAST(l_quantity AS BIGINT)) + count(*) AS value FROM lineitem GROUP BY ALL")
def g32_matrix_add(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("row"), F.col("l_linenumber").alias("col"), F.col("l_quantity").cast("bigint").alias("value"))
    return ml.matrix_add(li, li.withColumn("value", F.lit(1).cast("bigint")))


@query("""WITH RECURSIVE m AS (SELECT avg(x * x) AS xx, avg(x) AS mx, avg(x * y) AS xy, avg(y) AS my FROM (SELECT l_quantity / 50 AS x, l_quantity * 0.5 + 3 AS y FROM lineitem)),
g AS (SELECT 0 AS step, 0.0::DOUBLE AS w, 0.0::DOUBLE AS b UNION ALL SELECT step + 1, w - 0.5 / sqrt(step + 1) * (w * xx + b * mx - xy), b - 0.5 / sqrt(step + 1) * (w * mx + b - my) FROM g, m WHERE step < 20)
SELECT 'x' AS name, round(w, 6) AS weight FROM g WHERE step = 20 UNION ALL SELECT 'intercept', round(b, 6) FROM g WHERE step = 20""")
def g22_regression(spark, sf_dir):
    df = read_table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("x"), (F.col("l_quantity") * 0.5 + 3).alias("y"))
    w = ml.gradient_descent(df, ["x"], "y", steps=20, rate=0.5)
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in sorted(w.items())], "name string, weight double")
