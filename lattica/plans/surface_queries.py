"""Queries over sources, sinks, catalog, windows with triggers, iteration and user code, each with its twin in SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.cli import Client
from lattica.operators import graph as G
from lattica.operators import ml, relational as R
from lattica.plans import dialect
from lattica.plans.frame_queries import _BOTH, _ORDER_PARTS, _order_parts, _scratch, _unrolled, query
from lattica.session import read_table, stream_table
from lattica.sources import connectors as C
from lattica.streaming import stateful, windows as W


# sources
@query("SELECT event_id, user_id, value FROM events")
def a04_stream_table_source(spark, sf_dir):
    schema = read_table(spark, sf_dir, "events").schema
    source = C.Source("filesystem", path=f"{sf_dir}/events.parque[t]", schema=", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema), rowtime=("rowtime", "ts", "1 hour"))
    return W.run_to_end(source.load(spark, streaming=True).select("event_id", "user_id", "value"))


def _only(df: DataFrame, columns: set[str], pushed: str = "") -> DataFrame:
    """``df``, after making sure that its scan reads these columns and was given this filter."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    read = {part.split(":")[0].strip() for line in plan.split("ReadSchema: struct<")[1:] for part in line.split(">\n")[0].split(">")[0].split(",")}
    if not read or not read <= columns or pushed not in plan:
        raise AssertionError(f"the scan reads {read}:\n{plan}")
    return df


@query("SELECT l_orderkey, l_tax FROM lineitem")
def a06_projectable_source(spark, sf_dir):
    return _only(read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_tax"), {"l_orderkey", "l_tax"})


@query("SELECT o_orderkey, o_orderstatus AS status FROM orders")
def a07_nested_projectable_source(spark, sf_dir):
    path = _scratch(spark)
    read_table(spark, sf_dir, "orders").select("o_orderkey", F.struct("o_orderstatus", "o_totalprice").alias("detail")).write.parquet(path)
    out = spark.read.parquet(path).select("o_orderkey", F.col("detail.o_orderstatus").alias("status"))
    if "o_totalprice" in out._jdf.queryExecution().executedPlan().toString():
        raise AssertionError("the scan reads a nested field that isn't used")
    return out


@query("SELECT l_orderkey FROM lineitem WHERE l_quantity > 45")
def a08_filterable_source(spark, sf_dir):
    return _only(read_table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_orderkey"), {"l_orderkey", "l_quantity"}, "GreaterThan(l_quantity,45.0)")


@query("SELECT event_id, ts AS rowtime, true AS clocked FROM events")
def a11_time_attributes(spark, sf_dir):
    source = C.Source("filesystem", path=f"{sf_dir}/events.parquet", computed={"proctime": "current_timestamp()"}, rowtime=("rowtime", "ts", "1 hour"))
    return source.load(spark).select("event_id", F.col("rowtime").cast("timestamp_ntz").alias("rowtime"), F.col("proctime").isNotNull().alias("clocked"))


@query("SELECT event_id, date_trunc('second', ts) AS a, date_trunc('second', ts) AS b FROM events")
def a12_timestamp_from_field(spark, sf_dir):
    """Row time from a number of milliseconds, and from text."""
    e = read_table(spark, sf_dir, "events").select("event_id", (F.unix_timestamp(F.col("ts").cast("timestamp")) * 1000).alias("ms"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("text"))
    return e.select("event_id", F.timestamp_millis("ms").cast("timestamp_ntz").alias("a"), F.to_timestamp_ntz("text", F.lit("yyyy-MM-dd HH:mm:ss")).alias("b"))


@query("SELECT count(*) AS n, true AS recent FROM events")
def a13_record_timestamp(spark, sf_dir):
    path = _scratch(spark)
    read_table(spark, sf_dir, "events").select("event_id").write.parquet(path)
    rows = C.record_time(spark.read.parquet(path))
    return rows.agg(F.count(F.lit(1)).alias("n"), (F.min("rowtime") > F.current_timestamp() - F.expr("INTERVAL 1 HOUR")).alias("recent"))


@query("SELECT c_custkey, c_acctbal FROM customer")
def a15_csv_input_format(spark, sf_dir):
    path = _scratch(spark)
    read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").write.option("sep", "|").csv(path)
    return C.read_csv(spark, path, "c_custkey long, c_name string, c_acctbal double", sep="|", fields=["c_custkey", "c_acctbal"])


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def a21_path_filter(spark, sf_dir):
    path = _scratch(spark)
    for status in ("F", "O", "P"):
        read_table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).select("o_orderkey").write.parquet(f"{path}/status-{status}")
    return C.read_filtered(spark, f"{path}/status-F*", "parquet", glob="*.parquet", recursive=True, schema="o_orderkey long")


@query("SELECT event_id FROM events")
def a23_file_monitoring(spark, sf_dir):
    """A folder that gets its files one after the other; each is read once."""
    path = _scratch(spark)
    events = read_table(spark, sf_dir, "events").select("event_id")
    for part in range(3):
        events.where(F.col("event_id") % 3 == part).write.mode("append").parquet(path)
    return W.run_to_end(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path))


@query("SELECT range AS value, o_orderkey FROM range(1, 301) JOIN orders ON o_custkey = range")
def a25_generator_stream(spark, sf_dir):
    """A generated stream of customers meets the table of orders."""
    spark.dataSource.register(C.SequenceSource)
    numbers = spark.readStream.format("sequence").options(**{"from": "1", "to": "300"}).load()
    return W.run_to_end(numbers.join(read_table(spark, sf_dir, "orders"), F.col("value") == F.col("o_custkey")).select("value", "o_orderkey"))


@query("SELECT c_custkey AS key, c_name AS value FROM customer")
def a30_hadoop_formats(spark, sf_dir):
    """Key and value pairs in a sequence file, written and read through the Hadoop formats."""
    path = _scratch(spark)
    rows = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    rows.rdd.map(tuple).saveAsSequenceFile(path)
    return spark.createDataFrame(spark.sparkContext.sequenceFile(path), "key long, value string")


# sinks and catalog
@query("SELECT n_nationkey, CASE WHEN n_regionkey <> 1 THEN n_name END AS name FROM nation")
def a41_csv_sink(spark, sf_dir):
    path = _scratch(spark)
    C.write_csv(read_table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_regionkey") != 1, F.col("n_name")).alias("name")), path, sep="|", files=1)
    return C.read_csv(spark, path, "n_nationkey int, name string", sep="|")


@query("SELECT event_id FROM events WHERE event_type = 'click'")
def a42_append_sink(spark, sf_dir):
    path = _scratch(spark)
    e = stream_table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id")
    e.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("SELECT r_regionkey || '/' || r_name AS value FROM region")
def a46_text_sink(spark, sf_dir):
    path = _scratch(spark)
    read_table(spark, sf_dir, "region").select(F.concat_ws("/", "r_regionkey", "r_name")).write.text(path)
    return C.read_lines(spark, path)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def a47_output_by_interval(spark, sf_dir):
    path = _scratch(spark)
    write = lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/out/batch={batch}")
    running = C.for_each_interval(stream_table(spark, sf_dir, "events").select("event_type"), write, "1 second", f"{path}/checkpoint")
    running.processAllAvailable()
    running.stop()
    return spark.read.parquet(f"{path}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT s_suppkey::INT, s_name FROM supplier")
def a48_insert_into(spark, sf_dir):
    with C.Catalog(spark, "lattica_a48") as catalog:
        catalog.create("target", "k int, name string", _scratch(spark))
        C.insert_into(spark, read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "lattica_a48.target")
        C.insert_into(spark, read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int"), "s_name"), "lattica_a48.target")
        return catalog.table("target").toDF("n_nationkey", "n_name")


@query("SELECT 'kept' AS name, count(*) AS n FROM region")
def a49_catalog(spark, sf_dir):
    """Databases and tables made, listed, altered and dropped."""
    with C.Catalog(spark, "lattica_a49") as catalog:
        for name in ("kept", "gone"):
            catalog.create(name, "r_regionkey int, r_name string", _scratch(spark), {"note": "mine"})
        C.insert_into(spark, read_table(spark, sf_dir, "region"), "lattica_a49.kept")
        catalog.alter("kept", {"note": "yours"})
        catalog.drop("gone")
        if catalog.tables() != ["kept"] or catalog.properties("kept")["note"] != "yours":
            raise AssertionError("the catalog doesn't hold what it was told")
        return catalog.table("kept").groupBy(F.lit("kept").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice * 2 AS twice, 'filesystem,csv,|' AS said FROM orders")
def a50_descriptors(spark, sf_dir):
    """Orders written as CSV and read as a descriptor says: connector, format, options, schema, renamed and computed fields."""
    path = _scratch(spark)
    read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").write.option("sep", "|").csv(path)
    source = C.Source("filesystem", "csv", path, "k long, s string, x double", {"sep": "|"}, {"id": "k", "status": "s", "x": "x"}, {"twice": "x * 2"})
    said = source.properties()
    return source.load(spark).drop("x").withColumn("said", F.lit(",".join(said[k] for k in ("connector.type", "format.type", "connector.sep"))))


@query("SELECT l_quantity AS label, 2 AS size, round(l_tax, 4) AS a, round(l_discount, 4) AS b FROM lineitem")
def a52_libsvm(spark, sf_dir):
    path = _scratch(spark)
    rows = read_table(spark, sf_dir, "lineitem")
    rows.select(F.concat_ws(" ", F.col("l_quantity").cast("string"), F.concat(F.lit("1:"), "l_tax"), F.concat(F.lit("2:"), "l_discount"))).write.text(path)
    from pyspark.ml.functions import vector_to_array

    out = spark.read.format("libsvm").option("numFeatures", "2").load(path).withColumn("v", vector_to_array("features"))
    return out.select("label", F.size("v").alias("size"), F.round(F.col("v")[0], 4).alias("a"), F.round(F.col("v")[1], 4).alias("b"))


# joins, aggregates
@query("SELECT o_orderkey, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def c10_join_with_tiny(spark, sf_dir):
    n, r = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    tiny = R.join_with_hint(n, r, F.col("n_regionkey") == F.col("r_regionkey"), hint="broadcast_second")  # 25 rows by definition
    customers = R.join_with_hint(read_table(spark, sf_dir, "customer"), tiny, F.col("c_nationkey") == F.col("n_nationkey"), hint="broadcast_second")
    return read_table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "r_name")


@query(_unrolled("SELECT c_custkey AS id, 1 AS v FROM customer", "SELECT id, v + c_nationkey AS v FROM {r} JOIN customer ON id = c_custkey", 3, "SELECT id, v FROM {r}"))
def c13_cached_side_in_iterations(spark, sf_dir):
    """The side that stays the same is written once and joined in every superstep."""
    from lattica.plans.lineage import cut

    side = cut(read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey"), "side")
    start = side.select("id", F.lit(1).alias("v"))
    return G.bulk_iterate(start, lambda s: s.join(side, "id").select("id", (F.col("v") + F.col("c_nationkey")).alias("v")), 3)


@query("SELECT coalesce(c_nationkey, s_nationkey) AS k, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM customer FULL JOIN supplier ON c_nationkey = s_nationkey GROUP BY 1")
def c16_co_group_rows(spark, sf_dir):
    """Both sides' rows of a key, as they come."""
    a, b = read_table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey"), read_table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey")
    return R.co_group(a, b, ["k"], lambda key, x, y: pd.DataFrame([(key[0], len(x), len(y))], columns=["k", "customers", "suppliers"]), "k int, customers long, suppliers long")


@query("SELECT l_suppkey, max(l_extendedprice) AS m, count(*) AS n FROM lineitem GROUP BY 1")
def d33_partial_then_group(spark, sf_dir):
    """Both halves of an aggregate combine before the shuffle; the plan must show it."""
    out = read_table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.max("l_extendedprice").alias("m"), F.count(F.lit(1)).alias("n"))
    if "partial_max" not in out._jdf.queryExecution().executedPlan().toString():
        raise AssertionError("no partial aggregate")
    return out


# windows: properties, global windows, triggers, evictors, functions
@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS e, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 3599999 MILLISECOND AS r, count(*) AS n FROM events GROUP BY ALL")
def w11_window_properties(spark, sf_dir):
    sql = "SELECT TUMBLE_START(ts, INTERVAL '1' HOUR) AS s, TUMBLE_END(ts, INTERVAL '1' HOUR) AS e, TUMBLE_ROWTIME(ts, INTERVAL '1' HOUR) AS r, count(*) AS n FROM w11_events GROUP BY TUMBLE(ts, INTERVAL '1' HOUR)"
    return dialect.sql(spark, sql, w11_events=read_table(spark, sf_dir, "events"))


_NUMBERED = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events"


@query(f"SELECT user_id, rn // 3 AS fired, max(value) OVER (PARTITION BY user_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS hi FROM ({_NUMBERED}) QUALIFY rn % 3 = 0")
def w16_global_window(spark, sf_dir):
    """A window that never ends, with a trigger at every third row that doesn't purge."""
    n = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read_table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(n)).withColumn("hi", F.max("value").over(n.rowsBetween(Window.unboundedPreceding, 0)))
    return e.where("rn % 3 = 0").select("user_id", (F.col("rn") / 3).cast("long").alias("fired"), "hi")


@query("SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts) AS s, quantile_disc(value, 0.5) AS middle FROM events WHERE value IS NOT NULL GROUP BY ALL")
def w18_window_function(spark, sf_dir):
    """A function of all rows of a window: the lower median."""
    e = read_table(spark, sf_dir, "events").where("value IS NOT NULL").select("user_id", F.window("ts", "6 hours")["start"].alias("s"), "value")
    return e.groupBy("user_id", "s").agg(F.array_sort(F.collect_list("value")).alias("v")).select("user_id", "s", F.get("v", F.ceil(F.size("v") / 2).cast("int") - 1).alias("middle"))


@query("SELECT s, fired, sum(k) OVER (PARTITION BY s ORDER BY fired) AS n FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS s, time_bucket(INTERVAL 1 HOUR, ts) AS fired, count(*) AS k FROM events GROUP BY ALL)")
def w22_continuous_trigger(spark, sf_dir):
    """Early results of six-hour windows after every hour that had rows."""
    hours = read_table(spark, sf_dir, "events").groupBy(F.window("ts", "6 hours")["start"].alias("s"), F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("fired")).agg(F.count(F.lit(1)).alias("k"))
    return hours.select("s", "fired", F.sum("k").over(Window.partitionBy("s").orderBy("fired")).cast("decimal(38,0)").alias("n"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 1799999999 PRECEDING AND CURRENT ROW) AS n FROM events")
def w23_time_evictor(spark, sf_dir):
    """Each row's window holds what isn't older than half an hour."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("at").rangeBetween(-1_799_999_999, 0)
    return read_table(spark, sf_dir, "events").withColumn("at", at).select("event_id", F.count(F.lit(1)).over(w).alias("n"))


@query(f"SELECT user_id, event_id FROM (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY rn)) > 20 AS far FROM ({_NUMBERED})) WHERE far")
def w24_delta_trigger(spark, sf_dir):
    """Fires where a value is farther than a threshold from the one before."""
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return read_table(spark, sf_dir, "events").withColumn("far", F.abs(F.col("value") - before) > 20).where("far").select("user_id", "event_id")


@query("SELECT event_id, count(*) OVER w AS n, min(value) OVER w AS lo, round(avg(value) OVER w, 6) AS m, round(stddev_pop(value) OVER w, 4) AS sd FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)")
def w04_over_aggregates(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-5, 0)
    return read_table(spark, sf_dir, "events").select("event_id", F.count(F.lit(1)).over(w).alias("n"), F.min("value").over(w).alias("lo"), F.round(F.avg("value").over(w), 6).alias("m"), F.round(F.stddev_pop("value").over(w), 4).alias("sd"))


@query("SELECT event_id FROM events")
def o09_stream_partitioners(spark, sf_dir):
    e = stream_table(spark, sf_dir, "events").select("event_id")
    return W.run_to_end(e.repartition(4).repartition(3, "event_id").coalesce(1))


@query("SELECT event_id, ts AS t FROM events")
def f31_rowtime_materialised(spark, sf_dir):
    e = W.with_rowtime(stream_table(spark, sf_dir, "events"), "ts", "1 hour")
    return W.run_to_end(e.select("event_id", F.col("ts").cast("timestamp_ntz").alias("t")))


@query("SELECT n_nationkey, 7 AS a, 'ab' AS b FROM nation WHERE n_nationkey > 3")
def f38_constant_reduction(spark, sf_dir):
    out = dialect.sql(spark, "SELECT n_nationkey, 1 + 2 * 3 AS a, concat('a', lower('B')) AS b FROM f38_nation WHERE n_nationkey > 1 + 2 AND 1 = 1", f38_nation=read_table(spark, sf_dir, "nation"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    if "7 AS a" not in plan or "ab AS b" not in plan:
        raise AssertionError(plan)
    return out


# user code and its surroundings
@query("SELECT o_custkey AS key, count(DISTINCT o_orderstatus) AS kinds, max(o_orderkey) AS last FROM orders GROUP BY 1")
def v04_data_views(spark, sf_dir):
    """An aggregate whose accumulator is a map and a list."""
    m = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.collect_set("o_orderstatus").alias("seen"), F.max("o_orderkey").alias("last"))
    return m.select("key", F.size("seen").cast("long").alias("kinds"), "last")


@query("SELECT c_custkey, c_nationkey + 10 AS v FROM customer")
def v05_function_lifecycle(spark, sf_dir):
    """A function that opens something once per task and closes it at the end."""

    def run(frames):
        opened = {"offset": 10}
        try:
            for f in frames:
                yield f.assign(v=f.c_nationkey + opened["offset"]).drop(columns="c_nationkey")
        finally:
            opened.clear()

    return R.map_partition(read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), run, "c_custkey long, v int")


@query("SELECT n_nationkey, n_regionkey * 2 + 1 AS v FROM nation")
def v06_function_registration(spark, sf_dir):
    spark.udf.register("lattica_twice_plus", F.pandas_udf(lambda s, k: s * 2 + k, "int"))
    return dialect.sql(spark, "SELECT n_nationkey, lattica_twice_plus(n_regionkey, 1) AS v FROM v06_nation", v06_nation=read_table(spark, sf_dir, "nation"))


@query("SELECT n_nationkey, upper(substr(n_name, 1, 1)) AS c FROM nation WHERE length(n_name) > 5")
def v07_rich_functions(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    kept = R.map_partition(n, lambda frames: (f[f.n_name.str.len() > 5] for f in frames), "n_nationkey int, n_name string")
    return R.map_partition(kept, lambda frames: (f.assign(c=f.n_name.str[:1].str.upper()).drop(columns="n_name") for f in frames), "n_nationkey int, c string")


@query("SELECT 'n' || chr(10) || count(*) AS said FROM region")
def v13_command_line(spark, sf_dir):
    read_table(spark, sf_dir, "region").createOrReplaceTempView("v13_region")
    return spark.createDataFrame([(Client(spark).run("SELECT count(*) AS n FROM v13_region;"),)], "said string")


@query("SELECT true AS logical, true AS physical")
def v14_explain(spark, sf_dir):
    read_table(spark, sf_dir, "region").createOrReplaceTempView("v14_region")
    text = Client(spark).run("EXPLAIN SELECT r_name FROM v14_region WHERE r_regionkey > 1")
    return spark.createDataFrame([("Filter" in text, "Scan parquet" in text)], "logical boolean, physical boolean")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H') AS hour, 'spark.sql.session.timeZone=UTC' AS said FROM events")
def v15_configuration(spark, sf_dir):
    """The zone that the client sets is the one in which times are cast."""
    said = Client(spark).run("SET spark.sql.session.timeZone=UTC")
    return read_table(spark, sf_dir, "events").select("event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH").alias("hour"), F.lit(said).alias("said"))


# graphs and iteration
@query(_unrolled("SELECT src AS id, src AS value FROM e GROUP BY src", "SELECT r.id, least(r.value, coalesce(m.m, r.value)) AS value FROM {r} r LEFT JOIN (SELECT e.dst AS id, min({r}.value) AS m FROM e JOIN {r} ON {r}.id = e.src GROUP BY 1) m ON m.id = r.id", 3, "SELECT id, value FROM {r}", e=f"SELECT src, dst FROM {_BOTH}"))
def g04_pregel_steps(spark, sf_dir):
    """Three supersteps of least neighbours by messages."""
    e = G.undirected(_order_parts(spark, sf_dir))
    return _three_steps(spark, e, lambda state: G.scatter_gather(state, e, F.col("value"), F.min("msg"), F.least("value", "msg")))


def _three_steps(spark: SparkSession, edges: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return G.bulk_iterate(G.vertices_of(edges).withColumn("value", F.col("id")), step, 3)


@query(f"SELECT src AS id, src + least(0, min(dst)) AS value FROM {_BOTH} GROUP BY src")
def g05_scatter_gather(spark, sf_dir):
    e = G.undirected(_order_parts(spark, sf_dir))
    start = G.vertices_of(e).withColumn("value", F.col("id"))
    return G.scatter_gather(start, e, F.col("value"), F.min("msg"), F.col("value") + F.least(F.lit(0), "msg"))


@query(f"SELECT src AS id, CAST(sum(dst) + src AS BIGINT) AS value FROM {_BOTH} GROUP BY src")
def g06_gather_sum_apply(spark, sf_dir):
    e = G.undirected(_order_parts(spark, sf_dir))
    start = G.vertices_of(e).withColumn("value", F.col("id"))
    return G.gather_sum_apply(start, e, F.col("neighbor"), F.sum("gathered"), F.col("value") + F.col("summed"))


_HALVED = "WITH RECURSIVE r AS (SELECT o_orderkey AS id, CAST(o_totalprice AS DOUBLE) AS v FROM orders UNION ALL SELECT id, v / 2 FROM r WHERE v >= 1000) SELECT id, v FROM r WHERE v < 1000"


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("v"))


@query(_HALVED)
def g18_bulk_iteration(spark, sf_dir):
    """All orders go through every superstep, in which prices from 1000 up are halved, until there are none."""
    halve = lambda s: s.withColumn("v", F.when(F.col("v") >= 1000, F.col("v") / 2).otherwise(F.col("v")))
    return G.bulk_iterate(_prices(spark, sf_dir), halve, 30, done=lambda s: s.where("v >= 1000").isEmpty(), settle=True)


@query(_HALVED)
def g19_delta_iteration(spark, sf_dir):
    """The same with a workset: only orders that changed are looked at again."""
    start = _prices(spark, sf_dir)
    return G.delta_iterate(start, start, "id", lambda s, w: w.where("v >= 1000").withColumn("v", F.col("v") / 2), 30, settle=True)


@query(f"SELECT src + 1 AS src, dst FROM {_ORDER_PARTS}")
def g29_map_edges(spark, sf_dir):
    return _order_parts(spark, sf_dir).select((F.col("src") + 1).alias("src"), "dst")


@query("SELECT c_custkey, round(c_acctbal, 2) AS p1, round(c_acctbal * c_acctbal, 2) AS p2 FROM customer")
def g20_polynomial_features(spark, sf_dir):
    p = ml.polynomial_features(F.col("c_acctbal"), 2)
    return read_table(spark, sf_dir, "customer").select("c_custkey", F.round(p[1], 2).alias("p1"), F.round(p[0], 2).alias("p2"))


@query("SELECT count(DISTINCT (l_orderkey, l_linenumber)) AS n, count(*) AS parts, 5 AS folds, 0 AS shared FROM lineitem")
def g34_cross_validation(spark, sf_dir):
    df = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    folds = ml.k_fold(df, 5, "l_orderkey")
    tests = [test.withColumn("fold", F.lit(i)) for i, (_, test) in enumerate(folds)]
    both = tests[0]
    for t in tests[1:]:
        both = both.union(t)
    shared = folds[0][0].join(folds[0][1], ["l_orderkey"], "left_semi").agg(F.count(F.lit(1)).alias("shared"))
    return both.agg(F.count_distinct("l_orderkey", "l_linenumber").alias("n"), F.count(F.lit(1)).alias("parts"), F.count_distinct("fold").cast("int").alias("folds")).crossJoin(shared)  # one row each


@query("SELECT count(*) AS n, true AS near FROM lineitem")
def x09_pi(spark, sf_dir):
    """A point of the square for each line item, from hashes of its key: within five standard errors."""
    unit = lambda seed: F.pmod(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit(seed)), F.lit(1 << 30)) / float(1 << 29) - 1
    inside = read_table(spark, sf_dir, "lineitem").select((F.pow(unit(3), 2) + F.pow(unit(4), 2) <= 1).cast("int").alias("i"))
    return inside.agg(F.count(F.lit(1)).alias("n"), (F.abs(4 * F.avg("i") - F.pi()) < 5 * 1.65 / F.sqrt(F.count(F.lit(1)))).alias("near"))


@query("SELECT count(*) AS n, true AS converged FROM orders")
def g23_als(spark, sf_dir):
    """Ratings by customer and priority, factorised; the error must be under that of the mean."""
    r = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("int").alias("user"), F.substring("o_orderpriority", 1, 1).cast("int").alias("item"), (F.col("o_totalprice") / 100000).cast("float").alias("rating"))
    out = ml.als(r, "user", "item", "rating", rank=4, steps=5)
    mean = r.agg(F.avg("rating").alias("m"))
    return out.crossJoin(mean).agg(F.count(F.lit(1)).alias("n"), (F.avg(F.pow(F.col("prediction") - F.col("rating"), 2)) < F.avg(F.pow(F.col("rating") - F.col("m"), 2))).alias("converged"))


@query("SELECT event_type AS key, round(sum(value), 4) AS s, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1")
def s09_reducing_state(spark, sf_dir):
    log = W.run_to_end(stateful.split_aggregates(stream_table(spark, sf_dir, "events"), "event_type", "value"))
    return stateful.merge_shards(stateful.materialize(log.select("key", "shard", "s", "lo", "hi", "_op"))).withColumn("s", F.round("s", 4))
