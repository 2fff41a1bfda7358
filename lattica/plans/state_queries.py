"""Queries over streams whose state is read from outside, windows by row time, control streams and the rolling sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.plans.frame_queries import _scratch, query
from lattica.session import read_table, stream_table
from lattica.sources import bucket_sink, upsert_sink
from lattica.streaming import control, firing, lateness, over, state, stateful, watermarks, windows as W


# state from outside
@query("""WITH k AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
kinds AS (SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS kinds FROM k GROUP BY user_id)
SELECT user_id AS key, count(*) AS n, max(value) AS hi, array_to_string(list(event_id ORDER BY ts, event_id)[-3:], ',') AS recent, any_value(kinds) AS kinds FROM events JOIN kinds USING (user_id) GROUP BY user_id""")
def s22_queryable_state(spark, sf_dir):
    """Value, list and map state of every key, read from the checkpoint after the query has ended."""
    checkpoint = _scratch(spark)
    events = stream_table(spark, sf_dir, "events")
    W.run_to_end(stateful.keyed_states(events, "user_id", "ts", "event_id", "event_type", "value"), checkpoint=checkpoint)
    total, recent, kinds = (state.by_key(spark, checkpoint, name, "bigint") for name in ("n", "recent", "kinds"))
    ids = recent.select("key", F.concat_ws(",", F.transform("items", lambda i: i.cast("string"))).alias("recent"))
    pairs = F.array_sort(F.transform(F.arrays_zip("kinds", "ns"), lambda e: F.concat_ws(":", e["kinds"], e["ns"].cast("string"))))
    return total.join(ids, "key").join(kinds.select("key", F.concat_ws(",", pairs).alias("kinds")), "key")


@query("SELECT user_id AS key, max(value) AS hi, count(*) AS n FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY user_id")
def s22_state_lookup(spark, sf_dir):
    """The state of the keys that another table names."""
    checkpoint = _scratch(spark)
    events = stream_table(spark, sf_dir, "events")
    W.run_to_end(stateful.keyed_states(events, "user_id", "ts", "event_id", "event_type", "value"), checkpoint=checkpoint)
    wanted = read_table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key"))
    return state.lookup(spark, checkpoint, "n", wanted, packed="bigint").select("key", "n", "hi")


@query("SELECT user_id AS key, count(*) AS n, round(sum(value), 4) AS s, min(CASE WHEN event_id % 2 = 1 THEN value END) AS lo, max(CASE WHEN event_id % 2 = 1 THEN value END) AS hi FROM events GROUP BY user_id")
def s20_savepoint(spark, sf_dir):
    """The first half of the events ends in a savepoint; a second query with wider state begins with it and takes the other half."""
    first, second, target = _scratch(spark), _scratch(spark), _scratch(spark)
    events = stream_table(spark, sf_dir, "events")
    W.run_to_end(state.totals(events.where("event_id % 2 = 0"), "user_id", "value"), "update", checkpoint=first)
    state.savepoint(spark, first, ["acc"], target)
    W.run_to_end(state.totals(events.where("event_id % 2 = 1"), "user_id", "value", wide=True, initial=state.saved(spark, target, "acc")), "update", checkpoint=second)
    return state.state_of(spark, second, "acc").withColumn("s", F.round("s", 4))


# OVER by row time
_PASSED = "WITH e AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) AS us, value AS v FROM events), o AS (SELECT key, id, us, count(*) OVER w AS n, count(v) OVER w AS c, sum(v) OVER w AS s, min(v) OVER w AS lo, max(v) OVER w AS hi FROM e WINDOW w AS (PARTITION BY key {}))\nSELECT key, id, us, n, c, round(s, 4) AS s, lo, hi FROM o WHERE us <= (SELECT max(us) // 1000 * 1000 FROM e)"


def _over(spark, sf_dir, **window):
    out = over.over_time(stream_table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value", **window)
    return W.run_to_end(out).withColumn("s", F.round("s", 4))


@query(_PASSED.format("ORDER BY us RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW"))
def w03_over_range_stream(spark, sf_dir):
    return _over(spark, sf_dir, range_us=6 * 3_600_000_000)


@query(_PASSED.format("ORDER BY us, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW"))
def w03_over_rows_stream(spark, sf_dir):
    return _over(spark, sf_dir, rows=4)


@query(_PASSED.format("ORDER BY us RANGE UNBOUNDED PRECEDING"))
def w03_over_unbounded_range_stream(spark, sf_dir):
    return _over(spark, sf_dir)


@query(_PASSED.format("ORDER BY us, id ROWS UNBOUNDED PRECEDING"))
def w03_over_unbounded_rows_stream(spark, sf_dir):
    return _over(spark, sf_dir, by_rows=True)


# control streams and side inputs
@query("""WITH e AS (SELECT *, epoch_us(ts) AS us FROM events), r AS (SELECT event_type, us, value AS rule FROM e WHERE event_id % 50 = 0)
SELECT event_id, e.event_type, value, rule AS side_rule FROM e ASOF JOIN r ON e.event_type = r.event_type AND e.us >= r.us WHERE e.us <= (SELECT max(us) // 1000 * 1000 FROM e) AND value > rule""")
def s10_control_stream(spark, sf_dir):
    """Every fiftieth event sets a new threshold for its type from then on; events above the threshold of their time."""
    events = stream_table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    rules = stream_table(spark, sf_dir, "events").where("event_id % 50 = 0").select("event_type", "ts", "event_id", F.col("value").alias("rule"))
    met = control.control_join(events, rules, "event_type", "ts", "event_id", "rule", how="inner")
    return W.run_to_end(met.where("value > side_rule")).select("event_id", "event_type", "value", "side_rule")


@query("""WITH e AS (SELECT *, epoch_us(ts) AS us FROM events), r AS (SELECT user_id, us, value AS paid FROM e WHERE event_type = 'purchase')
SELECT event_id, e.user_id, paid AS side_paid, r.us AS since FROM e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.us >= r.us WHERE e.us <= (SELECT max(us) // 1000 * 1000 FROM e)""")
def c20_keyed_side_input(spark, sf_dir):
    """Each event with its user's latest purchase at its time."""
    events = stream_table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    side = stream_table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", "ts", "event_id", F.col("value").alias("paid"))
    met = W.run_to_end(control.keyed_side_input(events, side, "user_id", "ts", "event_id", "paid"))
    return met.select("event_id", "user_id", "side_paid", F.unix_micros("side_since").alias("since"))


# rolling sink
@query("SELECT event_id, user_id, value, strftime(ts, '%Y-%m-%d') AS bucket FROM events")
def a40_rolling_sink(spark, sf_dir):
    """Files by day that roll at 64 kB, committed in two phases."""
    path = _scratch(spark)
    events = stream_table(spark, sf_dir, "events")
    bucket_sink.write_bucketed(events, path, "ts", _scratch(spark), "yyyy-MM-dd", roll_bytes=64 << 10).awaitTermination()
    return bucket_sink.read_bucketed(spark, path, events.schema).select("event_id", "user_id", "value", "bucket")


@query("SELECT client_id, seq, source, segment, city, balance FROM client_changes WHERE client_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY seq DESC, change_id DESC) = 1 AND op <> 'D'")
def a44_keyed_upsert_stream(spark, sf_dir):
    """The clients after all changes, which come in three batches out of order and with repeats."""
    base, changes = _scratch(spark), read_table(spark, sf_dir, "client_changes")
    table = upsert_sink.KeyedTable(spark, f"{base}/table", changes.schema, ["client_id"], ["seq", "change_id"], buckets=16)
    for part in (2, 0, 1):
        changes.where(F.col("change_id") % 3 == part).write.mode("append").parquet(f"{base}/in")
        table.write(spark.readStream.schema(changes.schema).parquet(f"{base}/in"), f"{base}/checkpoint").awaitTermination()
    return table.read().select("client_id", "seq", "source", "segment", "city", "balance")


@query("""WITH e AS (SELECT event_type AS key, epoch_us(ts) // 1000 AS ms, value FROM events), h AS (SELECT key, ms // 3600000 * 3600000 AS slice, count(*) AS k, count(value) AS kc, sum(value) AS ks FROM e GROUP BY ALL)
SELECT key, slice // 21600000 * 21600000 AS window_ms, slice + 3600000 AS fired_ms, CAST(sum(k) OVER w AS BIGINT) AS n, CAST(sum(kc) OVER w AS BIGINT) AS c, round(sum(ks) OVER w, 4) AS s, (slice + 3600000) % 21600000 = 0 AS final
FROM h WHERE slice + 3600000 <= (SELECT max(ms) FROM e) WINDOW w AS (PARTITION BY key, slice // 21600000 ORDER BY slice)""")
def w22_early_firing_stream(spark, sf_dir):
    """Six-hour windows of each event type that fire after every hour with rows."""
    return W.run_to_end(firing.early_windows(stream_table(spark, sf_dir, "events"), "event_type", "ts", "value", 21_600_000, 3_600_000)).withColumn("s", F.round("s", 4))


@query("""WITH c AS (SELECT click_id, epoch_us(ts) AS us, coalesce(month(arrived_at), 0) AS month FROM clicks), m AS (SELECT month, max(us) AS most FROM c GROUP BY 1),
w AS (SELECT month, max(most) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM m)
SELECT click_id, month, coalesce(us <= mark - 86400000000, false) AS late FROM c JOIN w USING (month)""")
def s06_late_by_watermark(spark, sf_dir):
    """Clicks come month by month of their arrival; those more than a day behind the watermark are late."""
    base = _scratch(spark)
    clicks = read_table(spark, sf_dir, "clicks").select("click_id", "ts", F.coalesce(F.month("arrived_at"), F.lit(0)).cast("long").alias("month"))
    out = None
    for month in sorted(r[0] for r in clicks.select("month").distinct().collect()):  # twelve at most
        clicks.where(F.col("month") == month).write.mode("append").parquet(f"{base}/in")
        out = lateness.with_lateness(spark.readStream.schema(clicks.schema).parquet(f"{base}/in"), "ts", 86_400_000_000, base)
    return out.select("click_id", "month", "late")


# watermarks by strategy
_SIX = 21_600_000_000


def _by_mark(level: str, columns: str = "") -> str:
    """Clicks in batches by month of arrival; ``level`` is a CTE ``lv`` of each batch's own mark."""
    return f"""WITH c0 AS (SELECT click_id, coalesce(kind, 'none') AS kind, value, epoch_us(ts) AS us, coalesce(month(arrived_at), 0) AS month, coalesce(quarter(arrived_at), 0) AS quarter FROM clicks),
c AS (SELECT *, us // {_SIX} * {_SIX} AS start_us, dense_rank() OVER (ORDER BY month) - 1 AS b FROM c0), {level},
l AS (SELECT b, max(lv) OVER (ORDER BY b) AS level, max(lv) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM lv),
j AS (SELECT c.*, coalesce(start_us + {_SIX} <= past, false) AS late FROM c JOIN l USING (b)),
w AS (SELECT kind AS key, start_us, count(*) AS n, count(value) AS c, round(sum(value), 4) AS s FROM j WHERE us IS NOT NULL AND NOT late GROUP BY ALL)
"""


def _in_months(spark, sf_dir, strategy, **options):
    base = _scratch(spark)
    clicks = read_table(spark, sf_dir, "clicks").select("click_id", F.coalesce("kind", F.lit("none")).alias("kind"), "value", "ts", F.coalesce(F.month("arrived_at"), F.lit(0)).alias("month"), F.coalesce(F.quarter("arrived_at"), F.lit(0)).cast("string").alias("quarter"))
    clicks, out = clicks.withColumn("producer", F.concat_ws("-", "kind", "quarter")), None
    for month in sorted(r[0] for r in clicks.select("month").distinct().collect()):  # thirteen at most
        clicks.where(F.col("month") == month).write.mode("append").parquet(f"{base}/in")
        out = watermarks.windows_by_mark(spark.readStream.schema(clicks.schema).parquet(f"{base}/in"), "kind", "ts", "value", _SIX, strategy, base, **options)
    return out


_PUNCTUATED = "lv AS (SELECT b, max(us) FILTER (kind = 'purchase') AS lv FROM c GROUP BY b)"
_FIRED = f"SELECT w.*, (SELECT min(b) FROM l WHERE level >= start_us + {_SIX}) AS batch FROM w WHERE start_us + {_SIX} <= (SELECT max(level) FROM l)"


@query(_by_mark(_PUNCTUATED) + _FIRED)
def s04_punctuated_windows(spark, sf_dir):
    """Six-hour windows of clicks by kind that close when a purchase of a later time has come."""
    return _in_months(spark, sf_dir, watermarks.punctuated("kind = 'purchase'")).windows.withColumn("s", F.round("s", 4))


@query(_by_mark(_PUNCTUATED) + "SELECT click_id, b AS batch FROM j WHERE late")
def s04_punctuated_late(spark, sf_dir):
    """The clicks whose window a purchase of an earlier batch has closed."""
    return _in_months(spark, sf_dir, watermarks.punctuated("kind = 'purchase'")).late.select("click_id", "batch")


_ACTIVE = """m AS (SELECT kind || '-' || quarter AS producer, b, max(us) - 86400000000 AS mk FROM c GROUP BY ALL), r AS (SELECT x.b, producer, max(mk) AS mk, max(m.b) AS seen FROM (SELECT DISTINCT b FROM c) x JOIN m ON m.b <= x.b GROUP BY ALL),
lv AS (SELECT b, CASE WHEN count(mk) = count(*) THEN min(mk) END AS lv FROM r {} GROUP BY b)"""


@query(_by_mark(_ACTIVE.format("WHERE seen = b")) + _FIRED)
def s05_idle_sources(spark, sf_dir):
    """Each kind has another producer in each quarter: those of the last quarter fall idle and don't hold the windows open."""
    return _in_months(spark, sf_dir, watermarks.periodic(86_400_000_000), source="producer", idle_batches=1).windows.withColumn("s", F.round("s", 4))


@query(_by_mark(_ACTIVE.format("")) + _FIRED)
def s05_silent_sources(spark, sf_dir):
    """The same without idleness: producers that have gone silent hold the windows of the next quarter open."""
    return _in_months(spark, sf_dir, watermarks.periodic(86_400_000_000), source="producer").windows.withColumn("s", F.round("s", 4))
