"""Row-time windows, control streams, state from outside and the rolling sink over several micro-batches, against brute force."""

import os
import random
import shutil
import uuid

import pytest
from pyspark.sql import functions as F

from lattica.operators import relational as R
from lattica.sources import bucket_sink, upsert_sink
from lattica.streaming import control, firing, over, state, windows as W

ROW = "k string, t timestamp, i long, v double"


def batches(spark, path, parts, schema):
    """A stream that takes one file of rows at a time, in order."""
    for n, rows in enumerate(parts):
        frame = spark.createDataFrame(rows, schema.replace("t timestamp", "t long"))
        frame = frame.withColumn("t", F.timestamp_micros("t"))
        frame.select(*[c.split()[0] for c in schema.split(", ")]).coalesce(1).write.parquet(f"{path}/draft{n}")
        found = next(f for f in os.listdir(f"{path}/draft{n}") if f.endswith(".parquet"))
        os.makedirs(f"{path}/in", exist_ok=True)
        os.rename(f"{path}/draft{n}/{found}", f"{path}/in/{n:03}.parquet")
        os.utime(f"{path}/in/{n:03}.parquet", (n + 1, n + 1))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def window(rows, by_rows, reach):
    out = []
    for k, t, i, _ in rows:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        at = next(n for n, r in enumerate(mine) if r[2] == i)
        if by_rows:
            seen = mine[0 if reach is None else max(0, at - reach) : at + 1]
        else:
            seen = [r for r in mine if r[1] <= t and (reach is None or r[1] >= t - reach)]
        vs = [r[3] for r in seen if r[3] is not None]
        out.append((k, i, t, len(seen), len(vs), round(sum(vs), 6) if vs else None, min(vs, default=None), max(vs, default=None)))
    return sorted(out)


@pytest.mark.parametrize("options, by_rows, reach", [({"rows": 3}, True, 3), ({"range_us": 5000}, False, 5000), ({}, False, None), ({"by_rows": True}, True, None)])
def test_over_time_of_rows_out_of_order(spark, tmp_path, options, by_rows, reach):
    rng = random.Random(4)
    base = 1_700_000_000_000_000
    rows = [(rng.choice("ab"), base + n * 700 + rng.choice([-2100, -1, 0, 0, 700]), n, rng.choice([None, 1.5, 2.0, 9.0, -3.0])) for n in range(60)]
    rows[30] = (rows[30][0], rows[29][1], 30, 4.0)
    late = ("a", base - 10_000_000, 999, 1.0)  # far behind the watermark of the batches before
    parts = [rows[:20], rows[20:40], [*rows[40:], late]]
    passed = (max(r[1] for r in rows) // 1000 - 10) * 1000
    got = W.run_to_end(over.over_time(batches(spark, tmp_path, parts, ROW), "k", "t", "i", "v", "10 milliseconds", **options))
    found = sorted((r.key, r.id, r.us, r.n, r.c, None if r.s is None else round(r.s, 6), r.lo, r.hi) for r in got.collect())
    want = [w for w in window(rows, by_rows, reach) if w[2] <= passed]
    assert len(want) > 30 and found == want
    batch = spark.createDataFrame(rows, ROW.replace("timestamp", "long")).withColumn("t", F.timestamp_micros("t"))
    again = over.over_time(batch, "k", "t", "i", "v", **options).collect()
    assert sorted((r.key, r.id, r.us, r.n, r.c, None if r.s is None else round(r.s, 6), r.lo, r.hi) for r in again) == window(rows, by_rows, reach)


def test_over_time_takes_one_kind_of_bound(spark):
    with pytest.raises(ValueError):
        over.over_time(spark.range(1), "id", "id", "id", "id", rows=1, range_us=1)


@pytest.mark.parametrize("keyed", [False, True])
def test_side_rows_hold_from_their_time_on(spark, tmp_path, keyed):
    """Rules change half-way, come late and tie; main rows come before their rule does."""
    rng = random.Random(9)
    base = 1_700_000_000_000_000
    main = [(rng.choice(["a", "b", None]), base + rng.randrange(40) * 500, n, float(n)) for n in range(50)]
    rules = [("a", base + 5000, 1, 10.0), ("a", base + 12_000, 2, 20.0), ("a", base + 12_000, 3, 30.0), ("b", base + 9000, 4, None), (None, base, 5, 1.0)]
    parts = [main[:25], main[25:], []]
    sides = [rules[1:2], rules[:1], rules[2:]]
    end = [("end", base + 60_000_000, 1000, 0.0)]
    m = batches(spark, f"{tmp_path}/m", [*parts, end], ROW)
    s = batches(spark, f"{tmp_path}/s", [*sides, []], ROW)
    join = control.keyed_side_input if keyed else control.control_join
    got = W.run_to_end(join(m, s, "k", "t", "i", "v", "1 second", **({} if keyed else {"groups": 5})))
    want = []
    for k, t, i, v in main:
        known = sorted((r for r in rules if k is not None and r[0] == k and r[1] <= t), key=lambda r: (r[1], r[2]))
        want.append((k, i, v, *((known[-1][3], known[-1][1]) if known else (None, None))))
    found = [(r.k, r.i, r.v, r.side_v, r.since) for r in got.withColumn("since", F.unix_micros("side_since")).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_savepoint_of_narrow_state_begins_a_wider_query(spark, tmp_path):
    first, second, target = (f"{tmp_path}/{n}" for n in ("c1", "c2", "save"))
    before = batches(spark, f"{tmp_path}/x", [[("a", 1, 1, 2.0), ("b", 1, 2, None)], [("a", 1, 3, 5.0)]], ROW)
    W.run_to_end(state.totals(before, "k", "v"), "update", checkpoint=first)
    assert sorted(tuple(r) for r in state.state_of(spark, first, "acc").collect()) == [("a", 2, 7.0), ("b", 1, None)]
    assert state.state_of(spark, first, "acc", batch=0).where("key = 'a'").first()["n"] == 1
    assert {r["stateStoreName"] for r in state.variables(spark, first).collect()}
    state.savepoint(spark, first, ["acc"], target)
    shutil.rmtree(first)  # a savepoint needs neither the query nor its checkpoint
    after = batches(spark, f"{tmp_path}/y", [[("a", 1, 4, 1.0), ("c", 1, 5, 3.0)]], ROW)
    W.run_to_end(state.totals(after, "k", "v", wide=True, initial=state.saved(spark, target, "acc")), "update", checkpoint=second)
    got = state.state_of(spark, second, "acc")
    assert sorted(tuple(r) for r in got.collect()) == [("a", 3, 8.0, 1.0, 1.0), ("b", 1, None, None, None), ("c", 1, 3.0, 3.0, 3.0)]
    assert [r["key"] for r in state.lookup(spark, second, "acc", spark.createDataFrame([("c",), ("c",), ("z",)], "key string")).collect()] == ["c"]


def rows_of(spark, path, schema):
    return sorted((r.i, r.bucket) for r in bucket_sink.read_bucketed(spark, path, schema).collect())


def test_sink_is_exactly_once_after_a_failed_task_and_a_repeated_batch(spark, tmp_path):
    day = 86_400_000_000
    parts = [[("a", n * day // 4, n, 1.0) for n in range(8)] + [("a", None, 100, 1.0)], [("b", n * day // 4, n, 2.0) for n in range(8, 16)]]
    stream = batches(spark, tmp_path, parts, ROW)
    fail = f"{tmp_path}/fail"
    open(fail, "w").close()

    def breaks(frames):
        for f in frames:
            if os.path.exists(fail) and (f["i"] == 12).any():
                yield f[f["i"] < 12]  # some rows have reached the sink by then
                raise RuntimeError("a task is lost")
            yield f

    target, checkpoint = f"file://{tmp_path}/out", f"{tmp_path}/checkpoint"
    through = stream.mapInPandas(breaks, ROW)
    query = bucket_sink.write_bucketed(through, target, "t", checkpoint, "yyyy-MM-dd", roll_bytes=1)
    with pytest.raises(Exception, match="a task is lost"):
        query.awaitTermination()
    want = sorted((n, f"1970-01-0{1 + n // 4}") for n in range(16))
    first = [w for w in want if w[0] < 8] + [(100, "unknown")]
    assert rows_of(spark, target, stream.schema) == first
    os.remove(fail)
    bucket_sink.write_bucketed(through, target, "t", checkpoint, "yyyy-MM-dd").awaitTermination()
    assert rows_of(spark, target, stream.schema) == want + [(100, "unknown")]
    # The driver dies after the sink's commit and before Spark's own: the batch comes again.
    for name in ("1", ".1.crc"):
        if os.path.exists(f"{checkpoint}/commits/{name}"):
            os.remove(f"{checkpoint}/commits/{name}")
    bucket_sink.write_bucketed(through, target, "t", checkpoint, "yyyy-MM-dd").awaitTermination()
    assert rows_of(spark, target, stream.schema) == want + [(100, "unknown")]
    left = [f for _, _, files in os.walk(f"{tmp_path}/out") for f in files if f.endswith((".pending", ".in-progress"))]
    assert left == []


def test_sink_rolls_files_and_finishes_a_half_done_commit(spark, tmp_path):
    stream = batches(spark, tmp_path, [[("a", 0, n, 1.0) for n in range(5000)]], ROW)
    target, checkpoint = f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        bucket_sink.write_bucketed(stream, target, "t", checkpoint, roll_bytes=1).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    files = [f for f in os.listdir(f"{target}/1970-01-01--00") if f.endswith(".parquet")]
    assert len(files) == 5 and len(rows_of(spark, target, stream.schema)) == 5000
    renamed = files[0]
    os.rename(f"{target}/1970-01-01--00/{renamed}", f"{target}/1970-01-01--00/{renamed.removeprefix('part-0').removesuffix('.parquet')}.pending")
    open(f"{target}/1970-01-01--00/_{uuid.uuid4().hex}.in-progress", "w").close()
    bucket_sink.recover(target)
    assert sorted(f for f in os.listdir(f"{target}/1970-01-01--00") if not f.endswith(".crc")) == sorted(files)


def test_indexes_of_wide_frames_are_dense(spark):
    wide = spark.range(2_000_000).select("id", F.xxhash64("id").alias("k"), F.concat(F.lit("some text of row "), "id").alias("text"), F.lit(1).alias("a.b"))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = R.zip_with_index(wide.orderBy("k"), "index")
        checks = got.agg(F.count("*").alias("n"), F.countDistinct("index").alias("d"), F.min("index").alias("lo"), F.max("index").alias("hi"), F.max(F.length("text")).alias("x"), F.sum("`a.b`").alias("ones")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert tuple(checks)[:4] == (2_000_000, 2_000_000, 0, 1_999_999) and checks["ones"] == 2_000_000


def test_keyed_table_takes_changes_in_any_order_and_batches_twice(spark, tmp_path):
    rows = [(1, "a", 1, "I", 1.0), (2, "a", 3, "D", None), (3, "a", 2, "U", 2.0), (4, "b", 1, "I", 4.0), (5, None, 1, "I", 5.0), (6, "b", 2, "U", 6.0), (7, "c", 1, None, 7.0), (7, "c", 1, None, 7.0)]
    frame = spark.createDataFrame(rows, "i long, k string, seq long, op string, v double")
    table = upsert_sink.KeyedTable(spark, f"{tmp_path}/t", frame.schema, ["k"], ["seq", "i"], buckets=3)
    assert table.read().count() == 0
    for number, ids in enumerate(([2, 4, 5], [1, 7], [3, 6])):
        table.apply(frame.where(F.col("i").isin(ids)), number)
        table.apply(frame.where(F.col("i").isin(ids)), number)  # the batch comes again
    assert sorted((r.k, r.seq, r.v) for r in table.read().collect()) == [("b", 2, 6.0), ("c", 1, 7.0)]
    table.apply(frame.limit(0), 3)
    assert table.read().count() == 2


def test_windows_fire_early_whatever_the_order(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.randrange(4_000_000), n, rng.choice([None, 1.0, 2.5])) for n in range(60)] + [("z", 60_000_000, 99, 1.0)]
    got = W.run_to_end(firing.early_windows(batches(spark, tmp_path, [rows[:30], rows[30:]], ROW), "k", "t", "v", 1000, 250, "1 hour"))
    assert got.count() == 0  # nothing is that far behind
    stream = batches(spark, f"{tmp_path}/again", [rows[:30], rows[30:60], rows[60:]], ROW)
    found = sorted(tuple(r) for r in W.run_to_end(firing.early_windows(stream, "k", "t", "v", 1000, 250, "10 seconds")).where("key <> 'z'").collect())
    want = []
    for k, w, f in sorted({(k, t // 1000 // 1000 * 1000, t // 1000 // 250 * 250 + 250) for k, t, _, _ in rows[:60]}):
        seen = [v for k2, t, _, v in rows[:60] if k2 == k and w <= t // 1000 < f]
        values = [v for v in seen if v is not None]
        want.append((k, w, f, len(seen), len(values), sum(values) if values else None, f == w + 1000))
    assert found == want


def _calls():
    """Counts the processors' calls to the state and to timers; the streams run in the tests' own process."""
    from collections import Counter

    counts = Counter()

    class Held:
        def __init__(self, name):
            self.name, self.value, self.table, self.rows = name, None, {}, []

        def __getattr__(self, call):
            def run(*args):
                counts[call] += 1
                if call == "exists":
                    return bool(self.table or self.rows or self.value)
                if call == "get":
                    return iter(self.rows) if self.name == "list" else self.value
                if call in ("update", "clear"):
                    self.value, self.rows = (args or (None,))[0], []
                elif call == "put":
                    self.rows = list(args[0])
                elif call == "appendList":
                    self.rows += args[0]
                elif call == "iterator":
                    return iter(self.table.items())
                elif call in ("containsKey", "getValue", "updateValue", "removeKey"):
                    return {"containsKey": self.table.__contains__, "getValue": self.table.get, "removeKey": self.table.pop}.get(call, self.table.__setitem__)(*args)
                return None

            return run

    class Handle:
        def getValueState(self, *_):
            return Held("value")

        def getListState(self, *_):
            return Held("list")

        def getMapState(self, *_):
            return Held("map")

        def registerTimer(self, ms):
            counts["registerTimer"] += 1

        def deleteTimer(self, ms):
            counts["deleteTimer"] += 1

    class Times:
        def getCurrentWatermarkInMs(self):
            return 10**15

    return counts, Handle(), Times()


@pytest.mark.parametrize("kind", ["sort", "over", "reached", "as of", "changes", "values", "keyed"])
def test_calls_to_the_state_do_not_grow_with_a_keys_rows(kind):
    import pandas as pd

    from lattica.streaming import stateful

    make = {"sort": stateful._TimeSort, "over": lambda: over._Over(True, None), "reached": lambda: over._Over(False, 5000), "as of": control._AsOf, "changes": lambda: stateful._Changelog(["key"], None, False), "values": lambda: stateful._Changelog(["key"], None, True), "keyed": stateful._Keyed}[kind]
    seen = []
    for n in (100, 2000):
        counts, handle, times = _calls()
        processor = make()
        processor.init(handle)
        i = range(n)
        frame = pd.DataFrame({"in_ms": i, "in_us": [1000 * x for x in i], "in_id": i, "in_value": [float(x) for x in i], "in_op": [1] * n, "in_side": [x % 2 for x in i], "in_key": ["k"] * n, "in_tie": i, "in_row": [str(x) for x in i], "in_time": pd.to_datetime(list(i)), "in_kind": ["a"] * n})
        out = list(processor.handleInputRows(("k",), iter([frame]), times))
        if hasattr(processor, "waiting"):
            out += list(processor.handleExpiredTimer(("k",), times, None))
        assert sum(map(len, out)) == {"as of": n // 2, "changes": 2 * n - 1, "values": 2 * n - 1}.get(kind, n)
        seen.append(sum(counts.values()))
    assert seen[0] == seen[1] and seen[1] < 80


def test_a_key_dealt_to_shards_keeps_its_aggregates(spark, tmp_path):
    from lattica.streaming import stateful

    rng = random.Random(6)
    kept = [(rng.choice("ab"), rng.choice([None, 0.0, -1.5, 2.5, 7.0, float(n)])) for n in range(200)]
    gone = [("a", -99.0), ("a", 999.0), ("b", 999.0)]
    rows = [(k, v, 1) for k, v in kept + gone] + [(k, v, -1) for k, v in gone]
    rng.shuffle(rows)
    for i, part in enumerate((rows[:70], rows[70:])):
        spark.createDataFrame(part, "k string, v double, _op int").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("k string, v double, _op int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = stateful.merge_shards(stateful.materialize(W.run_to_end(stateful.split_aggregates(stream, "k", "v", 7)))).collect()
    want = set()
    for key in "ab":
        vs = [v for k, v in kept if k == key]
        there = [v for v in vs if v is not None]
        want.add((key, len(vs), len(there), round(sum(there), 6), min(there), max(there), len(set(there))))
    assert {(r.key, r.n, r.c, round(r.s, 6), r.lo, r.hi, r.d) for r in got} == want


def test_left_rows_wait_for_the_right_ones_in_their_bucket(spark, tmp_path):
    from lattica.streaming import stateful

    for i, (left, right) in enumerate((([(1, 10), (2, 20), (1, 11), (None, 9)], [(3, "c")]), ([(3, 30), (2, 21)], [(1, "a"), (1, "b")]), ([(1, 12)], [(2, "z")]))):
        spark.createDataFrame(left, "k long, i long").coalesce(1).write.parquet(f"{tmp_path}/l/{i}")
        spark.createDataFrame(right, "k long, v string").coalesce(1).write.parquet(f"{tmp_path}/r/{i}")
    l, r = (spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{n}/*") for n, s in (("l", "k long, i long"), ("r", "k long, v string")))
    got = W.run_to_end(stateful.connect_enrich(l, r, "k", "i", "v", buckets=2))
    assert sorted(tuple(x) for x in got.collect()) == [(1, 10, "b"), (1, 11, "b"), (1, 12, "b"), (2, 20, "z"), (2, 21, "z"), (3, 30, "c")]


def _bucket(n_keys, per_key=3):
    """A frame of rows of many keys in one bucket, as the processors take it."""
    import pandas as pd

    rows = [(f"k{k}", 1000 * i + k, k + n_keys * i, float((k * 7 + i) % 5), "ab"[i % 2]) for i in range(per_key) for k in range(n_keys)]
    frame = pd.DataFrame(rows, columns=["in_key", "in_ms", "in_id", "in_value", "in_kind"])
    return frame.assign(in_us=frame["in_ms"] * 1000)


def test_calls_of_the_sort_do_not_grow_with_the_keys_of_a_bucket():
    from lattica.streaming import stateful

    seen = []
    for n in (50, 500):
        counts, handle, times = _calls()
        processor = stateful._TimeSort()
        processor.init(handle)
        assert not list(processor.handleInputRows((1,), iter([_bucket(n)]), times))
        (out,) = processor.handleExpiredTimer((1,), times, None)
        assert len(out) == 3 * n and out["pos"].tolist() == [1, 2, 3] * n
        seen.append(sum(counts.values()))
    assert seen[0] == seen[1]


def test_sort_of_many_keys_over_micro_batches(spark, tmp_path):
    from lattica.streaming import stateful

    rng, base, far = random.Random(8), 1_700_000_000_000_000, 2**60 + 1
    parts = [[(rng.choice([None, 1, 2, far, *range(10, 40)]), base + 10_000_000 * b + 1000 * rng.randrange(15_000), 100 * b + n, float(n)) for n in range(100)] for b in range(4)]
    got = W.run_to_end(stateful.time_sort(batches(spark, tmp_path, parts, ROW.replace("k string", "k long")), "k", "t", "i", "v", "5 seconds"))
    found = sorted(((r.key, r.ms, r.id, r.v, r.pos) for r in got.collect()), key=repr)
    rows, mark, want, kept = [], None, [], []
    for part in parts:
        kept += [r for r in part if mark is None or r[1] // 1000 > mark]
        mark = max(max(r[1] for r in part) // 1000 - 5000, mark or 0)
    rows = sorted((r for r in kept if r[1] // 1000 <= mark), key=lambda r: r[1:3])
    count = {}
    for k, t, i, v in rows:
        count[k] = count.get(k, 0) + 1
        want.append((k, t // 1000, i, v, count[k]))
    assert len(want) > 250 and {None, far} <= {w[0] for w in want} and found == sorted(want, key=repr)


def test_calls_of_keyed_states_do_not_grow_with_the_keys_of_a_bucket():
    from lattica.streaming import stateful

    seen = []
    for n in (50, 500):
        counts, handle, times = _calls()
        processor = stateful._Keyed()
        processor.init(handle)
        for _ in range(2):
            (out,) = processor.handleInputRows((1,), iter([_bucket(n)]), times)
            assert len(out) == 3 * n
        seen.append(sum(counts.values()))
    assert seen[0] == seen[1]


def test_keyed_states_of_many_keys_go_on_over_micro_batches(spark, tmp_path):
    from lattica.streaming import stateful

    rng, base, far = random.Random(9), 1_700_000_000_000_000, 2**60 + 1
    parts = [[(rng.choice([None, 1, 2, far, *range(10, 30)]), base + 1_000_000 * (100 * b + n), 100 * b + n, rng.choice([None, 1.0, 5.0, -2.0])) for n in range(100)] for b in range(3)]
    stream = batches(spark, tmp_path, parts, ROW.replace("k string", "k long")).withColumn("kind", F.when(F.col("i") % 3 > 0, F.concat(F.lit("x"), F.col("i") % 3)))
    got = W.run_to_end(stateful.keyed_states(stream, "k", "t", "i", "kind", "v"), checkpoint=f"file://{tmp_path}/c")
    keys: dict = {}
    want = []
    for k, _, i, v in (r for part in parts for r in part):
        ids, kinds, values = keys.setdefault(k, ([], {}, []))
        kind = f"x{i % 3}" if i % 3 else None
        ids.append(i)
        kinds[kind] = kinds.get(kind, 0) + 1
        values += [v] if v is not None else []
        want.append((k, i, len(ids), kinds[kind], ids[-3:][0], max(values, default=None)))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    totals, recent, kinds = (state.by_key(spark, f"file://{tmp_path}/c", name, "bigint").collect() for name in ("n", "recent", "kinds"))
    assert {(r.key, r.n, r.hi) for r in totals} == {(k, len(x[0]), max(x[2], default=None)) for k, x in keys.items()}
    assert {r.key: r["items"] for r in recent} == {k: x[0][-3:] for k, x in keys.items()}
    assert {r.key: dict(zip(r.kinds, r.ns, strict=True)) for r in kinds} == {k: x[1] for k, x in keys.items()}
    few = state.lookup(spark, f"file://{tmp_path}/c", "n", spark.createDataFrame([(far,), (7,)], "key long"), packed="bigint").collect()
    assert [(r.key, r.n) for r in few] == [(far, len(keys[far][0]))]


def test_the_group_of_a_key_sees_chunks_and_not_rows():
    import pandas as pd
    import pyarrow as pa

    from lattica.streaming import stateful

    rng = random.Random(3)
    rows = [(rng.choice([None, 2**60 + 1, 5]), rng.choice([None, 0.1, 0.7, 1e9]), rng.choice([1, 1, 1, -1])) for _ in range(5000)]
    keys, vs, ops = (list(x) for x in zip(*rows, strict=True))
    given = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(vs), pa.array(ops, pa.int32())], ["key", "in_value", "in_op"])
    (chunks,) = stateful._chunked(iter([given]))
    assert chunks.num_rows <= 5000 / stateful.CHUNK + 3
    found = []
    for key in (None, 2**60 + 1, 5):
        counts, handle, times = _calls()
        processor = stateful._Starts(None)
        processor.init(handle)
        mine = [(r["ops"], r["vs"]) for r in chunks.to_pylist() if r["key"] == key]
        frames = [pd.DataFrame(mine[:2], columns=["ops", "vs"]), pd.DataFrame(mine[2:], columns=["ops", "vs"])]
        begun = pd.concat(processor.handleInputRows((key,), iter(frames), times), ignore_index=True)
        assert sum(counts.values()) == 2 and len(begun) == len(mine)
        columns = [pa.array([key] * len(begun), pa.int64()), *(pa.array(begun[c]) for c in ("n", "c", "s", "ops", "vs"))]
        for out in stateful._changes_of(iter([pa.RecordBatch.from_arrays(columns, ["key", "n", "c", "s", "ops", "vs"])])):
            found += [tuple(r.values()) for r in out.to_pylist()]
    want = []
    for key in (None, 2**60 + 1, 5):
        n, c, s = 0, 0, 0.0
        for k, v, op in rows:
            if k == key:
                before = (n, c, s)
                n, c, s = n + op, c + op * (v is not None), s + op * (v or 0.0)
                want += [(key, *x[:2], x[2] if x[1] else None, sign) for x, sign in ((before, -1), ((n, c, s), 1)) if x[0] > 0]
    assert found == want


def test_changes_of_a_hot_key_are_two_a_row_over_micro_batches(spark, tmp_path):
    from lattica.streaming import stateful

    for b in range(3):
        spark.range(3000 * b, 3000 * b + 3000).selectExpr("if(id % 10 = 0, null, if(id % 10 = 1, 'b', 'a')) AS k", "id / 7 AS v", "1 AS _op").write.parquet(f"{tmp_path}/in/{b}")
    stream = spark.readStream.schema("k string, v double, _op int").option("maxFilesPerTrigger", 4).parquet(f"{tmp_path}/in/*")
    log = W.run_to_end(stateful.retracting_aggregate(stream, "k", "v"))
    assert {r.key: r["count"] for r in log.groupBy("key").count().collect()} == {None: 1799, "a": 14399, "b": 1799}
    assert {(r.key, r.n) for r in stateful.materialize(log).collect()} == {(None, 900), ("a", 7200), ("b", 900)}


def test_a_shard_leaves_one_change_a_call_whatever_its_rows():
    import pandas as pd

    from lattica.streaming import stateful

    counts, handle, times = _calls()
    processor = stateful._Net()
    processor.init(handle)
    frame = lambda vs, op: pd.DataFrame({"in_op": op, "in_value": vs})
    (first,) = processor.handleInputRows(("a", 1), iter([frame([1.0, 5.0, 9.0] * 1000, 1), frame([None, 9.0], [1, 1])]), times)
    assert first.to_numpy(object).tolist() == [["a", 1, 3002, 3001, 15009.0, 1.0, 9.0, 3, 1]]
    (second,) = processor.handleInputRows(("a", 1), iter([frame([9.0] * 1001 + [1.0], -1)]), times)
    assert second["_op"].tolist() == [-1, 1] and second.iloc[1][["n", "lo", "hi", "d"]].tolist() == [2000, 1.0, 5.0, 2]
    (gone,) = processor.handleInputRows(("a", 1), iter([frame([1.0] * 999 + [5.0] * 1000 + [None], -1)]), times)
    assert gone["_op"].tolist() == [-1] and sum(counts.values()) < 60
