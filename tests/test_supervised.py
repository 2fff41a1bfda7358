"""Restarts, acknowledged messages, feedback, learning over batches and sketches by slice."""

import json
import os

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lattica.operators import sharded, sketches
from lattica.sources import ack_source
from lattica.streaming import learning, supervise

MESSAGE = StructType([StructField("id", LongType()), StructField("us", LongType())])


def send(path, name, ids):
    os.makedirs(f"{path}/pending", exist_ok=True)
    with open(f"{path}/pending/{name}", "w") as f:
        f.write("".join(json.dumps({"id": i, "us": 1_700_000_000_000_000 + i, "more": "x"}) + "\n" for i in ids))


def test_each_message_comes_once_though_a_task_fails_and_senders_repeat(spark, tmp_path):
    path, fail = f"{tmp_path}/queue", f"{tmp_path}/fail"
    for n in range(4):
        send(path, f"m{n}.json", [*range(n * 10, n * 10 + 10), 5])
    open(fail, "w").close()

    def breaks(frames):
        for f in frames:
            if os.path.exists(fail) and (f["id"] == 25).any():
                os.remove(fail)
                raise RuntimeError("lost")
            yield f

    ran = []

    def start():
        stream = ack_source.read_once(spark, path, MESSAGE, "id", "us", "1 day", 1).mapInPandas(breaks, "id long, us long, in_time timestamp")
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").start()
        ran.append(query)
        query.processAllAvailable()
        query.stop()
        return query

    assert supervise.supervise(start, supervise.FixedDelay(3)) == 1 and len(ran) == 2
    send(path, "late.json", [7, 100])
    start()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [*range(40), 100]
    assert {"m0.json", "m1.json", "m2.json", "m3.json"} <= set(os.listdir(f"{path}/acked"))


def test_strategies_give_up(spark):
    calls = []

    class Failing:
        def awaitTermination(self):
            calls.append(1)
            raise StreamingQueryException("x")

    with pytest.raises(StreamingQueryException):
        supervise.supervise(Failing, supervise.FixedDelay(2))
    assert len(calls) == 3
    with pytest.raises(StreamingQueryException):
        supervise.supervise(Failing, supervise.FailureRate(3, 60.0))
    assert len(calls) == 7


def test_feedback_ends_when_nothing_returns(spark, tmp_path):
    start = spark.createDataFrame([(1, 5), (2, 0), (3, 12), (4, None)], "id long, n long")
    step = lambda b: (b.where("n is null or n < 4"), b.where("n >= 4").withColumn("n", F.col("n") - 4))
    got = supervise.feedback(start, step, f"{tmp_path}/loop")
    assert sorted(tuple(r) for r in got.select("id", "n").collect() if r.n is not None) == [(1, 1), (2, 0), (3, 0)] and got.count() == 4
    assert supervise.feedback(start.where("id > 9"), step, f"{tmp_path}/none").count() == 0


def test_predictions_come_from_the_version_before(spark, tmp_path):
    base, schema = f"{tmp_path}/base", "shard long, id long, label string, features map<string,double>"
    parts = [[(n % 2, 10 * b + n, "1" if n % 3 else "-1", {"x": float(n), "b": 1.0}) for n in range(6)] for b in range(3)]
    learner = sharded.passive_aggressive(0.5)
    for part in parts:
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{base}/in")
        out = learning.learn(spark.readStream.schema(schema).parquet(f"{base}/in"), learner, base)
    model = None
    want = {}
    for b, part in enumerate(parts):
        frame = spark.createDataFrame(part, schema)
        if model is not None:
            want |= {r.id: r.scores for r in sharded.scores(frame, model).collect()}
        model = sharded.mixed(frame, learner, 1, start=model)
    got = {r.id: r.scores for r in out.collect()}
    assert all(np.allclose(got[i], s) for i, s in want.items()) and all(got[n] == [] for n in range(6))
    asked = spark.createDataFrame([(1, 3, {"x": 2.0, "new": 1.0}), (2, 9, {"x": 1.0}), (3, 1, None)], "id long, version long, features map<string,double>")
    last = {r.feature: r.w[0] for r in model.collect()}
    found = {r.id: r.scores for r in learning.predict(asked, base).collect()}
    assert np.allclose(found[1], [2 * last["x"]]) and found[2] == [] and found[3] == []


def test_sketches_of_slices_merge_to_those_of_the_range(spark):
    rows = [(f"2024-01-0{1 + n % 5} 10:00:00", n % 37 if n % 11 else None, "ab"[n % 2]) for n in range(3000)]
    e = sketches.slices(spark.createDataFrame(rows, "t string, v long, g string").withColumn("t", F.col("t").cast("timestamp")), "t", "1 day")
    ranges = spark.createDataFrame([("all", "2024-01-01", "2024-01-06"), ("two", "2024-01-02", "2024-01-04")], "range string, lo string, hi string").selectExpr("range", "cast(lo as timestamp) lo", "cast(hi as timestamp) hi")
    got = {r.range: r.f2 for r in sketches.second_moment(sketches.tug_of_war(e, "v"), ranges).collect()}
    whole = e.withColumn("slice", F.lit("2024-01-01").cast("timestamp"))
    assert got["all"] == {r.range: r.f2 for r in sketches.second_moment(sketches.tug_of_war(whole, "v"), ranges).collect()}["all"]
    for name, days in (("all", range(5)), ("two", (1, 2))):
        counts = {}
        for t, v, _ in rows:
            if v is not None and int(t[9]) - 1 in days:
                counts[v] = counts.get(v, 0) + 1
        exact = sum(n * n for n in counts.values())
        assert abs(got[name] - exact) <= exact * 4 / 64**0.5
    alike = sketches.resemblance(sketches.minhash(e, "g", "v"), "g").first()
    assert (alike.a, alike.b) == ("a", "b") and abs(alike.jaccard - 1.0) < 0.2
