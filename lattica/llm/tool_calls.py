"""Linking of tool calls and their results, by DataFrame functions only.

Calls and results meet in a shuffled hash join on conversation and call identifier. Calls get a topological position in
their conversation: the label of a call is the largest of its own sequence number and the labels of what it depends on
(with a depth that counts steps at an equal number), so that a call stands after all its dependencies and otherwise in
sequence. Labels are found by peeling: a round closes the dependencies on calls whose label is known, and lets the others
jump over calls that wait for few. Chains and ladders of any length so take a logarithmic number of rounds, and what no
round can peel any more is in or behind a cycle. Positions are counted in two levels, within runs of sequence numbers and
over the runs, so that one huge conversation spreads over tasks. Repeated identifiers are reduced by an aggregate that
combines before the shuffle. Arguments are parsed as variants and checked against the tool's schema; the linked record is
serialised as canonical JSON (no white space, keys of objects sorted at every level).

Defined cases: a repeated call identifier keeps its first call (by sequence, then text) and marks the others
``duplicate_call``, of equal rows all but one; of several results the first counts; a result without a call is
``orphan_result`` without a position; a null identifier or conversation links with nothing: such a call is ``no_result``
without a position and such a result ``orphan_result``; arguments that are null, longer than a variant may be (16 MB), or
anything but one JSON object with distinct keys (text after it included) are an error and are serialised as text; an unknown
tool is an error; a missing dependency is an error and doesn't hold a call back; calls in or behind a cycle are marked so
and stand last, in sequence; empty tables give empty results; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.plans.lineage import cut, drop

#: Length of a run of sequence numbers that is ranked in one group.
RUN = 256
#: A dependency jumps over a call if the two wait for at most so many calls, multiplied.
JUMP = 64


def _kind(value: Column) -> Column:
    """JSON type of a variant."""
    name = F.schema_of_variant(value)
    return (
        F.when(name.isin("BIGINT", "TINYINT", "SMALLINT", "INT") | name.rlike(r"^DECIMAL\(\d+,0\)$"), "integer")
        .when(name.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
        .otherwise("null")
    )


def topological_labels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, at, depth, cyclic, missing`` of every call (``conv_id, call_id, seq, depends_on``).

    Only conversations with a dependency that isn't earlier in sequence are peeled.
    """
    edges = calls.select("conv_id", "call_id", "seq", F.explode("depends_on").alias("dep"))
    known = calls.select("conv_id", F.col("call_id").alias("dep"), F.col("seq").alias("dep_seq"))
    edges = edges.join(known, ["conv_id", "dep"], "left")
    missing = edges.where("dep_seq IS NULL").groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_set("dep")).alias("missing"))
    late = cut(edges.where("dep_seq >= seq").select("conv_id").distinct(), "late-dependencies")
    labels = calls.select("conv_id", "call_id", F.struct(F.col("seq").alias("at"), F.lit(0).cast("long").alias("depth")).alias("label"))
    labels = labels.join(missing, ["conv_id", "call_id"], "left")
    if late.isEmpty():
        return labels.select("conv_id", "call_id", "label.at", "label.depth", F.lit(False).alias("cyclic"), "missing")
    waits = cut(edges.where("dep_seq IS NOT NULL").join(late, "conv_id", "left_semi").select("conv_id", "call_id", F.struct(F.col("seq").alias("at"), F.lit(0).cast("long").alias("depth")).alias("label"), "dep", F.lit(1).cast("long").alias("steps")), "dependencies")
    peeled = _peel(waits, labels.select("conv_id", "call_id", "label").join(late, "conv_id", "left_semi")).withColumnRenamed("label", "found")
    rows = labels.join(peeled, ["conv_id", "call_id"], "left")
    label = F.coalesce("found", "label")
    return rows.select("conv_id", "call_id", label["at"].alias("at"), label["depth"].alias("depth"), F.coalesce("waiting", F.lit(False)).alias("cyclic"), "missing")


def _peel(waits: DataFrame, first: DataFrame) -> DataFrame:
    """``conv_id, call_id, label, waiting`` of every call that waits for another; ``waiting`` stays true if no order exists.

    ``waits``: one row per dependency that is still open, ``label`` being the call's so far and ``steps`` the calls that the
    dependency stands for. Each round drops the files of the one before.
    """
    key = ["conv_id", "call_id"]
    own = first
    done: list[DataFrame] = []
    while True:
        state = waits.groupBy(*key).agg(F.max("label").alias("label"), F.count(F.lit(1)).alias("open"))
        # what each call waits for: a label that is known (open is null), or a call that waits itself
        target = own.select("conv_id", F.col("call_id").alias("dep"), F.col("label").alias("dep_label"))
        target = target.join(state.select("conv_id", F.col("call_id").alias("dep"), F.col("label").alias("so_far"), "open"), ["conv_id", "dep"], "left")
        target = target.select("conv_id", "dep", F.coalesce("so_far", "dep_label").alias("dep_label"), F.col("open").alias("dep_open"))
        met = waits.join(target, ["conv_id", "dep"]).join(state.select(*key, "open"), key)
        met = met.withColumn("jump", F.coalesce(F.col("dep_open") * F.col("open") <= JUMP, F.lit(False)))
        further = waits.select("conv_id", F.col("call_id").alias("dep"), F.col("dep").alias("next"), F.col("steps").alias("next_steps")).withColumn("jump", F.lit(True))
        met = met.join(further, ["conv_id", "dep", "jump"], "left")
        gained = F.when(F.col("dep_open").isNull() | F.col("jump"), F.struct(F.col("dep_label.at").alias("at"), (F.col("dep_label.depth") + F.col("steps")).alias("depth")))
        met = met.select(*key, F.greatest("label", F.coalesce(gained, "label")).alias("label"), F.when(F.col("dep_open").isNotNull(), F.coalesce("next", "dep")).alias("dep"), F.least(F.col("steps") + F.coalesce("next_steps", F.lit(0)), F.lit(1 << 40)).alias("steps"))  # grows without end in a cycle
        after = cut(met.groupBy(*key, "dep").agg(F.max("label").alias("label"), F.max("steps").alias("steps")), "dependencies")
        by_call = after.groupBy(*key).agg(F.max("label").alias("label"), F.count("dep").alias("left"))
        closed = cut(by_call.where("left = 0").select(*key, "label"), "peeled")
        drop(waits)
        waits = cut(after.where("dep IS NOT NULL").join(by_call.where("left > 0").select(*key, F.col("label").alias("best")), key).select(*key, F.col("best").alias("label"), "dep", "steps"), "dependencies")
        drop(after)
        if closed.isEmpty():
            break
        done.append(closed)
        own = own.join(closed.withColumnRenamed("label", "new"), key, "left").select(*key, F.coalesce("new", "label").alias("label"))
        if len(done) % 8 == 0:  # the plan must not grow with the rounds
            own = cut(own, "labels")
    cyclic = waits.select(*key).distinct().select(*key, F.lit(None).cast("struct<at:bigint,depth:bigint>").alias("label"), F.lit(True).alias("waiting"))
    for closed in done:
        cyclic = cyclic.unionByName(closed.withColumn("waiting", F.lit(False)))
    return cyclic


def _positions(labels: DataFrame) -> DataFrame:
    """Adds ``position`` from 1 in each conversation, by (cyclic, at, depth, call_id)."""
    runs = labels.withColumn("run", F.floor(F.col("at") / RUN))
    counts = runs.groupBy("conv_id", "cyclic", "run").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("cyclic", "run").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("offset", F.coalesce(before, F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("conv_id", "cyclic", "run").orderBy("at", "depth", "call_id"))
    return runs.withColumn("rank", rank).join(offsets, ["conv_id", "cyclic", "run"]).withColumn("position", F.col("offset") + F.col("rank")).drop("run", "rank", "offset")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """``conv_id, call_id, seq, name, status, position, valid, errors, record`` for every call and every orphan result.

    ``calls``: ``conv_id, call_id, seq, name, arguments`` (JSON text), ``depends_on`` (array of identifiers);
    ``results``: ``conv_id, call_id, seq, content``; ``schemas``: ``name, param, type, required``.
    """
    ident = F.monotonically_increasing_id()
    given = cut(calls.select("conv_id", "call_id", F.col("seq").cast("long").alias("seq"), "name", "arguments", "depends_on").withColumn("row", ident), "calls")
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    firsts = given.where(named).groupBy("conv_id", "call_id").agg(F.min(F.struct("seq", "arguments", "row", "name", "depends_on")).alias("c")).select("conv_id", "call_id", "c.*")
    answers = results.select("conv_id", "call_id", F.col("seq").cast("long").alias("seq"), "content")
    first_answers = answers.where(named).groupBy("conv_id", "call_id").agg(F.min(F.struct("seq", "content")).alias("a")).select("conv_id", "call_id", F.col("a.seq").alias("result_seq"), "a.content", F.lit(True).alias("answered"))
    skeleton = firsts.select("conv_id", "call_id", "seq", F.expr("filter(array_distinct(coalesce(depends_on, cast(array() as array<string>))), d -> d is not null)").alias("depends_on"))
    placed = _positions(topological_labels(skeleton)).select("conv_id", "call_id", "position", "cyclic", "missing")
    linked = firsts.join(first_answers.hint("shuffle_hash"), ["conv_id", "call_id"], "full").join(placed, ["conv_id", "call_id"], "left").withColumn("repeated", F.lit(False))
    others = given.join(firsts.select("row"), "row", "left_anti").withColumn("repeated", named)
    lost = answers.where(~named).select("conv_id", "call_id", F.col("seq").alias("result_seq"), "content", F.lit(True).alias("answered")).withColumn("repeated", F.lit(False))
    joined = linked.unionByName(others, allowMissingColumns=True).unionByName(lost, allowMissingColumns=True)
    tools = schemas.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("param", "type", "required"))).alias("schema"))
    rows = joined.join(tools, "name", "left")
    # a parser stops behind the first value; inside brackets of both kinds any further text is an error
    one_value = F.try_parse_json(F.concat(F.lit("["), "arguments", F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"a":'), "arguments", F.lit("}"))).isNotNull()
    rows = rows.withColumn("args", F.when(one_value, F.try_parse_json("arguments"))).withColumn("keys", F.when(F.col("args").isNotNull(), F.json_object_keys("arguments")))
    is_call = F.col("row").isNotNull()
    status = F.when(~is_call, "orphan_result").when(F.col("repeated"), "duplicate_call").when(F.col("answered"), "linked").otherwise("no_result")
    # a path quotes a name with the quotes that it doesn't hold itself; a name with both, or an empty one, has no path and no type check
    quote = lambda p: F.when(~p.contains("'") & (p != ""), F.concat(F.lit("$['"), p, F.lit("']"))).when(~p.contains('"') & (p != ""), F.concat(F.lit('$["'), p, F.lit('"]')))
    wrong_type = F.filter(
        F.col("schema"),
        lambda s: F.array_contains("keys", s["param"])
        & quote(s["param"]).isNotNull()
        & (_kind(F.variant_get("args", quote(s["param"]), "variant")) != s["type"])
        & ~((s["type"] == "number") & (_kind(F.variant_get("args", quote(s["param"]), "variant")) == "integer")),
    )
    params = F.transform("schema", lambda s: s["param"])
    errors = F.concat(
        F.when(F.col("schema").isNull(), F.array(F.concat(F.lit("unknown tool: "), F.coalesce("name", F.lit(""))))).otherwise(F.array()),
        F.when(F.col("keys").isNull(), F.array(F.lit("arguments are no JSON object"))).otherwise(F.array()),
        F.coalesce(F.transform(F.filter("schema", lambda s: s["required"] & ~F.array_contains(F.coalesce("keys", F.array()), s["param"])), lambda s: F.concat(F.lit("missing: "), s["param"])), F.array()),
        F.coalesce(F.transform(wrong_type, lambda s: F.concat(F.lit("type: "), s["param"])), F.array()),
        F.coalesce(F.transform(F.array_sort(F.array_except("keys", params)), lambda k: F.concat(F.lit("unknown: "), k)), F.array()),
        F.coalesce(F.transform("missing", lambda d: F.concat(F.lit("dependency: "), d)), F.array()),
        F.when(F.col("cyclic"), F.array(F.lit("cycle"))).otherwise(F.array()),
    )
    rows = rows.withColumn("status", status).withColumn("errors", F.when(is_call, F.array_join(errors, "; ")).otherwise(F.lit("orphan result")))
    parsed = F.to_json(F.struct(F.col("args").alias("arguments"), F.array_sort(F.coalesce("depends_on", F.array())).alias("depends_on"), F.col("call_id").alias("id"), "name", F.col("content").alias("result")))
    plain = F.to_json(F.struct("arguments", F.array_sort(F.coalesce("depends_on", F.array())).alias("depends_on"), F.col("call_id").alias("id"), "name", F.col("content").alias("result")))
    record = F.when(F.col("keys").isNotNull() & F.col("args").isNotNull(), parsed).otherwise(plain)
    return rows.select("conv_id", "call_id", F.coalesce("seq", "result_seq").alias("seq"), "name", "status", F.col("position").cast("long").alias("position"), (F.col("errors") == "").alias("valid"), "errors", record.alias("record"))


REPLY_SCHEMAS = [("reply", "prompt", "string", True), ("reply", "turn", "integer", True), ("configure", "instructions", "string", True)]


def from_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and schemas of a chat table: user and system turns are calls, other turns answer the turn before."""
    spark = conversations.sparkSession

    def name(turn: Column) -> Column:
        return F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string"))

    asking = F.col("role").isin("user", "system")
    turn = F.col("turn").cast("long")
    calls = conversations.where(asking).select(
        "conv_id", name(turn).alias("call_id"), turn.alias("seq"), F.when(F.col("role") == "user", "reply").otherwise("configure").alias("name"),
        F.when(F.col("role") == "user", F.to_json(F.struct(F.col("text").alias("prompt"), turn.alias("turn")))).otherwise(F.to_json(F.struct(F.col("text").alias("instructions")))).alias("arguments"),
        F.when((F.col("role") == "user") & (turn >= 2), F.array(name(turn - 2))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    results = conversations.where(~F.coalesce(asking, F.lit(False))).select("conv_id", name(turn - 1).alias("call_id"), turn.alias("seq"), F.col("text").alias("content"))
    return calls, results, spark.createDataFrame(REPLY_SCHEMAS, "name string, param string, type string, required boolean")
