"""Graphs as two frames: vertices ``(id, value)`` and edges ``(src, dst, value)``.

Iterative algorithms are driver loops over joins; each step's result is cut from its lineage in the shared folder.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.components import connected_components
from lattica.plans.lineage import cut, drop

__all__ = ["connected_components"]


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, once, without self loops."""
    return edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct()


def simplify(edges: DataFrame) -> DataFrame:
    """Without self loops and repeated edges."""
    return edges.select("src", "dst").where("src <> dst").distinct()


def invalid_vertex_ids(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge endpoints without a vertex."""
    return vertices_of(edges).join(vertices, "id", "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """``id, out_degree, in_degree, degree`` of every vertex that has an edge."""
    both = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return both.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree")).withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def edge_degree_pairs(edges: DataFrame) -> DataFrame:
    d = degrees(edges).select("id", "degree")
    return edges.select("src", "dst").join(d.withColumnRenamed("id", "src").withColumnRenamed("degree", "src_degree"), "src").join(d.withColumnRenamed("id", "dst").withColumnRenamed("degree", "dst_degree"), "dst")


def reduce_on_edges(edges: DataFrame, direction: str, agg: Column, name: str = "value") -> DataFrame:
    """Aggregate the edge values (column ``value``) around each vertex: ``in``, ``out`` or ``all``."""
    out = edges.select(F.col("src").alias("id"), "value")
    into = edges.select(F.col("dst").alias("id"), "value")
    return {"out": out, "in": into, "all": out.union(into)}[direction].groupBy("id").agg(agg.alias(name))


def reduce_on_neighbors(vertices: DataFrame, edges: DataFrame, direction: str, agg: Column, name: str = "value") -> DataFrame:
    """Aggregate the neighbours' vertex values (column ``value``)."""
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"))
    into = edges.select(F.col("dst").alias("id"), F.col("src").alias("other"))
    pairs = {"out": out, "in": into, "all": out.union(into)}[direction]
    return pairs.join(vertices.select(F.col("id").alias("other"), "value"), "other").groupBy("id").agg(agg.alias(name))


def join_with_vertices(vertices: DataFrame, values: DataFrame, fn: Callable[[Column, Column], Column]) -> DataFrame:
    """Update vertex values where ``values`` (``id, update``) has one."""
    return vertices.join(values, "id", "left").select("id", F.when(F.col("update").isNotNull(), fn(F.col("value"), F.col("update"))).otherwise(F.col("value")).alias("value"))


def pregel(vertices: DataFrame, edges: DataFrame, message: Column, combine: Column, apply: Column, max_steps: int | None = None) -> DataFrame:
    """Vertex-centric iteration.

    Each step: ``message`` (over ``value``, the source's, and ``weight``) goes along the edges of vertices that changed,
    ``combine`` aggregates the column ``msg`` per target, ``apply`` (over ``value`` and ``msg``) makes the new value. It
    ends when no vertex changes; if that takes more than ``max_steps``, where given, it raises.
    """
    now = cut(vertices.select("id", "value", F.lit(True).alias("moved")), "pregel")
    links = edges.select("src", "dst", *(["value"] if "value" in edges.columns else [])).withColumnRenamed("value", "weight")
    for step in itertools.count():
        if step == max_steps:
            raise RuntimeError(f"vertices still change after {max_steps} steps")
        sent = now.where("moved").select(F.col("id").alias("src"), "value").join(links, "src").select(F.col("dst").alias("id"), message.alias("msg"))
        got = sent.groupBy("id").agg(combine.alias("msg"))
        after = now.drop("moved").join(got, "id", "left").withColumn("new", F.when(F.col("msg").isNotNull(), apply).otherwise(F.col("value")))
        old, now = now, cut(after.select("id", F.col("new").alias("value"), (~F.col("new").eqNullSafe(F.col("value"))).alias("moved")), "pregel")
        drop(old)
        if now.where("moved").isEmpty():
            break
    return now.select("id", "value")


def scatter_gather(vertices: DataFrame, edges: DataFrame, message: Column, combine: Column, apply: Column) -> DataFrame:
    """One superstep: every vertex sends ``message`` (over ``value``) along its out-edges, targets ``combine`` the column
    ``msg`` and ``apply`` it (over ``value`` and ``msg``). Vertices without a message keep their value."""
    sent = edges.select("src", "dst").join(vertices.select(F.col("id").alias("src"), "value"), "src").select(F.col("dst").alias("id"), message.alias("msg"))
    got = sent.groupBy("id").agg(combine.alias("msg"))
    return vertices.join(got, "id", "left").select("id", F.when(F.col("msg").isNotNull(), apply).otherwise(F.col("value")).alias("value"))


def gather_sum_apply(vertices: DataFrame, edges: DataFrame, gather: Column, total: Column, apply: Column) -> DataFrame:
    """One superstep: over each edge ``gather`` (of ``neighbor``, its target's value), ``total`` of the column ``gathered`` by
    source, and ``apply`` (over ``value`` and ``summed``)."""
    near = edges.select("src", "dst").join(vertices.select(F.col("id").alias("dst"), F.col("value").alias("neighbor")), "dst")
    summed = near.select(F.col("src").alias("id"), gather.alias("gathered")).groupBy("id").agg(total.alias("summed"))
    return vertices.join(summed, "id", "left").select("id", F.when(F.col("summed").isNotNull(), apply).otherwise(F.col("value")).alias("value"))


def sssp(edges: DataFrame, source: int, max_steps: int | None = None) -> DataFrame:
    """Weighted shortest distances from ``source``; vertices out of reach have infinity."""
    start = vertices_of(edges).select("id", F.when(F.col("id") == source, 0.0).otherwise(float("inf")).alias("value"))
    return pregel(start, edges, F.col("value") + F.col("weight"), F.min("msg"), F.least("value", "msg"), max_steps)


#: Links that a task of :func:`label_propagation` takes at most, about.
LINKS_A_TASK = 500_000


def label_propagation(edges: DataFrame, steps: int = 10) -> DataFrame:
    """Each vertex takes its neighbours' most frequent label; ties go to the greater label.

    Tasks grow in number with the links, not in size. The links of a vertex lie together, so votes are counted where they are.
    """
    links = cut(undirected(edges), "links")
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-links.count() // LINKS_A_TASK))
    labels = vertices_of(edges).select("id", F.col("id").alias("label"))
    for _ in range(steps):
        met = links.repartition(tasks, "dst").join(labels.withColumnRenamed("id", "dst"), "dst")
        votes = met.select("src", "label").repartition(tasks, "src").groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
        labels = cut(votes.groupBy("src").agg(F.max(F.struct("n", "label")).alias("m")).select(F.col("src").alias("id"), F.col("m.label").alias("label")), "labels")
    return labels


def community_detection(edges: DataFrame, steps: int = 10, delta: float = 0.5) -> DataFrame:
    """Labels with scores that decay by ``delta / step`` as they travel; the label with the largest score sum wins."""
    links = cut(undirected(edges), "links")
    state = vertices_of(edges).select("id", F.col("id").alias("label"), F.lit(1.0).alias("score"))
    for step in range(1, steps + 1):
        votes = links.join(state.withColumnRenamed("id", "dst"), "dst").groupBy("src", "label").agg(F.round(F.sum("score"), 6).alias("total"), F.max("score").alias("best"))  # rounded, so that the order of the sum decides no tie
        won = votes.groupBy("src").agg(F.max(F.struct("total", "label", "best")).alias("m"))
        state = cut(won.join(state.withColumnRenamed("id", "src").withColumnRenamed("label", "old"), "src").select(F.col("src").alias("id"), F.col("m.label").alias("label"), F.when(F.col("m.label") == F.col("old"), F.col("m.best")).otherwise(F.col("m.best") - delta / step).alias("score")), "communities")
    return state


def pagerank(edges: DataFrame, damping: float = 0.85, steps: int = 10) -> DataFrame:
    """Ranks that sum to one; the rank of vertices without out-edges is spread over all."""
    links = cut(edges.select("src", "dst").join(edges.groupBy("src").agg(F.count(F.lit(1)).alias("out")), "src"), "links")
    ids = cut(vertices_of(edges), "vertices")
    n = ids.count()
    ranks = ids.select("id", F.lit(1.0 / max(n, 1)).alias("rank"))
    for _ in range(steps):
        given = links.join(ranks.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        joined = ids.join(given, "id", "left").select("id", F.coalesce("got", F.lit(0.0)).alias("got"))
        lost = ranks.join(links.select(F.col("src").alias("id")).distinct(), "id", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        ranks = cut(joined.crossJoin(F.broadcast(lost)).select("id", (F.lit((1 - damping) / max(n, 1)) + damping * (F.col("got") + F.col("lost") / n)).alias("rank")), "ranks")  # lost is one row
    return ranks


def hits(edges: DataFrame, steps: int = 10) -> DataFrame:
    """Hub and authority scores, each normalised to unit length."""
    links = cut(edges.select("src", "dst"), "links")
    ids = cut(vertices_of(edges), "vertices")

    def unit(df: DataFrame, name: str) -> DataFrame:
        norm = df.agg(F.sqrt(F.sum(F.col(name) * F.col(name))).alias("norm"))
        return df.crossJoin(F.broadcast(norm)).select("id", (F.col(name) / F.col("norm")).alias(name))  # norm is one row

    hub = ids.select("id", F.lit(1.0).alias("hub"))
    for _ in range(steps):
        authority = unit(ids.join(links.join(hub, links["src"] == hub["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum("hub").alias("a")), "id", "left").select("id", F.coalesce("a", F.lit(0.0)).alias("authority")), "authority")
        authority = cut(authority, "authority")
        hub = cut(unit(ids.join(links.join(authority, links["dst"] == authority["id"]).groupBy(F.col("src").alias("id")).agg(F.sum("authority").alias("h")), "id", "left").select("id", F.coalesce("h", F.lit(0.0)).alias("hub")), "hub"), "hub")
    return hub.join(authority, "id")


#: A set of up to so many vertices without targets is broadcast to what would be sent to them in vain.
BROADCAST_SINKS = 500_000


def _with_degrees(edges: DataFrame) -> DataFrame:
    """``a, b, da, db``: each undirected edge once as ``a < b``, with the degrees of its ends. It comes by ``b``."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a IS NOT NULL AND b IS NOT NULL").repartition("a").distinct()  # as the joins would filter, so that all uses share one shuffle
    ends = [pairs.groupBy(F.col(c).alias("id")).agg(F.count(F.lit(1)).alias("n")) for c in ("a", "b")]
    degree = ends[0].union(ends[1]).groupBy("id").agg(F.sum("n").alias("d"))
    of = lambda end: degree.select(F.col("id").alias(end), F.col("d").alias(f"d{end}")).hint("shuffle_hash")  # noqa: E731  # a row for each vertex, so edges need no sort
    return pairs.join(of("a"), "a").join(of("b"), "b")


def _oriented(edges: DataFrame) -> DataFrame:
    """``src, d, es, outs``: of each vertex that has targets its degree, and its targets with their degrees ``es``, by (degree, id).

    Edges point from lower to higher degree. They are shuffled once each way: to the lesser end, where they are made distinct and counted, to the
    greater end, and to the source.
    """
    keyed = _with_degrees(edges)
    up = F.expr("da < db OR (da = db AND a < b)")
    edge = keyed.select(*[F.when(up, x).otherwise(y).alias(c) for c, x, y in (("src", F.col("a"), F.col("b")), ("d", F.col("da"), F.col("db")), ("e", F.col("db"), F.col("da")), ("dst", F.col("b"), F.col("a")))])
    ordered = edge.repartition("src").sortWithinPartitions("src", "e", "dst")
    kind = edge.schema["dst"].dataType.simpleString()
    return cut(ordered.mapInArrow(_listed, f"src {kind}, d bigint, es array<bigint>, outs array<{kind}>"), "oriented")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that come by source as one row for each source; the last source of a batch waits for the next."""
    held = None
    for batch in itertools.chain(batches, [None]):
        rows = held if batch is None else batch if held is None else pa.concat_batches([held, batch])
        if rows is None or not rows.num_rows:
            continue
        src, n = rows.column("src"), rows.num_rows
        starts = np.append(0, np.nonzero(pc.not_equal(src.slice(1), src.slice(0, n - 1)).to_numpy(zero_copy_only=False))[0] + 1)
        ends = np.append(starts, n) if batch is None else starts
        first = pa.array(ends[:-1])
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows.column(c).slice(0, int(ends[-1]))) for c in ("e", "dst")]
        yield pa.RecordBatch.from_arrays([src.take(first), rows.column("d").take(first), *lists], ["src", "d", "es", "outs"])
        held = rows.slice(int(ends[-1]))


def _closed(up: DataFrame) -> DataFrame:
    """``s, p, qs``: the triangles over each edge of :func:`_oriented` ``up`` that has some."""
    # An edge takes the targets behind its own to its end as one list, so a wedge is one entry of a list and not a row of a shuffle; an end without targets closes none.
    sent = up.select(F.col("src").alias("s"), "outs", F.posexplode("outs").alias("i", "p")).where(F.col("i") + 1 < F.size("outs"))
    ends = up.select(F.explode(F.slice("outs", 1, F.size("outs") - 1)).alias("p")).distinct()
    sinks = cut(ends.join(up.select(F.col("src").alias("p")), "p", "left_anti"), "sinks")
    if sinks.limit(BROADCAST_SINKS + 1).count() <= BROADCAST_SINKS:
        sent = sent.join(F.broadcast(sinks), "p", "left_anti")
    sent = sent.select("s", "p", F.slice("outs", F.col("i") + 2, F.size("outs")).alias("rest"))
    return sent.join(up.select(F.col("src").alias("p"), "outs"), "p").select("s", "p", F.array_intersect("rest", "outs").alias("qs")).where("size(qs) > 0")


def triangles(edges: DataFrame) -> DataFrame:
    """Each triangle once as ``a < b < c``; edges point from lower to higher degree, which bounds a hub's wedges."""
    closed = _closed(_oriented(edges)).select("s", "p", F.explode("qs").alias("q"))
    return closed.select(F.array_sort(F.array("s", "p", "q")).alias("t")).select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"))


def clustering_coefficients(edges: DataFrame) -> DataFrame:
    """``id, degree, triangles, local`` of every vertex, undirected."""
    up = _oriented(edges)
    own = lambda id, degree, n: F.struct(id.alias("id"), degree.alias("degree"), n.cast("bigint").alias("triangles"))
    zero, unknown = F.lit(0), F.lit(None).cast("bigint")
    known = up.select(F.explode(F.concat(F.array(own(F.col("src"), F.col("d"), zero)), F.zip_with("outs", "es", lambda v, e: own(v, e, zero)))).alias("v"))
    counts = _closed(up).select(F.explode(F.concat(F.array(*[own(F.col(c), unknown, F.size("qs")) for c in ("s", "p")]), F.transform("qs", lambda q: own(q, unknown, F.lit(1))))).alias("v"))
    out = known.union(counts).groupBy("v.id").agg(F.max("v.degree").alias("degree"), F.sum("v.triangles").alias("triangles"))
    return out.withColumn("local", F.when(F.col("degree") < 2, 0.0).otherwise(2 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))))


def global_clustering(edges: DataFrame) -> DataFrame:
    """One row: triplets, triangles, the global and the average local coefficient."""
    c = clustering_coefficients(edges)
    return c.agg(F.sum(F.expr("degree * (degree - 1) div 2")).alias("triplets"), F.expr("sum(triangles) div 3").alias("triangles"), (F.sum("triangles") / F.sum(F.expr("degree * (degree - 1) div 2"))).alias("global_coefficient"), F.avg("local").alias("average_coefficient"))


def triad_counts(edges: DataFrame) -> DataFrame:
    """Undirected triadic census: closed triads, open triads, one-edge triads and empty triads."""
    links = undirected(edges)
    n = vertices_of(edges).agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("n"))
    g = global_clustering(edges).select(F.col("triplets").cast("decimal(38,0)").alias("t"), F.col("triangles").cast("decimal(38,0)").alias("c"))
    m = links.agg((F.count(F.lit(1)) / 2).cast("decimal(38,0)").alias("m"))
    one = n.crossJoin(g).crossJoin(m)  # one row each
    return one.selectExpr("cast(c as bigint) closed", "cast(t - 3 * c as bigint) two_edges", "cast(m * (n - 2) - 2 * (t - 3 * c) - 3 * c as bigint) one_edge", "cast(n * (n - 1) * (n - 2) div 6 - c - (t - 3 * c) - (m * (n - 2) - 2 * (t - 3 * c) - 3 * c) as bigint) no_edge")


#: Neighbours of one vertex are paired in blocks of about so many.
PAIR_BLOCK = 1024


#: Pairs that a task makes at once.
PAIRS_AT_ONCE = 1 << 19


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that hold ``values`` from each of ``ends`` to the next."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _narrow(values: np.ndarray) -> np.ndarray:
    most = int(values.max(initial=0))
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max))


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each target's (block of) sources: each source ``a`` with the greater ones and their degrees, packed as differences and in as few bytes as they need."""

    def packed(a: np.ndarray, da: np.ndarray, mid: np.ndarray, sizes: np.ndarray, b: np.ndarray, db: np.ndarray) -> pa.RecordBatch:
        row, parts = np.repeat(np.arange(len(a)), sizes), -(-da // PAIR_BLOCK)
        part = np.zeros(len(b), np.int64)
        if parts.max(initial=1) > 1:
            part = (((b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % parts[row].astype(np.uint64)).astype(np.int64)
            order = np.lexsort((part, row))
            row, part, b, db = row[order], part[order], b[order], db[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1])
        first = np.nonzero(new)[0]
        own, ends = row[first], np.append(first, len(row))
        far = _narrow(np.insert(db, np.repeat(first, 2), np.column_stack([mid[own], da[own]]).ravel()))  # the target's and the source's own degrees lead
        off = _narrow((b - a[row]).view(np.uint64))
        width = np.full(len(own), off.itemsize * 16 + far.itemsize)
        return pa.RecordBatch.from_arrays([pa.array(a[own]), pa.array(part[first]), pa.array(width), _lists(off, ends), _lists(far, ends + 2 * np.arange(len(ends)))], ["a", "part", "width", "bs", "dbs"])

    def sorted_list(of: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
        v, d = (of.values.field(c).to_numpy() for c in ("v", "d"))
        order = np.argsort(v)
        return v[order], d[order]

    def across(left: pa.ListScalar, right: pa.ListScalar, mid: int) -> Iterator[pa.RecordBatch]:
        """Two blocks of one target."""
        for (v, d), (w, e) in ((x, y) for one, other in ((sorted_list(left), sorted_list(right)),) for x, y in ((one, other), (other, one))):
            step = max(1, PAIRS_AT_ONCE // max(1, len(w)))
            for lo in range(0, len(v), step):
                own, at = v[lo : lo + step], np.searchsorted(w, v[lo : lo + step], side="right")
                take = np.concatenate([np.arange(x, len(w)) for x in at])
                if len(take):
                    yield packed(own, d[lo : lo + step], np.full(len(own), mid), len(w) - at, w[take], e[take])

    for batch in batches:
        mids, lists, alone = batch.column("mid_degree").to_numpy(), batch.column("own"), batch.column("other").is_null().to_numpy(zero_copy_only=False)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        starts = np.append(0, np.cumsum(sizes))
        values = [lists.flatten().field(c).to_numpy() for c in ("v", "d")]
        for k in np.unique(sizes[alone & (sizes > 1)]):
            i, j = np.triu_indices(k, 1)
            rows = np.nonzero(alone & (sizes == k))[0]
            step = max(1, PAIRS_AT_ONCE // len(i))
            for lo in range(0, len(rows), step):
                at = rows[lo : lo + step]
                v, d = (x[starts[at][:, None] + np.arange(k)] for x in values)
                order = np.argsort(v, axis=1)
                v, d = np.take_along_axis(v, order, 1), np.take_along_axis(d, order, 1)
                yield packed(v[:, :-1].ravel(), d[:, :-1].ravel(), np.repeat(mids[at], k - 1), np.tile(np.arange(k - 1, 0, -1), len(at)), v[:, j].ravel(), d[:, j].ravel())
        for n in np.nonzero(~alone)[0]:
            yield from across(lists[n], batch.column("other")[n], int(mids[n]))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with how often they came, from lists that come by source and part; the last group of a batch waits for the next."""
    held = None
    for batch in itertools.chain(batches, [None]):
        rows = held if batch is None else batch if held is None else pa.concat_batches([held, batch])
        if rows is None or not rows.num_rows:
            continue
        a, part, width = (rows.column(c).to_numpy() for c in ("a", "part", "width"))
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (part[1:] != part[:-1])
        n = len(a) if batch is None else int(np.nonzero(new)[0][-1])
        held = rows.slice(n)
        if not n:
            continue
        row, b, db, mid, da = [], [], [], np.empty(n, np.int64), np.empty(n, np.int64)
        for w in np.unique(width[:n]):
            at = np.nonzero(width[:n] == w)[0]
            some = rows.take(pa.array(at))
            off, far = (np.frombuffer(b"".join(some.column(c).to_pylist()), f"u{size}") for c, size in (("bs", w // 16), ("dbs", w % 16)))
            sizes = pc.binary_length(some.column("dbs")).to_numpy() // (w % 16)
            heads, plain = np.cumsum(sizes) - sizes, np.ones(len(far), bool)
            mid[at], da[at], plain[heads], plain[heads + 1] = far[heads], far[heads + 1], False, False
            own = np.repeat(at, sizes - 2)
            row.append(own), b.append(a[own] + off.astype(np.uint64).view(np.int64)), db.append(far[plain].astype(np.int64))
        row, b, db = np.concatenate(row), np.concatenate(b), np.concatenate(db)
        group = (np.cumsum(new[:n]) - 1)[row]
        order = np.lexsort((mid[row], b, group))
        row, b, db, group = row[order], b[order], db[order], group[order]
        first = np.ones(len(b), bool)
        first[1:] = (b[1:] != b[:-1]) | (group[1:] != group[:-1])
        at = np.nonzero(first)[0]
        with np.errstate(divide="ignore"):
            near = 1 / np.log(mid)
        found = [a[row[at]], b[at], np.diff([*at, len(b)]), np.add.reduceat(near[row], at), da[row[at]], db[at]]
        out = pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["a", "b", "shared", "adamic_adar", "da", "db"])
        for lo in range(0, out.num_rows, 1 << 16):
            yield out.slice(lo, 1 << 16)


def _pairs(links: DataFrame) -> DataFrame:
    """``a, b, shared, adamic_adar, da, db``: the pairs ``a < b`` of sources that share targets.

    ``links`` has ``src, dst, src_degree, mid_degree`` (of ``dst``); identifiers are integers. A target's sources are one list, or blocks of which each meets
    each. From it each source gets the greater ones as one packed list, which goes to the source: a pair is one entry of that shuffle, and is counted behind
    it in order of the sources, so no table of pairs is held or spilled. A source's partners are dealt to groups by its own degree, so neither a hub's
    pairs nor the pairs of its neighbours are one group.
    """
    kind = links.schema["src"].dataType.simpleString()
    blocks = F.ceil(F.col("mid_degree") / PAIR_BLOCK).cast("int")
    dealt = links.where("mid_degree > 1").select("dst", "mid_degree", blocks.alias("blocks"), F.col("src").cast("bigint").alias("v"), F.col("src_degree").cast("bigint").alias("d"))
    lists = dealt.withColumn("q", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")).groupBy("dst", "q").agg(F.collect_list(F.struct("v", "d")).alias("own"), F.max("mid_degree").alias("mid_degree"), F.max("blocks").alias("blocks"))
    none = F.lit(None).cast("array<struct<v:bigint,d:bigint>>")
    within = lists.select("mid_degree", "own", none.alias("other"))
    hubs = lists.where("blocks > 1")
    asking = hubs.select("dst", "mid_degree", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("r"), "q").where("r > q")
    across = asking.join(hubs.select("dst", F.col("q").alias("r"), F.col("own").alias("other")).hint("merge"), ["dst", "r"]).select("mid_degree", "own", "other")
    sent = within.unionByName(across).mapInArrow(_partners, "a bigint, part bigint, width bigint, bs binary, dbs binary")
    met = sent.repartition("a", "part").sortWithinPartitions("a", "part")
    pairs = met.mapInArrow(_counted, "a bigint, b bigint, shared bigint, adamic_adar double, da bigint, db bigint")
    return pairs if kind == "bigint" else pairs.withColumn("a", F.col("a").cast(kind)).withColumn("b", F.col("b").cast(kind))


def shared_neighbors(edges: DataFrame) -> DataFrame:
    """``a < b`` with the number of common neighbours, their Jaccard index and Adamic-Adar score."""
    keyed = _with_degrees(edges)
    ways = [keyed.select(F.col(x).alias("src"), F.col(y).alias("dst"), F.col(f"d{x}").alias("src_degree"), F.col(f"d{y}").alias("mid_degree")) for x, y in ("ab", "ba")]
    pairs = _pairs(ways[0].union(ways[1]))
    return pairs.select("a", "b", "shared", (F.col("shared") / (F.col("da") + F.col("db") - F.col("shared"))).alias("jaccard"), "adamic_adar")


def graph_metrics(edges: DataFrame) -> DataFrame:
    """One row: vertices, edges, largest and average degree, triplets."""
    d = undirected(edges).groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    return d.agg(F.count(F.lit(1)).alias("vertices"), F.expr("sum(d) div 2").alias("edges"), F.max("d").alias("max_degree"), F.avg("d").alias("average_degree"), F.expr("sum(d * (d - 1) div 2)").alias("triplets"))


def bipartite_projection(edges: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of top vertices (``src``) that share a bottom vertex (``dst``), with the number they share."""
    e = edges.select("src", "dst").distinct()
    e = e.join(e.groupBy("src").agg(F.count(F.lit(1)).alias("src_degree")), "src")
    return _pairs(e.join(e.groupBy("dst").agg(F.count(F.lit(1)).alias("mid_degree")), "dst")).select("a", "b", "shared")


def transitive_closure(edges: DataFrame) -> DataFrame:
    """All pairs with a path; paths double in each step until there are no more."""
    paths = cut(edges.select("src", "dst").distinct(), "paths")
    n = paths.count()
    while True:
        longer = paths.alias("x").join(paths.alias("y"), F.col("x.dst") == F.col("y.src")).select(F.col("x.src").alias("src"), F.col("y.dst").alias("dst"))
        old, paths = paths, cut(paths.union(longer).distinct(), "paths")
        drop(old)
        before, n = n, paths.count()
        if n == before:
            break
    return paths


def bulk_iterate(state: DataFrame, step: Callable[[DataFrame], DataFrame], n: int, done: Callable[[DataFrame], bool] | None = None, settle: bool = False) -> DataFrame:
    """``n`` supersteps, or fewer when ``done`` says so; with ``settle`` it is an error if ``done`` never does."""
    last = None
    for _ in range(n):
        state = cut(step(state), "bulk")
        if last is not None:
            drop(last)
        last = state
        if done and done(state):
            return state
    if settle:
        raise RuntimeError(f"not done after {n} supersteps")
    return state


def delta_iterate(solution: DataFrame, workset: DataFrame, key: str, step: Callable[[DataFrame, DataFrame], DataFrame], n: int, settle: bool = False) -> DataFrame:
    """``step(solution, workset)`` gives changed solution rows; they replace those of equal key and are the next workset.

    It ends with an empty workset or after ``n`` supersteps; with ``settle`` it is an error if rows still change then.
    """
    held: list[DataFrame] = []
    for _ in range(n):
        delta = cut(step(solution, workset), "delta")
        if delta.isEmpty():
            for old in [delta, *held[1:]]:
                drop(old)
            return solution
        solution = cut(solution.join(delta.select(key), key, "left_anti").unionByName(delta), "solution")
        for old in held:
            drop(old)
        held, workset = [solution, delta], delta
    if settle and not step(solution, workset).isEmpty():
        raise RuntimeError(f"rows still change after {n} supersteps")
    return solution


# generators: edges by rule, in both directions where the graph is undirected
def _edges(spark: SparkSession, n: int, targets: Callable[[Column], list[Column]]) -> DataFrame:
    i = F.col("id")
    return spark.range(n).select(i.alias("src"), F.explode(F.array(*targets(i))).alias("dst"))


def _least(name: str, value: int, least: int) -> None:
    if value < least:
        raise ValueError(f"{name} must be at least {least}")


def complete_graph(spark: SparkSession, n: int) -> DataFrame:
    _least("the vertex count", n, 2)
    return spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")).alias("dst")).where("src <> dst")


def cycle_graph(spark: SparkSession, n: int) -> DataFrame:
    _least("the vertex count", n, 3)
    return circulant_graph(spark, n, [1])


def circulant_graph(spark: SparkSession, n: int, offsets: list[int]) -> DataFrame:
    _least("the vertex count", n, 2)
    for offset in offsets:
        _least("an offset", offset, 1)
        if offset >= n:
            raise ValueError("an offset must be less than the vertex count")
    return _edges(spark, n, lambda i: [F.pmod(i + s * o, F.lit(n)) for o in offsets for s in (1, -1)]).distinct()


def path_graph(spark: SparkSession, n: int) -> DataFrame:
    _least("the vertex count", n, 2)
    return _edges(spark, n, lambda i: [i - 1, i + 1]).where(f"dst >= 0 AND dst < {n}")


def star_graph(spark: SparkSession, n: int) -> DataFrame:
    _least("the vertex count", n, 2)
    leaves = spark.range(1, n)
    return leaves.select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")).union(leaves.select(F.col("id"), F.lit(0).cast("long")))


def grid_graph(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    _least("a dimension", min(rows, columns), 2)
    moves = _edges(spark, rows * columns, lambda i: [F.when(i % columns > 0, i - 1), F.when(i % columns < columns - 1, i + 1), i - columns, i + columns])
    return moves.where(f"dst IS NOT NULL AND dst >= 0 AND dst < {rows * columns}")


def hypercube_graph(spark: SparkSession, dimensions: int) -> DataFrame:
    _least("the number of dimensions", dimensions, 1)
    return _edges(spark, 1 << dimensions, lambda i: [i.bitwiseXOR(F.lit(1 << d).cast("long")) for d in range(dimensions)])


def echo_graph(spark: SparkSession, n: int, degree: int) -> DataFrame:
    """A regular graph: each vertex is linked with the ``degree`` vertices that lie opposite to it on the ring.

    An arc that lies the same way from both of its ends is centred on the opposite point, so ``n - degree`` is odd.
    """
    if not 0 < degree < n or (n - degree) % 2 == 0:
        raise ValueError(f"no arc of {degree} vertices is centred opposite to a vertex on a ring of {n}")
    first = (n - degree + 1) // 2
    return _edges(spark, n, lambda i: [F.pmod(i + first + k, F.lit(n)) for k in range(degree)])


def empty_graph(spark: SparkSession, n: int) -> DataFrame:
    """Vertices without edges."""
    _least("the vertex count", n, 0)
    return spark.range(n)


def singleton_edge_graph(spark: SparkSession, pairs: int) -> DataFrame:
    _least("the number of pairs", pairs, 1)
    return spark.range(2 * pairs).select(F.col("id").alias("src"), F.col("id").bitwiseXOR(F.lit(1).cast("long")).alias("dst"))


def rmat_graph(spark: SparkSession, scale: int, edges: int, seed: int = 1, a: float = 0.57, b: float = 0.19, c: float = 0.19) -> DataFrame:
    """Recursive-matrix random edges: one quadrant draw per bit."""
    df = spark.range(edges)
    src, dst = F.lit(0).cast("long"), F.lit(0).cast("long")
    for bit in range(scale):
        r = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(bit)), F.lit(1 << 30)) / float(1 << 30)
        src = src * 2 + F.when(r >= a + b, 1).otherwise(0)
        dst = dst * 2 + F.when(((r >= a) & (r < a + b)) | (r >= a + b + c), 1).otherwise(0)
    return df.select(src.alias("src"), dst.alias("dst"))


def translate_ids(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Replace endpoints by ``ids`` (``id, new_id``)."""
    return edges.join(ids.select(F.col("id").alias("src"), F.col("new_id").alias("s")), "src").join(ids.select(F.col("id").alias("dst"), F.col("new_id").alias("d")), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))


def dense_ids(vertices: DataFrame) -> DataFrame:
    """``id, new_id`` with new ids 0.. in the order of ids; ranks are offset by range partition."""
    from lattica.operators.relational import zip_with_index

    return zip_with_index(vertices.select("id").orderBy("id"), "new_id")


