"""Connected components: vertices merge into their least neighbours as long as that leaves fewer links, then large-star and small-star rounds alternate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.lineage import cut, drop

#: A hub has more links than this, and than a sixteenth of a task's fair share of all links.
LEAST_HUB = 256
#: Merging goes on while it leaves less than this share of the links, which a long chain doesn't.
SHRINKS = 0.9


def _mark(edges: DataFrame) -> tuple:
    """Row count and an order-free checksum: equal for two rounds when nothing moved."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())


def _hub(edges: DataFrame, rows: int) -> int:
    return max(LEAST_HUB, rows // (16 * int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def with_least(pairs: DataFrame, hub: int) -> DataFrame:
    """``src, dst, m`` with the least ``dst`` of each ``src``.

    The links of a vertex with more than ``hub`` of them stay where they are and get its minimum by broadcast; with
    :func:`_hub` there are at most 32 such vertices for each shuffle partition, however large the graph. The others meet
    theirs in a shuffled join, where no key has more than ``hub`` rows. ``pairs`` should come from files: it is read thrice.
    """
    least = pairs.groupBy("src").agg(F.min("dst").alias("m"), F.count(F.lit(1)).alias("n"))
    hubs = F.broadcast(least.where(F.col("n") > hub).select("src", "m"))
    others = pairs.join(hubs.select("src"), "src", "left_anti").join(least.where(F.col("n") <= hub).select("src", "m"), "src")
    return pairs.join(hubs, "src").union(others).select("src", "dst", "m")


def _named(rows: DataFrame, column: str, names: DataFrame, hub: int) -> DataFrame:
    """``rows`` with ``column`` replaced by its ``m`` in ``names`` (id, m, n); ids in ``n`` > ``hub`` rows get it by broadcast, and their rows are dealt by a hash."""
    kind = dict(rows.dtypes)[column]
    hubs = F.broadcast(names.where(F.col("n") > hub).select(F.col("id").alias(column), F.col("m").alias("__hub")))
    others = names.where(F.col("n") <= hub).select(F.col("id").alias("__key"), F.col("m").alias("__m"))
    dealt = F.pmod(F.xxhash64(*rows.columns), F.lit(2**31 - 1)).cast(kind)
    keyed = rows.join(hubs, column, "left").withColumn("__key", F.when(F.col("__hub").isNull(), F.col(column)).otherwise(dealt))
    return keyed.join(others, "__key", "left").withColumn(column, F.coalesce("__hub", "__m")).select(*rows.columns)


def _merged(now: DataFrame, mark: tuple) -> tuple[DataFrame, DataFrame]:
    """Links (both ways) between what vertices merge into, and id, m, n: each vertex, the least of it and its neighbours, and its links."""
    hub = _hub(now, mark[0])
    names = cut(now.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m"), F.count(F.lit(1)).alias("n")).select("id", F.least("id", "m").alias("m"), "n"), "merged")
    links = _named(_named(now.where("src < dst"), "src", names, hub), "dst", names, hub).where("src <> dst")
    links = links.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    ways = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return cut(links.select(F.explode(ways).alias("e")).select("e.*"), "links"), names


def _of_members(names: DataFrame, least: DataFrame) -> DataFrame:
    """id and component of the vertices in ``names`` from those (``least``) of what they merged into, which without link is its own."""
    rows = names.count()
    held = names.groupBy(F.col("m").alias("id")).agg(F.count(F.lit(1)).alias("n")).join(least, "id", "left").select("id", F.coalesce("component", "id").alias("m"), "n")
    return _named(names.select("id", F.col("m").alias("component")), "component", cut(held, "members"), _hub(names, rows))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(id, component)`` for every vertex of an undirected edge list; ``component`` is its smallest vertex.

    A merge keeps the least vertex of each component, so what remains has the same smallest vertices; links shrink from merge to merge. Star
    rounds on what remains go on until nothing moves; each is two min-aggregates (combined before the shuffle), each with a join that
    spreads the links of hub vertices over all tasks. Edges never reach the driver, only a count and a checksum do. Self
    loops keep their vertex, null endpoints are ignored and an empty edge list gives an empty result.
    """
    pairs = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")
    ways = lambda a, b: F.explode(F.array(F.struct(F.col(a).alias("src"), F.col(b).alias("dst")), F.struct(F.col(b).alias("src"), F.col(a).alias("dst")))).alias("e")
    start = cut(pairs.select(ways("src", "dst")).select("e.*").distinct(), "edges")  # links in both directions
    now, before, owned = start.where("src <> dst"), None, None
    mark, levels = _mark(now), []
    while mark[0] and dict(now.dtypes)["src"] in ("int", "bigint", "string") and now.dtypes[0][1] == now.dtypes[1][1]:
        links, names = _merged(now, mark)
        levels.append(names)
        shrunk, mark = mark, _mark(links)
        if owned is not None:
            drop(owned)
        now = owned = links
        if mark[0] > SHRINKS * shrunk[0]:
            break
    while mark != before and mark[0]:
        hub = _hub(now, mark[0])
        large = with_least(now, hub).where("dst > src").select(F.col("dst").alias("src"), F.least("m", "src").alias("dst"))
        large = cut(large.where("src <> dst").distinct(), "large-stars")
        small = with_least(large, hub)
        pulled = F.array(*[F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for x in ("src", "dst") for a, b in ((x, "m"), ("m", x))])
        after = cut(small.select(F.explode(pulled).alias("e")).select("e.*").where("src <> dst").distinct(), "stars")
        before, mark = mark, _mark(after)
        drop(large)
        if owned is not None:
            drop(owned)
        now = owned = after
    least = now.where("dst < src").select(F.col("src").alias("id"), F.col("dst").alias("component"))
    for names in reversed(levels):
        least = _of_members(names, least)
    return start.select(F.col("src").alias("id")).distinct().join(least, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
