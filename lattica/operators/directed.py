"""Triangles, clustering and the triadic census of directed graphs.

Two vertices are a pair with a code: bit 1 for an edge from the first to the second, bit 2 for one back. Triangles are listed once over
the undirected pairs, from lower to higher degree, and carry their three codes, so every result is one listing and aggregates of
it; triads with an unconnected pair are counted by inclusion and exclusion and never listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.graph import vertices_of
from lattica.plans.lineage import cut

#: The sixteen types by (mutual, asymmetric, null) pairs, in their usual order; fixed names.
TRIADS = "003 012 102 021D 021U 021C 111D 111U 030T 030C 201 120D 120U 120C 210 300".split()


def _flip(code: Column) -> Column:
    return F.when(code == 3, 3).otherwise(3 - code)


def coded_pairs(edges: DataFrame) -> DataFrame:
    """src, dst, code of every connected pair in both orders; loops and repeated edges don't count."""
    one = edges.where("src <> dst").select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), F.when(F.col("src") < F.col("dst"), 1).otherwise(2).alias("bit"))
    pairs = one.groupBy("lo", "hi").agg(F.bit_or("bit").alias("code"))
    return pairs.select(F.explode(F.array(F.struct(F.col("lo").alias("src"), F.col("hi").alias("dst"), "code"), F.struct(F.col("hi").alias("src"), F.col("lo").alias("dst"), _flip(F.col("code")).alias("code")))).alias("p")).select("p.*")


def _degrees(pairs: DataFrame) -> DataFrame:
    """Of each vertex: degree (neighbours), and how many of them by an edge out only, in only, or both."""
    tally = lambda code, name: F.count(F.when(F.col("code") == code, 1)).alias(name)
    return pairs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"), tally(1, "outs"), tally(2, "ins"), tally(3, "mutuals"))


def coded_triangles(pairs: DataFrame) -> DataFrame:
    """Each triangle once: a, b, c with ab, ac, bc, the codes of its pairs in that order."""
    degree = pairs.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    keyed = pairs.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst")
    up = keyed.where("d < e OR (d = e AND src < dst)").groupBy("src").agg(F.sort_array(F.collect_list(F.struct("e", "dst", "code"))).alias("outs"))
    up = cut(up.select("src", "outs"), "oriented")
    # An edge takes the targets behind its own to its end as one list, so a wedge is one entry of a list and not a row of a shuffle.
    sent = up.select(F.col("src").alias("a"), "outs", F.posexplode("outs").alias("i", "o")).withColumn("rest", F.slice("outs", F.col("i") + 2, F.size("outs"))).where("size(rest) > 0")
    sent = sent.select("a", F.col("o.dst").alias("b"), F.col("o.code").alias("ab"), F.col("rest.dst").alias("cs"), F.col("rest.code").alias("codes"))
    met = sent.join(up.select(F.col("src").alias("b"), F.col("outs.dst").alias("ds"), F.col("outs.code").alias("nexts")), "b")
    found = met.select("a", "b", "ab", "cs", "codes", "ds", "nexts", F.explode(F.array_intersect("cs", "ds")).alias("c"))
    return found.select("a", "b", "c", "ab", F.expr("codes[int(array_position(cs, c)) - 1]").alias("ac"), F.expr("nexts[int(array_position(ds, c)) - 1]").alias("bc"))


def _clustered(edges: DataFrame) -> DataFrame:
    """``id, degree, links, triangles, local`` of every vertex, from one listing of the triangles."""
    pairs = cut(coded_pairs(edges), "pairs")
    size = lambda code: F.when(F.col(code) == 3, 2).otherwise(1)
    corners = F.array(*[F.struct(F.col(v).alias("id"), size(code).alias("n")) for v, code in (("a", "bc"), ("b", "ac"), ("c", "ab"))])
    links = coded_triangles(pairs).select(F.explode(corners).alias("t")).groupBy("t.id").agg(F.sum("t.n").alias("links"), F.count(F.lit(1)).alias("triangles"))
    out = vertices_of(edges).join(_degrees(pairs).select("id", "degree"), "id", "left").join(links, "id", "left")
    out = out.select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("degree", "links", "triangles")])
    return out.withColumn("local", F.when(F.col("degree") < 2, 0.0).otherwise(F.col("links") / (F.col("degree") * (F.col("degree") - 1))))


def clustering(edges: DataFrame) -> DataFrame:
    """``id, degree, links, local`` of every vertex: the directed edges among its neighbours, of all that could be."""
    return _clustered(edges).drop("triangles")


def global_clustering(edges: DataFrame) -> DataFrame:
    """One row: triplets (pairs of neighbours), closed (three for each triangle), their ratio, and the average local coefficient."""
    triplets = F.sum(F.when(F.col("degree") > 0, F.expr("degree * (degree - 1) div 2")))
    one = _clustered(edges).agg(triplets.alias("triplets"), F.coalesce(F.sum("triangles"), F.lit(0)).alias("closed"), F.avg("local").alias("average_coefficient"))
    return one.withColumn("global_coefficient", F.when(F.col("triplets") > 0, F.col("closed") / F.col("triplets")))


def _type(ab: int, ac: int, bc: int) -> str:
    """The type of three pairs' codes."""
    heads = {"a": 0, "b": 0, "c": 0}  # asymmetric edges in, less those out, and mutual ones
    ins, outs, both = dict(heads), dict(heads), dict(heads)
    for (x, y), code in ((("a", "b"), ab), (("a", "c"), ac), (("b", "c"), bc)):
        if code == 3:
            both[x], both[y] = both[x] + 1, both[y] + 1
        elif code:
            source, target = (x, y) if code == 1 else (y, x)
            outs[source], ins[target] = outs[source] + 1, ins[target] + 1
    mutual, asymmetric = sum(both.values()) // 2, sum(ins.values())
    name = f"{mutual}{asymmetric}{3 - mutual - asymmetric}"
    if name in ("021", "120"):
        return name + ("D" if 2 in outs.values() else "U" if 2 in ins.values() else "C")
    if name == "111":
        return name + ("D" if both[next(v for v in heads if ins[v])] else "U")
    if name == "030":
        return name + ("T" if 2 in outs.values() else "C")
    return name


def triadic_census(edges: DataFrame) -> DataFrame:
    """type and n (decimal, as there are about vertices cubed) of the sixteen types of triads.

    The driver gets one row of sums over vertices and pairs, and at most 27 counts of triangles by codes.
    """
    pairs = cut(coded_pairs(edges), "pairs")
    degrees = cut(_degrees(pairs), "degrees")
    wide = lambda c: F.coalesce(F.sum(F.expr(f"cast({c} as decimal(38,0))")), F.lit(0).cast("decimal(38,0)"))
    choose = lambda c: f"cast({c} as decimal(19,0)) * ({c} - 1) / 2"
    times = lambda x, y: f"cast({x} as decimal(19,0)) * {y}"
    # Two neighbours of a vertex, by how they are tied to it: the triad if they are not connected themselves.
    spans = {"021D": choose("outs"), "021U": choose("ins"), "021C": times("outs", "ins"), "111D": times("mutuals", "ins"), "111U": times("mutuals", "outs"), "201": choose("mutuals")}
    dyads = {"asym": "outs", "mutual": "mutuals", "asym_ends": "(outs + ins) * (degree - 1)", "mutual_ends": "mutuals * (degree - 1)"}
    row = degrees.agg(*[wide(e).alias(n) for n, e in (spans | dyads).items()]).first()
    n = vertices_of(edges).count()
    found = {t: 0 for t in TRIADS} | {t: int(row[t]) for t in spans}
    asym, mutual = int(row["asym"]), int(row["mutual"]) // 2
    # A pair and any third vertex; then off those that touch the pair: once an end for each other neighbour, and a triangle was counted twice.
    found["012"], found["102"] = asym * (n - 2) - int(row["asym_ends"]), mutual * (n - 2) - int(row["mutual_ends"])
    tie = {1: "out", 2: "in", 3: "both"}
    span = {("out", "out"): "021D", ("in", "in"): "021U", ("in", "out"): "021C", ("both", "in"): "111D", ("both", "out"): "111U", ("both", "both"): "201"}
    back = {1: 2, 2: 1, 3: 3}
    for r in coded_triangles(pairs).groupBy("ab", "ac", "bc").count().collect():
        found[_type(r.ab, r.ac, r.bc)] += r["count"]
        for x, y in ((r.ab, r.ac), (back[r.ab], r.bc), (back[r.ac], back[r.bc])):
            found[span[tuple(sorted((tie[x], tie[y])))]] -= r["count"]
        found["012"] += r["count"] * sum(c != 3 for c in (r.ab, r.ac, r.bc))
        found["102"] += r["count"] * sum(c == 3 for c in (r.ab, r.ac, r.bc))
    found["003"] = n * (n - 1) * (n - 2) // 6 - sum(found.values())
    spark = edges.sparkSession
    return spark.createDataFrame([(t, str(found[t])) for t in TRIADS], "type string, n string").select("type", F.col("n").cast("decimal(38,0)").alias("n"))
