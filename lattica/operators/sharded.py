"""Learning with models that are tables: nothing that grows with users, items or features lies on the driver or in a broadcast.

All learners here share one shape. A job's rows are dealt to blocks; in a block the needed part of the model comes first and the
examples follow in a fixed order, through one task as a stream of Arrow batches, so memory is the block's part of the model and a
batch. The changed model leaves as rows and is written (:func:`~lattica.plans.lineage.cut`), so a lost executor repeats a block only.

*Factorisation* goes by strata: users and items are dealt to ``blocks`` blocks each, and in sub-epoch s user block u meets item block
u + s, so no two tasks touch the same factors. Examples and factors travel as lists, so that a pass moves and sorts few rows. A user or item with more than its share of a block's ratings is split into parts that learn on
their own and are averaged, by their ratings, after each epoch. One that most mini-batches have takes smaller steps the more of them there are;
else it would follow the latest ratings and leave behind what the others have learned from it.

*Linear learners and factorisation machines* go by iterative parameter mixing: each shard takes the weights of its own features, runs
over its examples one by one, and a feature's weights are averaged over the shards that have seen it.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.plans.lineage import cut, drop

_MINI_BATCH = 64
#: An id in more mini-batches of a pass takes smaller steps, so that all of them together go about as far as so many whole ones.
_WHOLE_STEPS = 16
#: Examples that travel as one row, and about how many of a block a task packs.
_CHUNK, _EXAMPLES_A_TASK = 256, 500_000


# matrix factorisation
@dataclasses.dataclass
class Factors:
    """``users`` and ``items``: id and factors, whose last two are a bias and a one, so that a rating is the mean and their product."""

    users: DataFrame
    items: DataFrame
    mean: float


def _start(ids: DataFrame, rank: int, seed: int, side: int) -> DataFrame:
    """Small factors from a hash of the id, so that a repeated run begins alike."""
    unit = lambda d: (F.pmod(F.xxhash64("id", F.lit(seed), d), F.lit(1 << 20)) / float(1 << 20) - 0.5) * (0.6 / rank**0.5)
    ends = [F.lit(0.0), F.lit(1.0)] if side == 0 else [F.lit(1.0), F.lit(0.0)]
    return ids.withColumn("f", F.concat(F.transform(F.sequence(F.lit(1), F.lit(rank)), unit), F.array(*ends)))


def _parts(ratings: DataFrame, column: str, most: int) -> DataFrame:
    """id, n and parts: in how many an id's ``n`` ratings are dealt so that none has more than about ``most``."""
    return ratings.groupBy(F.col(column).alias("id")).agg(F.ceil(F.count(F.lit(1)) / most).cast("long").alias("parts"), F.count(F.lit(1)).alias("n"))


def _dealt(ratings: DataFrame, side: str, other: str, parts: DataFrame, blocks: int) -> DataFrame:
    """Adds ``side``_part and ``side``_block. Split ids are few: at most ``blocks`` times a constant."""
    split = F.broadcast(parts.where("parts > 1").select(F.col("id").alias(side), "parts"))
    joined = ratings.join(split, side, "left").withColumn(f"{side}_part", F.pmod(F.xxhash64(other, "rating", F.lit(7)), F.coalesce("parts", F.lit(1)))).drop("parts")
    return joined.withColumn(f"{side}_block", F.pmod(F.xxhash64(side, f"{side}_part"), F.lit(blocks)))


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values))


def _packed_examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Examples, which come by stratum and block, as rows that hold ``_CHUNK`` of them at most as lists."""
    for batch in batches:
        column = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        n, cell = batch.num_rows, (column["stratum"], column["block"])
        new = np.ones(n, bool)
        new[1:] = (cell[0][1:] != cell[0][:-1]) | (cell[1][1:] != cell[1][:-1])
        first = np.nonzero(new)[0]
        new[(np.arange(n) - np.repeat(first, np.diff([*first, n]))) % _CHUNK == 0] = True
        first = np.nonzero(new)[0]
        ends = np.append(first, n)
        yield pa.RecordBatch.from_arrays([*(pa.array(column[c][first]) for c in ("stratum", "block", "place")), *(_lists(column[c], ends) for c in ("id", "part", "other", "other_part", "r"))], ["stratum", "block", "place", "id", "part", "other", "other_part", "r"])


_MODEL = "side int, block int, split boolean, id array<bigint>, part array<int>, pace array<double>, f array<double>"


def _packed_ids(side: int, block: int, split: np.ndarray, ids: np.ndarray, parts: np.ndarray, paces: np.ndarray, matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of the model that hold several ids as lists; a part of a split id has a row of its own."""
    width = matrix.shape[1]
    for alone in (False, True):
        own = np.nonzero(split == alone)[0]
        for lo in range(0, len(own), 1 << 16):
            at = own[lo : lo + (1 << 16)]
            ends = np.append(np.arange(0, len(at), 1 if alone else max(1, 4 * _CHUNK // width)), len(at))
            n = len(ends) - 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, side), pa.int32()), pa.array(np.full(n, block), pa.int32()), pa.array(np.full(n, alone)), _lists(ids[at], ends), _lists(parts[at].astype(np.int32), ends), _lists(paces[at], ends), _lists(matrix[at].ravel(), ends * width)],
                ["side", "block", "split", "id", "part", "pace", "f"])


def _packed_start(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides, blocks, split, ids, parts, paces = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("side", "block", "split", "id", "part", "pace"))
            matrix = batch.column("f").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            for side, block in set(zip(sides.tolist(), blocks.tolist(), strict=True)):
                at = (sides == side) & (blocks == block)
                yield from _packed_ids(side, block, split[at], ids[at], parts[at], paces[at], matrix[at])

    return run


def _unpacked(model: DataFrame, width: int) -> DataFrame:
    """side, id, part and f, a row each."""
    each = F.transform(F.sequence(F.lit(0), F.size("id") - 1), lambda k: F.struct(F.get("id", k).alias("id"), F.get("part", k).alias("part"), F.slice("f", k * width + 1, F.lit(width)).alias("f")))
    return model.select("side", F.explode(each).alias("e")).select("side", "e.*")


def _grouped(ids: np.ndarray, pace: np.ndarray) -> tuple[np.ndarray, ...]:
    """How mini-batches of examples meet the ids of a side: of each, the order of its examples by id (from its first), then over all of them where an
    id begins (from the mini-batch's first), the id, and its pace by its number; and where each mini-batch's ids begin."""
    batch = np.arange(len(ids)) // _MINI_BATCH
    order = np.lexsort((ids, batch))
    by = ids[order]
    new = np.ones(len(ids), bool)
    new[1:] = (by[1:] != by[:-1]) | (batch[1:] != batch[:-1])
    starts = np.nonzero(new)[0]
    found = by[starts]
    return order - batch * _MINI_BATCH, starts - batch[starts] * _MINI_BATCH, found, (pace[found] / np.diff([*starts, len(ids)]))[:, None], np.searchsorted(batch[starts], np.arange(batch[-1] + 2))


def _sweep(rate: float, l2: float, rank: int, blocks: int, shift: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    width = rank + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sides, turn = None, ([], []), None  # of each side: batches of id, part, pace, split and factors; with the first examples one batch, and how to find an id

        def load() -> None:
            for side in sides:
                if len(side) != 1 or len(side[0]) == 5:
                    ids, parts, paces, split, matrix = (np.concatenate(x) for x in zip(*side, strict=True)) if side else (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0), np.empty(0, bool), np.empty((0, width)))
                    known, rank_ = np.unique(ids, return_inverse=True)
                    many = int(parts.max(initial=0)) + 1
                    codes = rank_ * many + parts
                    order = np.argsort(codes)
                    side[:] = [(ids, parts, paces, split, matrix.copy(), known, many, codes[order], order)]

        def at(side: int, ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
            *_, known, many, codes, order = sides[side][0]
            places = np.searchsorted(known, ids)
            return order[places if many == 1 else np.searchsorted(codes, places * many + parts)]

        def leave() -> Iterator[pa.RecordBatch]:
            load()
            for n, side in enumerate(sides):
                ids, parts, paces, split, matrix, *_ = side[0]
                if not np.isfinite(matrix).all():
                    raise ValueError("factors grow without bound: take a smaller rate")
                if len(ids):
                    yield from _packed_ids(n, block if n == 0 else (block + shift) % blocks, split, ids, parts, paces, matrix)
                side.clear()

        def learn(rows: pa.RecordBatch) -> None:
            load()
            column = lambda c: rows.column(c).flatten().to_numpy(zero_copy_only=False)
            ratings = column("r")
            mixed = turn.permutation(len(ratings))
            ratings, users, items = ratings[mixed], at(0, column("id"), column("part"))[mixed], at(1, column("other"), column("other_part"))[mixed]
            user_factors, item_factors = sides[0][0][4], sides[1][0][4]
            user_order, user_starts, user_found, user_pace, user_ends = _grouped(users, sides[0][0][2])
            item_order, item_starts, item_found, item_pace, item_ends = _grouped(items, sides[1][0][2])
            for n, lo in enumerate(range(0, len(ratings), _MINI_BATCH)):
                own, u, i = slice(lo, lo + _MINI_BATCH), slice(user_ends[n], user_ends[n + 1]), slice(item_ends[n], item_ends[n + 1])
                p, q = user_factors[users[own]], item_factors[items[own]]
                error = (rate * (ratings[own] - np.einsum("ij,ij->i", p, q)))[:, None]
                user_step, item_step = error * q - rate * l2 * p, error * p - rate * l2 * q
                user_step[:, rank + 1] = item_step[:, rank] = 0  # the one that carries the other side's bias
                # All begin at the same place, so an id takes their mean.
                user_factors[user_found[u]] += np.add.reduceat(user_step[user_order[own]], user_starts[u]) * user_pace[u]
                item_factors[item_found[i]] += np.add.reduceat(item_step[item_order[own]], item_starts[i]) * item_pace[i]

        for batch in batches:
            blocks_, kinds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "kind"))
            ends = [*(np.nonzero((blocks_[1:] != blocks_[:-1]) | (kinds[1:] != kinds[:-1]))[0] + 1), batch.num_rows]
            for lo, hi in zip([0, *ends], ends, strict=False):
                if lo == hi:
                    continue
                if blocks_[lo] != block:
                    if block is not None:
                        yield from leave()
                    block = int(blocks_[lo])
                    turn = np.random.default_rng([seed, block])
                rows = batch.slice(lo, hi - lo)
                if kinds[lo] == 2:
                    with np.errstate(all="ignore"):
                        learn(rows)
                else:
                    lists = {c: rows.column(c) for c in ("id", "part", "r", "f")}
                    split = np.repeat(rows.column("split").to_numpy(zero_copy_only=False), lists["id"].value_lengths().to_numpy())
                    flat = {c: x.flatten().to_numpy(zero_copy_only=False) for c, x in lists.items()}
                    sides[kinds[lo]].append((flat["id"], flat["part"], flat["r"], split, flat["f"].reshape(-1, width)))
        if block is not None:
            yield from leave()

    return run


def factorize(ratings: DataFrame, user: str, item: str, rating: str, rank: int = 8, epochs: int = 5, blocks: int = 8, rate: float = 0.1, l2: float = 0.02, decay: float = 0.9, start: Factors | None = None, seed: int = 1) -> Factors:
    """Factors of users and items by stratified stochastic gradient descent; rows with a null are left out.

    Too large a ``rate`` is an error, as factors then grow without bound. ``start`` goes on from earlier factors, as for ratings that come later (online learning); ids that it hasn't begin anew and ids
    without new ratings stay.
    """
    given = ratings.select(F.col(user).cast("long").alias("user"), F.col(item).cast("long").alias("item"), F.col(rating).cast("double").alias("rating")).dropna()
    size = given.agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("mean")).first()
    mean = start.mean if start else size["mean"] or 0.0
    most = max(1, -(-size["n"] // (4 * blocks)))
    dealt = given
    parts = [cut(_parts(given, c, most), f"{c}-parts") for c in ("user", "item")]
    for c, o, p in (("user", "item", parts[0]), ("item", "user", parts[1])):
        dealt = _dealt(dealt, c, o, p, blocks)
    # Examples are shuffled and sorted once; passes move lists of them, and mix what comes together.
    spread = -(-size["n"] // (blocks * blocks * _EXAMPLES_A_TASK)) or 1
    named = [F.col("user_block").cast("int").alias("block"), F.xxhash64("user", "item", "rating").alias("place"), F.col("user").alias("id"), F.col("user_part").cast("int").alias("part"), F.col("item").alias("other"), F.col("item_part").cast("int").alias("other_part"), (F.col("rating") - mean).alias("r")]
    rows = dealt.select(F.pmod(F.col("item_block") - F.col("user_block"), F.lit(blocks)).cast("int").alias("stratum"), *named)
    cells = rows.repartition("stratum", "block", F.pmod("place", F.lit(spread))).sortWithinPartitions("stratum", "block", "place", "id", "other", "r")
    strata = cut(cells.mapInArrow(_packed_examples, "stratum int, block int, place long, id array<bigint>, part array<int>, other array<bigint>, other_part array<int>, r array<double>"), "strata", by=["stratum"])
    sides = []
    for side, (name, part) in enumerate(zip(("user", "item"), parts, strict=True)):
        met = F.least(F.col("n") / (F.col("parts") * blocks), F.lit(size["n"] / (blocks * blocks * _MINI_BATCH)))  # mini-batches of a pass that have it
        ids = part.select("id", (F.col("parts") > 1).alias("split"), F.least(F.lit(1.0), _WHOLE_STEPS / met).alias("pace"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        first = _start(ids, rank, seed, side)
        if start:
            old = (start.users, start.items)[side].select("id", F.col("factors").alias("old"))
            first = first.join(old, "id", "left").withColumn("f", F.coalesce("old", "f")).drop("old")
        sides.append(first.select(F.lit(side).alias("side"), F.pmod(F.xxhash64("id", "part"), F.lit(blocks)).cast("int").alias("block"), "split", "id", F.col("part").cast("int").alias("part"), "pace", "f"))
    model = held = cut(sides[0].unionByName(sides[1]).mapInArrow(_packed_start(rank + 2), _MODEL), "factors")
    weights = cut(_weights(dealt, parts), "weights")
    none, shared = F.lit(None), not weights.isEmpty()
    for epoch in range(epochs):
        for s in range(blocks):
            examples = strata.where(F.col("stratum") == s).select("block", F.lit(2).alias("kind"), F.xxhash64("place", F.lit(epoch)).alias("place"), F.lit(False).alias("split"), "id", "part", "other", "other_part", "r", none.cast("array<double>").alias("f"))
            at = F.when(F.col("side") == 0, F.col("block")).otherwise(F.pmod(F.col("block") - s, F.lit(blocks)))
            known = model.select(at.alias("block"), F.col("side").alias("kind"), F.lit(0).cast("long").alias("place"), "split", "id", "part", none.cast("array<bigint>").alias("other"), none.cast("array<int>").alias("other_part"), F.col("pace").alias("r"), "f")
            dealt_rows = known.unionByName(examples).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "kind", "place")
            stepped = dealt_rows.mapInArrow(_sweep(rate * decay**epoch, l2, rank, blocks, s, epoch * blocks + s), _MODEL)
            old, model = held, cut(stepped, "factors")
            held = model
            drop(old)
        model = _averaged(model, weights) if shared else model
    plain = _unpacked(model, rank + 2).where("part = 0")
    plain = cut(plain.select("side", "id", F.col("f").alias("factors")), "factors", by=["side"])
    for old in (held, strata, weights, *parts):
        drop(old)
    out = [plain.where(F.col("side") == side).select("id", "factors") for side in (0, 1)]
    if start:
        out = [o.unionByName(old.join(o, "id", "left_anti")) for o, old in zip(out, (start.users, start.items), strict=True)]
    return Factors(out[0], out[1], mean)


def _weights(dealt: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """side, id, part and n, the ratings of each part of a split id; such ids are few (see :func:`_dealt`)."""
    sides = []
    for side, (c, own) in enumerate(zip(("user", "item"), parts, strict=True)):
        split = F.broadcast(own.where("parts > 1").select(F.col("id").alias(c)))
        sides.append(dealt.join(split, c, "left_semi").groupBy(F.lit(side).alias("side"), F.col(c).alias("id"), F.col(f"{c}_part").cast("int").alias("part")).agg(F.count(F.lit(1)).alias("n")))
    return sides[0].unionByName(sides[1])


def _averaged(model: DataFrame, weights: DataFrame) -> DataFrame:
    """Parts of one id get their mean, weighed by their ratings; ids in one part are as they were."""
    split = model.where("split").withColumn("own", F.col("id")[0]).withColumn("own_part", F.col("part")[0])
    n = weights.select("side", F.col("id").alias("own"), F.col("part").alias("own_part"), "n")
    mean = split.join(F.broadcast(n), ["side", "own", "own_part"]).select("side", "own", "n", F.posexplode("f").alias("d", "x")).groupBy("side", "own", "d").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"))
    vectors = mean.groupBy("side", "own").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda e: e["x"]).alias("mean"))
    same = split.join(F.broadcast(vectors), ["side", "own"], "left").withColumn("f", F.coalesce("mean", "f"))
    return model.where("not split").unionByName(same.select(*model.columns))


def predict_ratings(pairs: DataFrame, model: Factors, user: str, item: str) -> DataFrame:
    """``pairs`` with ``prediction``: the mean where neither side is known; a side that isn't known adds nothing."""
    u = model.users.select(F.col("id").alias("__u"), F.col("factors").alias("__p"))
    i = model.items.select(F.col("id").alias("__i"), F.col("factors").alias("__q"))
    joined = pairs.join(u, pairs[user] == F.col("__u"), "left").join(i, pairs[item] == F.col("__i"), "left")
    product = F.aggregate(F.zip_with("__p", "__q", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return joined.withColumn("prediction", F.lit(model.mean) + F.coalesce(product, F.element_at("__p", -2), F.element_at("__q", -1), F.lit(0.0))).drop("__u", "__p", "__i", "__q")


def best_items(model: Factors, users: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """user, item, score, rank: the ``k`` items of the largest predictions for each of the stated ``users`` (column ``id``).

    Blocks of users go to each block of items and meet it as a matrix in a task; each pair of blocks keeps ``k`` rows a user. Ties go to the lesser item.
    """

    def packed(df: DataFrame, name: str) -> tuple[DataFrame, int]:
        blocks = max(1, -(-df.count() // block))
        dealt = df.withColumn(f"{name}_block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
        return dealt.groupBy(f"{name}_block").agg(F.collect_list(F.struct("id", "factors")).alias(name)), blocks

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                ids, vectors = [], []
                for c in ("us", "its"):
                    rows = batch.column(c)[n].values
                    ids.append(rows.field("id").to_numpy())
                    vectors.append(rows.field("factors").flatten().to_numpy().reshape(len(rows), -1))
                points = vectors[0] @ vectors[1].T
                order = np.lexsort((np.broadcast_to(ids[1], points.shape), -points), axis=1)[:, :k]
                users_, items_ = np.repeat(ids[0], order.shape[1]), ids[1][order.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(users_), pa.array(items_), pa.array(np.take_along_axis(points, order, 1).ravel())], ["user", "item", "score"])

    asked = model.users.join(users.select("id").distinct(), "id", "left_semi")
    (us, _), (its, blocks) = packed(asked, "us"), packed(model.items, "its")
    met = us.withColumn("its_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(its, "its_block")
    found = met.select("us", "its").mapInArrow(score, "user long, item long, score double")
    rank = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("score"), "item"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("score", F.col("score") + model.mean)


# learners over sparse examples
def _margin(classes: list[str], c: float) -> Callable:
    """Passive-aggressive (I): the least change that gives the right class a margin of one over the strongest other, at most ``c``."""

    def step(label: str, x: np.ndarray, w: np.ndarray) -> np.ndarray | None:
        scores = x @ w
        right = classes.index(label)
        others = [j for j in range(len(classes)) if j != right]
        wrong = max(others, key=lambda j: (scores[j], -j))
        loss = 1 - (scores[right] - scores[wrong])
        norm = 2 * float(x @ x)
        if loss <= 0 or norm == 0:
            return None
        tau = min(c, loss / norm)
        change = np.zeros_like(w)
        change[:, right], change[:, wrong] = tau * x, -tau * x
        return change

    return step


def _binary_margin(c: float) -> Callable:
    """Passive-aggressive (I) of labels -1 and 1."""

    def step(label: str, x: np.ndarray, w: np.ndarray) -> np.ndarray | None:
        y = float(label)
        loss, norm = 1 - y * float(x @ w[:, 0]), float(x @ x)
        return (min(c, loss / norm) * y * x)[:, None] if loss > 0 and norm > 0 else None

    return step


def _machine(rate: float, l2: float) -> Callable:
    """Factorisation machine of degree two with logistic loss, labels -1 and 1; columns are the weight and the factors."""

    def step(label: str, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        y, v = float(label), w[:, 1:]
        summed = x @ v
        z = float(x @ w[:, 0]) + 0.5 * float((summed**2 - (x**2) @ v**2).sum())
        slope = -y / (1 + np.exp(min(50.0, y * z)))
        grad = np.empty_like(w)
        grad[:, 0] = slope * x
        grad[:, 1:] = slope * (x[:, None] * summed[None, :] - (x**2)[:, None] * v)
        return -rate * (grad + l2 * w)

    return step


@dataclasses.dataclass
class Learner:
    """``step`` takes an example's label, values and its features' weights (a row each) and returns their change or None."""

    step: Callable
    width: int
    start: Callable[[Column], Column]


def passive_aggressive(c: float = 1.0) -> Learner:
    return Learner(_binary_margin(c), 1, lambda feature: F.array(F.lit(0.0)))


def multiclass_passive_aggressive(classes: list[str], c: float = 1.0) -> Learner:
    return Learner(_margin(classes, c), len(classes), lambda feature: F.array(*[F.lit(0.0)] * len(classes)))


def factorization_machine(rank: int = 4, rate: float = 0.05, l2: float = 0.001) -> Learner:
    unit = lambda feature, d: (F.pmod(F.xxhash64(feature, F.lit(d)), F.lit(1 << 20)) / float(1 << 20) - 0.5) * 0.2
    return Learner(_machine(rate, l2), 1 + rank, lambda feature: F.array(F.lit(0.0), *[unit(feature, d) for d in range(rank)]))


def _shard_pass(learner: Learner) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, place, weights, matrix, touched = None, {}, [], None, None

        def leave() -> Iterator[pa.RecordBatch]:
            if matrix is not None:
                names = list(place)
                for lo in range(0, len(names), 4096):
                    rows = [i for i in range(lo, min(lo + 4096, len(names))) if touched[i]]
                    lists = pa.array([matrix[i].tolist() for i in rows], pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in rows], pa.string()), lists, pa.array([int(touched[i]) for i in rows], pa.int64())], ["feature", "w", "n"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    yield from leave()
                    shard, place, weights, matrix = row["shard"], {}, [], None
                if row["kind"] == 0:
                    place[row["feature"]] = len(weights)
                    weights.append(row["w"])
                    continue
                if matrix is None:
                    matrix, touched = np.array(weights, float).reshape(len(weights), learner.width), np.zeros(len(weights), np.int64)
                at = np.array([place[f] for f in row["names"]])
                touched[at] += 1
                change = learner.step(row["label"], np.array(row["values"], float), matrix[at])
                if change is not None:
                    matrix[at] += change
        yield from leave()

    return run


def mixed(examples: DataFrame, learner: Learner, epochs: int = 1, start: DataFrame | None = None) -> DataFrame:
    """feature and w (array) after ``epochs`` rounds of iterative parameter mixing.

    ``examples`` has shard (long), id (the order within a shard), label (string) and features (map from name to value). A feature's new weights
    are the mean over the shards that have it, weighed by their examples with it. Examples without label or feature change nothing. ``start``: the
    weights of an earlier call; features that have no example keep theirs.
    """
    rows = cut(examples.where("label is not null and features is not null and size(features) > 0").select("shard", "id", "label", F.map_keys("features").alias("names"), F.map_values("features").alias("values")), "examples")
    needed = cut(rows.select("shard", F.explode("names").alias("feature")).distinct(), "shard-features")
    model = start
    for _ in range(epochs):
        held = needed.join(model, "feature", "left").withColumn("w", F.coalesce("w", learner.start(F.col("feature")))) if model is not None else needed.withColumn("w", learner.start(F.col("feature")))
        none = F.lit(None)
        first = held.select("shard", F.lit(0).alias("kind"), none.cast("long").alias("id"), "feature", "w", none.cast("string").alias("label"), none.cast("array<string>").alias("names"), none.cast("array<double>").alias("values"))
        then = rows.select("shard", F.lit(1).alias("kind"), "id", none.cast("string").alias("feature"), none.cast("array<double>").alias("w"), "label", "names", "values")
        ordered = first.unionByName(then).repartition("shard").sortWithinPartitions("shard", "kind", "id", "feature", "label")
        seen = ordered.mapInArrow(_shard_pass(learner), "feature string, w array<double>, n long")
        mean = seen.groupBy("feature").agg(*[(F.sum(F.col("w")[i] * F.col("n")) / F.sum("n")).alias(f"w{i}") for i in range(learner.width)])
        new = mean.select("feature", F.array(*[f"w{i}" for i in range(learner.width)]).alias("w"))
        model = cut(new.unionByName(model.join(new, "feature", "left_anti")) if model is not None else new, "weights")
    return model


def scores(examples: DataFrame, model: DataFrame, machine: bool = False) -> DataFrame:
    """id and scores (one for each class, or one of two classes) of examples with id and features; unknown features count nothing."""
    parts = examples.select("id", F.explode_outer("features").alias("feature", "x")).join(model, "feature", "left")
    width = F.transform(F.coalesce("w", F.array().cast("array<double>")), lambda w: w)
    terms = parts.select("id", F.posexplode_outer(width).alias("d", "w"), "x")
    sums = terms.groupBy("id", "d").agg(F.sum(F.col("w") * F.col("x")).alias("s"), F.sum(F.pow(F.col("w") * F.col("x"), 2)).alias("s2"))
    if machine:
        value = F.when(F.col("d") == 0, F.col("s")).otherwise((F.col("s") * F.col("s") - F.col("s2")) / 2)
        return sums.groupBy("id").agg(F.array(F.coalesce(F.sum(value), F.lit(0.0))).alias("scores"))
    listed = F.array_sort(F.collect_list(F.when(F.col("d").isNotNull(), F.struct("d", "s"))))
    return sums.groupBy("id").agg(F.transform(listed, lambda e: e["s"]).alias("scores"))
