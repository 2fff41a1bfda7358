"""Transaction log reassembly: which changes survive, and the store after each epoch.

A log record has seq, source, action (``commit``, ``abort``, ``savepoint``, ``rollback`` or ``change``), key and mark (of the value;
null deletes the key). Each source runs transactions one after the other. A rollback undoes the remaining changes since its
transaction's latest savepoint and removes that; without one, all of them. A commit applies the remaining changes, in log order,
to one shared store. Every ``per_epoch`` commits of the log end an epoch, and so does the last commit.

Plan. The log is dealt by ranges of seq into blocks, as many as there are shuffle partitions, and written. What reaches over
blocks (ended transactions of a source, commits) is counted inside the blocks and carried by :func:`prefix`. Then a transaction is
one window group, and a rollback belongs to the depth of open savepoints before it: a change at depth d is undone by the next
rollback from depth d. The survivors give one last-writer-wins map for each block of ``width`` epochs; :func:`prefix` combines the maps
into checkpoints at the starts of the blocks, and all blocks replay at the same time from theirs. Nothing that grows with
the log goes through one task, to the driver (one number: the last block) or into a broadcast; a transaction should fit a task,
and windows spill beyond memory.

Records without seq are left out. Of rows that share a seq the one with the largest (source, mark) is the record. A null source is
one source, a null key one key. An empty log has no epoch and no rows. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.plans.lineage import cut

CHANGE, COMMIT, ABORT, SAVEPOINT, ROLLBACK = "change", "commit", "abort", "savepoint", "rollback"


def from_documents(docs: DataFrame, labels: DataFrame, keys: int = 300) -> DataFrame:
    """Log records of ``documents``: crc32 of the decimal doc_id gives action and key, crc32 of ``key:text`` the mark."""
    toxic = labels.filter("toxic = 1").select(F.col("doc_id").alias("toxic_id")).distinct()
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    key = F.floor(h / 100) % keys
    mark = F.crc32(F.concat_ws(":", key.cast("string"), F.col("text")).cast("binary"))
    rows = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "source", F.when(F.col("text").isNotNull(), mark).alias("mark"))
    one = rows.groupBy("doc_id").agg(F.max(F.struct("source", "mark")).alias("r")).select("doc_id", "r.*")
    kind = h % 23
    action = F.when(kind <= 1, COMMIT).when(kind == 2, ABORT).when(kind <= 4, SAVEPOINT).when(kind <= 6, ROLLBACK).otherwise(CHANGE)
    return one.join(toxic, F.col("doc_id") == F.col("toxic_id"), "left").select(
        F.col("doc_id").alias("seq"), "source", action.alias("action"), key.alias("key"), F.when(F.col("toxic_id").isNull(), F.col("mark")).alias("mark"))


def prefix(parts: DataFrame, keys: list[str], combine: dict[str, Column], every_key: bool = False) -> DataFrame:
    """For each block the combination of all earlier blocks' rows: block, ``keys`` and the columns of ``combine``.

    ``parts`` has ``block`` (0 and up), ``keys`` and the values; ``combine`` maps a value column to its aggregate, which must be
    associative. A tree of intervals whose lengths are powers of two is summed up level by level in one aggregation; each block then
    takes one interval for each set bit of its number. Blocks without earlier rows are absent. With ``every_key`` a block gets
    all earlier keys, else those of its own rows.
    """
    last = parts.agg(F.max("block")).first()[0] or 0
    levels = F.sequence(F.lit(0), F.lit(max(0, last.bit_length() - 1)))
    values = [c.alias(name) for name, c in combine.items()]
    nodes = parts.select("*", F.explode(levels).alias("level")).withColumn("node", F.expr("shiftright(block, level)")).filter("node % 2 = 0").groupBy("level", "node", *keys).agg(*values)
    own = [] if every_key else keys
    wanted = parts.select("block", *own).distinct().select("block", *own, F.explode(levels).alias("level")).withColumn("node", F.expr("shiftright(block, level) - 1")).filter("node % 2 = 0")
    return wanted.join(nodes, ["level", "node", *own]).groupBy("block", *keys).agg(*values)


def in_blocks(log: DataFrame) -> DataFrame:
    """The log with ``block`` (ascending ranges of seq) and ``src`` (never null), written once so that all later steps see the same blocks."""
    rows = log.filter(F.col("seq").isNotNull()).groupBy("seq").agg(F.max(F.struct("source", "mark", "action", "key")).alias("r")).select("seq", "r.*")
    blocks = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = rows.select("seq", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("src"), "action", "key", "mark")
    return cut(named.repartitionByRange(blocks, "seq").withColumn("block", F.spark_partition_id()), "log-blocks")


def fates(blocks: DataFrame) -> DataFrame:
    """A row for each change: seq, key, mark, undone_by (rollback), end and ending (seq and action of the transaction's end, null at the log's end)."""
    ends = F.col("action").isin(COMMIT, ABORT).cast("long")
    before = prefix(blocks.groupBy("block", "src").agg(F.sum(ends).alias("earlier")), ["src"], {"earlier": F.sum("earlier")})
    inside = F.sum(ends).over(Window.partitionBy("block", "src").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    numbered = blocks.withColumn("inside", F.coalesce(inside, F.lit(0))).join(before, ["block", "src"], "left").withColumn("txn", F.coalesce("earlier", F.lit(0)) + F.col("inside"))
    group = Window.partitionBy("src", "txn")
    running = group.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("action") == SAVEPOINT, 1).when(F.col("action") == ROLLBACK, -1).otherwise(0)
    walked = numbered.withColumn("walk", F.sum(step).over(running)).withColumn("depth", F.col("walk") - F.least(F.lit(0), F.min("walk").over(running)))
    level = F.when(F.col("action") == ROLLBACK, F.lag("depth", 1, 0).over(group.orderBy("seq"))).otherwise(F.col("depth"))
    ended = F.when(F.col("action").isin(COMMIT, ABORT), F.struct("seq", "action"))
    levelled = walked.withColumn("level", level).withColumn("over", F.max(ended).over(group))
    back = Window.partitionBy("src", "txn", "level").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    undone = F.last(F.when(F.col("action") == ROLLBACK, F.col("seq")), ignorenulls=True).over(back)
    return levelled.withColumn("undone_by", undone).filter(F.col("action") == CHANGE).select("seq", "key", "mark", "undone_by", F.col("over.seq").alias("end"), F.col("over.action").alias("ending"))


def commits(blocks: DataFrame, per_epoch: int = 4) -> DataFrame:
    """commit (seq), number (from 0, over the whole log) and epoch (from 1)."""
    mine = blocks.filter(F.col("action") == COMMIT)
    before = prefix(mine.groupBy("block").agg(F.count("*").alias("earlier")), [], {"earlier": F.sum("earlier")})
    inside = F.row_number().over(Window.partitionBy("block").orderBy("seq")) - 1
    numbered = mine.withColumn("inside", inside).join(before, "block", "left").select(F.col("seq").alias("commit"), (F.coalesce("earlier", F.lit(0)) + F.col("inside")).alias("number"))
    return numbered.withColumn("epoch", F.floor(F.col("number") / per_epoch) + 1)


def states(writes: DataFrame, epochs: DataFrame, width: int = 64) -> DataFrame:
    """epoch, n (keys stored after it) and total (sum of their marks).

    ``writes`` has the last mark of each epoch and key (epoch, key, mark), ``epochs`` each epoch once.
    """
    block = F.floor(F.col("epoch") / width)
    writes, epochs = writes.withColumn("block", block), epochs.withColumn("block", block)
    maps = writes.groupBy("block", "key").agg(F.max(F.struct("epoch", "mark")).alias("last"))
    # Blocks without a write have a checkpoint too: a row without a key asks for it.
    asked = epochs.select("block").distinct().select("block", F.lit(None).cast("long").alias("key"), F.lit(None).cast(maps.schema["last"].dataType).alias("last"))
    checkpoints = cut(prefix(maps.unionByName(asked), ["key"], {"last": F.max("last")}, every_key=True).filter("last is not null").select("block", "key", "last.mark"), "checkpoints")
    starts = checkpoints.groupBy("block").agg(F.count("mark").alias("n0"), F.sum("mark").alias("total0"))
    touched = writes.select("block", "key", "epoch", "mark").unionByName(checkpoints.select("block", "key", F.lit(-1).cast("long").alias("epoch"), "mark"))
    was = F.lag("mark").over(Window.partitionBy("block", "key").orderBy("epoch"))
    moves = touched.withColumn("was", was).filter("epoch >= 0").groupBy("epoch").agg(
        F.sum(F.col("mark").isNotNull().cast("long") - F.col("was").isNotNull().cast("long")).alias("dn"), F.sum(F.coalesce("mark", F.lit(0)) - F.coalesce("was", F.lit(0))).alias("dtotal"))
    replay = Window.partitionBy("block").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    joined = epochs.join(moves, "epoch", "left").join(starts, "block", "left")
    return joined.select("epoch", *[(F.coalesce(f"{c}0", F.lit(0)) + F.sum(F.coalesce(f"d{c}", F.lit(0))).over(replay)).alias(c) for c in ("n", "total")])


def reassemble(log: DataFrame, per_epoch: int = 4, width: int = 64) -> DataFrame:
    """kind, id, n, value: ``state`` rows with epoch, stored keys and sum of marks; ``abort`` and ``rollback`` rows with the undone change's
    seq, the undoing record's seq (null at the log's end) and the change's key."""
    blocks = in_blocks(log)
    fate = cut(fates(blocks), "log-fates")
    done = cut(commits(blocks, per_epoch), "log-commits")
    alive = fate.filter("undone_by is null and ending = 'commit'").join(done, fate["end"] == done["commit"])
    writes = cut(alive.groupBy("epoch", "key").agg(F.max(F.struct("number", "seq", "mark")).alias("w")).select("epoch", "key", "w.mark"), "epoch-writes")
    after = states(writes, done.select("epoch").distinct(), width).select(F.lit("state").alias("kind"), F.col("epoch").alias("id"), "n", F.col("total").alias("value"))
    undone = fate.filter("undone_by is not null or ending is null or ending = 'abort'")
    lost = undone.select(F.when(F.col("undone_by").isNotNull(), ROLLBACK).otherwise(ABORT).alias("kind"), F.col("seq").alias("id"), F.coalesce("undone_by", "end").alias("n"), F.col("key").alias("value"))
    return after.unionByName(lost)
