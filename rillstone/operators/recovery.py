"""What a lost partition costs, and how its tables come back.

Schemes differ in what they keep and what they run again: a log of changes over a snapshot
(`changes`, `redo`); a snapshot and all input since (replaying an application from its
snapshot, see queries.py); a snapshot of the partitions that depend on the lost one and
their input (`dependent_keys`); the lost partition alone, with what its transactions had read
elsewhere taken from a log (`determinants`, `ledger_with_determinants`); or the lost partition
alone, which loses what others had written to it (`local_rollback`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import transactions as txn
from ..plans.transactions import partition_of
from . import apps


def dependency_edges(events: DataFrame, n_keys: int, partitions: int) -> DataFrame:
    """(src, dst) of partitions that transfers tie together, in both directions."""
    moved = events.filter((F.col("kind") == "transfer") & (F.col("amount") > 0))
    a, b = partition_of(F.col("src"), n_keys, partitions), partition_of(F.col("tgt"), n_keys, partitions)
    one = moved.select(a.alias("src"), b.alias("dst")).distinct()
    return one.union(one.select("dst", "src")).distinct()


def dependency_closure(edges: DataFrame, partitions: int) -> DataFrame:
    """(lost, affected): all partitions to roll back if one is lost, itself included.

    Paths double in each turn, so there are at most log2(partitions) + 1 turns, over
    at most partitions^2 rows.
    """
    spark = edges.sparkSession
    own = spark.range(partitions).select(F.col("id").alias("lost"), F.col("id").alias("affected"))
    paths = own.union(edges.toDF("lost", "affected")).distinct()
    for _ in range(max(1, partitions.bit_length())):
        paths = paths.join(paths.toDF("affected", "further"), "affected").select("lost", F.col("further").alias("affected")).distinct()
    return paths


def local_rollback(events: DataFrame, failed_after: int, lost: int, n_keys: int, partitions: int) -> DataFrame:
    """Write events that a local rollback keeps, as operations.

    Partition `lost` restarts from its snapshot at bid failed_after and is replayed only
    with the transactions that belong to it by their first key; what other partitions'
    transactions had written to it since is gone.
    """
    packed = events.select("bid", "is_read", F.posexplode(F.arrays_zip("keys", "values")).alias("idx", "_op"), F.get("keys", F.lit(0)).alias("_first"))
    ops = packed.select("bid", "is_read", "idx", F.col("_op.keys").alias("key"), F.col("_op.values").alias("delta"), "_first")
    gone = (partition_of(F.col("key"), n_keys, partitions) == lost) & (partition_of(F.col("_first"), n_keys, partitions) != lost) & (F.col("bid") <= failed_after)
    return ops.filter(~gone).drop("_first")


# A log of changes over a snapshot


def changes(writes: DataFrame, before: DataFrame, n_keys: int) -> DataFrame:
    """(epoch, key, value): what each epoch left in the keys that it changed, the log of a run.

    writes: (epoch, key, delta); before: (key, value). Sums of epochs are added up per key, a
    row for each key and epoch.
    """
    sums = txn.on_known_keys(writes, n_keys).groupBy("key", "epoch").agg(F.sum("delta").alias("delta"))
    so_far = F.sum("delta").over(Window.partitionBy("key").orderBy("epoch"))
    return sums.join(before, "key").select("epoch", "key", (F.col("value") + so_far).alias("value"))


def redo(snapshot: DataFrame, log: DataFrame, last_epoch: int) -> DataFrame:
    """(key, value) of a snapshot after the log up to an epoch: the latest logged value, or the snapshot's own."""
    latest = log.filter(F.col("epoch") <= last_epoch).groupBy("key").agg(F.max_by("value", "epoch").alias("_new"))
    return snapshot.join(latest, "key", "left").select("key", F.coalesce("_new", "value").alias("value"))


# Partitions that depend on the lost one


def dependent_keys(events: DataFrame, lost: int, n_keys: int, partitions: int) -> DataFrame:
    """(pid): partitions to roll back if one is lost, by the keys that transactions since the snapshot share."""
    touched = events.select(F.array_sort(F.array_distinct(F.transform("keys", lambda k: partition_of(k, n_keys, partitions)))).alias("p"))
    pairs = touched.select(F.explode("p").alias("src"), "p").select("src", F.explode("p").alias("dst")).filter("src <> dst").distinct()
    return dependency_closure(pairs, partitions).filter(F.col("lost") == lost).select(F.col("affected").alias("pid"))


def rolled_back(current: DataFrame, snapshot: DataFrame, events: DataFrame, lost: int, n_keys: int, partitions: int) -> DataFrame:
    """(key, value) after partition `lost` was lost and came back with all that depends on it.

    current: the table as it was, of which partition `lost` can't be read; snapshot: the table
    before `events`. Affected partitions start from the snapshot and run the transactions that
    touch them again; all others keep what they have.
    """
    affected = [r["pid"] for r in dependent_keys(events, lost, n_keys, partitions).collect()]  # of `partitions` at most
    mine = partition_of(F.col("key"), n_keys, partitions).isin(affected)
    ops = txn.key_ops(txn.valid(events, txn.gs_aborts()).filter(~F.col("is_read")), "keys", "values").filter(mine)
    sums = ops.groupBy("key").agg(F.sum("values_op").alias("delta"))
    again = snapshot.filter(mine).join(sums, "key", "left").select("key", (F.col("value") + F.coalesce("delta", F.lit(0))).alias("value"))
    return current.filter(~mine).select("key", "value").unionByName(again)


# The lost partition alone, with a log of what it had read elsewhere


def determinants(events: DataFrame, starts: DataFrame, n_keys: int, partitions: int) -> DataFrame:
    """(bid, account, asset): the balances that transfers between partitions saw at their source.

    starts: (epoch, key, account, asset) at the start of each epoch, of the keys that transfer in it at least.
    """
    moves = txn.valid(events, txn.sl_aborts()).filter(F.col("kind") == "transfer")
    apart = moves.filter(partition_of(F.col("src"), n_keys, partitions) != partition_of(F.col("tgt"), n_keys, partitions))
    return apart.join(starts.withColumnRenamed("key", "src"), ["epoch", "src"]).select("bid", "account", "asset")


def ledger_with_determinants(events: DataFrame, snapshot: DataFrame, log: DataFrame, lost: int, n_keys: int, partitions: int) -> DataFrame:
    """(key, account, asset) of partition `lost`, from its snapshot and the input since, without any other partition.

    Events that reach the partition from others bring a logged balance of their source.
    """
    mine = lambda c: partition_of(F.col(c), n_keys, partitions) == lost
    ok = txn.valid(events, txn.sl_aborts()).filter(mine("src") | F.coalesce(mine("tgt"), F.lit(False)))
    own = snapshot.filter(mine("key"))
    ok = ok.join(log.withColumnRenamed("account", "_a").withColumnRenamed("asset", "_b"), "bid", "left")
    logged, amount = F.col("_a").isNotNull(), F.col("amount").cast("long")
    bonus = lambda c: (F.col("amount") + F.col(c) * 0.1).cast("long")
    plain = lambda key, da, db: F.struct(F.col("epoch").cast("long").alias("epoch"), F.lit(False).alias("moves"), F.col(key).cast("long").alias("key"), F.lit(None).cast("long").alias("tgt"), da.alias("da"), db.alias("db"))
    ends = F.array(F.when(mine("tgt"), plain("tgt", bonus("_a"), bonus("_b"))), F.when(mine("src"), plain("src", -amount, -amount)))
    known = ok.filter(logged & F.col("epoch").isNotNull()).select(F.explode(F.array_compact(ends)).alias("op")).select("op.*")
    # Transfers between own keys see the start of their epoch.
    history = apps.sl_history(apps.sl_ops(ok.filter(~logged)).unionByName(known), own)
    return apps.sl_after(history, own.select("key", "account", "asset"))
