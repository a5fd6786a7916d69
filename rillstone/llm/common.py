"""Shared ground of the training-data operators: scratch space, row ranks, worker setup."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch as files

#: Rows of an Arrow batch: Spark's setting, its default, and ours.
BATCH_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000")
PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, bound their batches, and make sure checkpoints have a folder.

    Batches of Spark's default of 10,000 rows hold too much text for two workers beside
    an executor's heap; a count that was set to something else stays. The folder is what
    the cluster names in spark.checkpoint.dir; a folder of our own is set only where that
    is unset and driver and executors are one process, as in tests.
    """
    env = spark.sparkContext.environment
    if PACKAGE_ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH"), PACKAGE_ROOT) if x)
    if spark.conf.get(BATCH_ROWS[0], BATCH_ROWS[1]) == BATCH_ROWS[1]:
        spark.conf.set(BATCH_ROWS[0], BATCH_ROWS[2])
    files.folder(spark)
    return spark


def exact(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, replaced: list[str]) -> list[str]:
    """Columns of df whose names, in any case, are none of those."""
    gone = {c.lower() for c in replaced}
    return [c for c in df.columns if c.lower() not in gone]


def packed(names: list[str]) -> Column:
    """Columns as one struct `_row`, so that no helper column can have the name of one."""
    return F.struct(*(map(exact, names) if names else [F.lit(0).alias("none")])).alias("_row")


def unpacked(names: list[str]) -> list[Column]:
    """The columns that packed() took."""
    return [F.col("_row").getField(c).alias(c) for c in names]


def bucket_labels(spark: SparkSession, n: int) -> list[int]:
    """n numbers that hash partitioning to n partitions puts in n different ones."""
    found, tried = {}, max(64, 16 * n)
    while len(found) < n:
        rows = spark.range(tried).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()
        found, tried = {r["p"]: r["id"] for r in rows}, tried * 4
    return [found[p] for p in range(n)]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder, not yet created."""
    return files.fresh(ready(spark), name)


def give_back() -> None:
    """Hand a worker's freed memory back to the system, as two workers and a heap share an executor's; where glibc is not, nothing happens."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_PASSING: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that saved() writes inside are removed at the end, but for those to keep."""
    _PASSING.append([])
    try:
        yield
    finally:
        for path in _PASSING.pop():
            files.remove(spark, path)


def saved(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The rows of df, written once to shared storage and read again.

    Cuts lineage: a lost executor costs the task it ran, not the stages before.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    if _PASSING and not keep:
        _PASSING[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, keys: list[Column]) -> DataFrame:
    """(_row, _rank): the rows of df as structs with gapless ranks from 0 in the order of keys, without a one-task window.

    Rows are range-partitioned and sorted, then checkpointed, so that every later
    read sees the same partitions. A row's rank is its place in its partition plus
    the rows of the partitions before; only a row per partition is summed up in one
    place. Keys should end in something that tells rows apart, or a run of equal
    keys shares one partition. df is read twice, first to find the ranges.
    """
    spark = ready(df.sparkSession)
    by = [f"_k{i}" for i in range(len(keys))]
    laid = df.select(packed(df.columns), *[k.alias(c) for k, c in zip(keys, by, strict=True)])
    laid = laid.repartitionByRange(*by).sortWithinPartitions(*by).select("_row").checkpoint(eager=True)
    # Row number within the partition: the low 33 bits of Spark's increasing id.
    laid = laid.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = {r["_part"]: r["count"] for r in laid.groupBy("_part").count().collect()}
    before, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        before.append((part, total))
        total += sizes.get(part, 0)
    offsets = spark.createDataFrame(before or [(0, 0)], "_part int, _before long")
    out = laid.join(F.broadcast(offsets), "_part")  # a row per partition
    return out.select("_row", (F.col("_before") + F.col("_at")).alias("_rank"))
