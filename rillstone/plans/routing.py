"""How rows go to tasks: the groupings of a dataflow as partitionings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .transactions import partition_of

#: Rows that all_tasks() sends everywhere; beyond that the caller's join shuffles.
MAX_EVERYWHERE = 100_000


def shuffle_grouping(df: DataFrame, tasks: int) -> DataFrame:
    """Rows in turn to all tasks."""
    return df.repartition(tasks)


def fields_grouping(df: DataFrame, tasks: int, *fields: str) -> DataFrame:
    """Rows of equal fields to the same task."""
    return df.repartition(tasks, *fields)


def key_grouping(df: DataFrame, key: str, n_keys: int, partitions: int) -> DataFrame:
    """df with `pid`, the range of its key, and ranges in partitions of their own."""
    return df.withColumn("pid", partition_of(F.col(key), n_keys, partitions)).repartitionByRange(partitions, "pid")


def all_tasks(df: DataFrame) -> DataFrame:
    """A table for every task, if it is small enough to be copied; as it is if not."""
    return F.broadcast(df) if df.limit(MAX_EVERYWHERE + 1).count() <= MAX_EVERYWHERE else df


def partial_key_sum(df: DataFrame, key: str, value: str, salts: int = 16) -> DataFrame:
    """(key, total): sums in two steps, a hot key's rows over several tasks first.

    A row's salt is a hash of the row, so that a task that runs again deals its rows alike.
    """
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salts))
    some = df.select(key, value, salt.alias("_salt")).groupBy(key, "_salt").agg(F.sum(value).alias("_part"))
    return some.groupBy(key).agg(F.sum("_part").alias("total"))


def one_task(df: DataFrame) -> DataFrame:
    """All rows in one task, for tables of at most MAX_EVERYWHERE rows; larger ones are refused."""
    if df.limit(MAX_EVERYWHERE + 1).count() > MAX_EVERYWHERE:
        raise ValueError(f"more than {MAX_EVERYWHERE} rows are too many for one task")
    return df.repartition(1)
