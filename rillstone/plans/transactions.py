"""Transactions as plans: abort rules, decomposition into keyed operations, epochs.

Every abort rule looks at the event alone, so aborted transactions are left out before
any state is computed, and nothing has to be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The speed limit of a toll report, and what a flagged event carries.
MAX_SPEED = 400
FLAG = -1


def gs_aborts() -> Column:
    """A write with a negative delta; reads never abort."""
    return ~F.col("is_read") & F.exists("values", lambda v: v < 0)


def sl_aborts() -> Column:
    """A deposit below 0, or a transfer of nothing."""
    return F.when(F.col("kind") == "deposit", F.col("amount") < 0).otherwise(F.col("amount") <= 0)


def ob_aborts() -> Column:
    """A negative quantity of a buy or topping, or an alert flagged in its price."""
    return F.when(F.col("kind") == "alert", F.col("price") == FLAG).otherwise(F.col("qty") < 0)


def tp_aborts() -> Column:
    return F.col("speed") > MAX_SPEED


def valid(events: DataFrame, aborts: Column, abort_enabled: bool = True) -> DataFrame:
    """Events whose transactions commit. With aborts switched off, flagged events are ordinary data."""
    return events.filter(~aborts) if abort_enabled else events


def key_ops(events: DataFrame, keys: str, *values: str) -> DataFrame:
    """An operation for each key that an event names, with the values at the same place, in column `key`."""
    packed = events.select("*", F.posexplode(F.arrays_zip(*[F.col(c) for c in (keys, *values)])).alias("idx", "_op"))
    out = packed.withColumn("key", F.col("_op").getField(keys))
    for v in values:
        out = out.withColumn(v + "_op", F.col("_op").getField(v))
    return out.drop("_op")


def on_known_keys(ops: DataFrame, n_keys: int) -> DataFrame:
    """Operations on keys that there are; one on a missing key is dropped, and it alone."""
    return ops.filter((F.col("key") >= 0) & (F.col("key") < n_keys))


def partition_of(key: Column, n_keys: int, partitions: int) -> Column:
    """Range partition of a key: key div ceil(n / partitions)."""
    return F.floor(key / -(-n_keys // partitions))
