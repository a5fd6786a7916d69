"""Parquet tables, and the application streams derived from `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from . import scratch

#: Events of a punctuated epoch.
EPOCH_SIZE = 5000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_count(spark: SparkSession, sf_dir: str) -> int:
    """Size of the key domain: keys are 0 up to the largest user."""
    return (table(spark, sf_dir, "events").agg(F.max("user_id")).first()[0] or 0) + 1


def app_events(spark: SparkSession, sf_dir: str, epoch_size: int = EPOCH_SIZE) -> DataFrame:
    """(bid, epoch, user_id, k2, event_type, cents): a serial order of events and two keys for each.

    Events whose second key is the first are left out.
    """
    n = key_count(spark, sf_dir)
    ev = table(spark, sf_dir, "events")
    bid = F.col("event_id") + 1
    return ev.select(
        bid.alias("bid"),
        F.floor((bid - 1) / epoch_size).alias("epoch"),
        "user_id",
        ((F.col("user_id") * 7 + 13) % n).alias("k2"),
        "event_type",
        F.round(F.col("value") * 100).cast("long").alias("cents"),
    ).filter(F.col("k2") != F.col("user_id"))


def gs_events(ev: DataFrame) -> DataFrame:
    """(bid, epoch, keys, values, is_read): views and clicks read, others write, errors are flagged to abort."""
    delta = F.when(F.col("event_type") == "error", -1).otherwise(F.col("cents") % 100)
    return ev.select("bid", "epoch", F.array("user_id", "k2").alias("keys"), F.array(delta, delta).alias("values"), F.col("event_type").isin("view", "click").alias("is_read"))


def sl_events(ev: DataFrame) -> DataFrame:
    """(bid, epoch, kind, src, tgt, amount): purchases transfer, all others deposit, errors a deposit of -1."""
    transfer = F.col("event_type") == "purchase"
    amount = F.when(transfer, F.col("cents") % 10).when(F.col("event_type") == "error", -1).otherwise(500 + F.col("cents") % 1000)
    return ev.select("bid", "epoch", F.when(transfer, "transfer").otherwise("deposit").alias("kind"), F.col("user_id").alias("src"), F.when(transfer, F.col("k2")).alias("tgt"), amount.alias("amount"))


def ob_events(ev: DataFrame) -> DataFrame:
    """(bid, kind, items, price, qty): signups alert, errors top up, others buy; each tenth is flagged to abort."""
    kind = F.when(F.col("event_type") == "signup", "alert").when(F.col("event_type") == "error", "topping").otherwise("buy")
    flagged = (F.col("bid") - 1) % 10 == 0
    amount = F.when(flagged, -1)
    return ev.select(
        "bid",
        kind.alias("kind"),
        F.array("user_id", "k2").alias("items"),
        F.when(kind == "alert", F.coalesce(amount, F.col("cents") % 100)).otherwise(F.col("cents") % 100).alias("price"),
        F.when(kind == "alert", 0).otherwise(F.coalesce(amount, (F.col("bid") - 1) % 20)).alias("qty"),
    )


def tp_events(ev: DataFrame, segments: int = 100) -> DataFrame:
    """(bid, seg, speed, vid): speeds of 120 to 450, vehicles 1 to 100."""
    return ev.select("bid", (F.col("user_id") % segments).alias("seg"), (120 + F.col("cents") % 331).alias("speed"), (1 + (F.col("bid") - 1) % 100).alias("vid"))


# Shared tables as they are before the first event

#: What a counter holds at first, and how many characters its text has.
FIRST_COUNT = 100


def micro_table(spark: SparkSession, n_keys: int) -> DataFrame:
    """(key, value): numbers as text of 32 characters."""
    return spark.range(n_keys).select(F.col("id").alias("key"), text.right_pad(F.lit(FIRST_COUNT)).alias("value"))


def segment_speed(spark: SparkSession, n_segments: int) -> DataFrame:
    return spark.range(n_segments).select(F.col("id").cast("string").alias("key"), F.lit(0.0).alias("value"))


def segment_cnt(spark: SparkSession, n_segments: int) -> DataFrame:
    return spark.range(n_segments).select(F.col("id").cast("string").alias("key"), F.array().cast("array<int>").alias("value"))


class Store:
    """Named tables in a folder, each in versions; a version counts once it is whole.

    Writers of a table take turns, as epochs do. A version that a failed writer left
    behind has no `_SUCCESS` and is written over.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _at(self, name: str, version: int) -> str:
        return f"{self.folder}/{name}/v{version:012d}"

    def versions(self, name: str) -> list[int]:
        every = [int(x[1:]) for x in scratch.names(self.spark, f"{self.folder}/{name}") if x.startswith("v")]
        return [v for v in every if "_SUCCESS" in scratch.names(self.spark, self._at(name, v))]

    def create(self, name: str, rows: DataFrame) -> None:
        if self.versions(name):
            raise ValueError(f"there is a table {name}")
        self.commit(name, rows)

    def commit(self, name: str, rows: DataFrame) -> int:
        """Write the next version of a table; rows may read the one before."""
        version = max(self.versions(name), default=-1) + 1
        rows.write.mode("overwrite").parquet(self._at(name, version))
        return version

    def insert(self, name: str, rows: DataFrame, key: str = "key") -> int:
        """Add rows; those whose key the table has replace it."""
        return self.commit(name, self.read(name).join(rows, key, "left_anti").unionByName(rows))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table, as of a version or now."""
        known = [v for v in self.versions(name) if version is None or v <= version]
        if not known:
            raise KeyError(name)
        return self.spark.read.parquet(self._at(name, known[-1]))

    def clean(self, name: str, keep: int = 1) -> None:
        """Remove all but the newest versions."""
        for v in self.versions(name)[:-keep]:
            scratch.remove(self.spark, self._at(name, v))

    def drop(self, name: str) -> None:
        scratch.remove(self.spark, f"{self.folder}/{name}")
