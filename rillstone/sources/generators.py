"""Reproducible workloads: zipf keys and the event streams of the applications.

All randomness is a hash of the bid and a seed, so rows don't depend on partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: str, *by: str) -> Column:
    """A number in [0, 1) for each row."""
    return F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(1 << 52)) / float(1 << 52)


def zipf_pmf(spark: SparkSession, size: int, skew: float) -> DataFrame:
    """(rank, p) with p in proportion to 1 / rank^skew. The ranks are few enough to be summed at once."""
    weights = spark.range(1, size + 1).select(F.col("id").alias("rank"), F.pow("id", F.lit(-skew)).alias("w"))
    total = weights.agg(F.sum("w")).first()[0]
    return weights.select("rank", (F.col("w") / total).alias("p"))


#: Ranks whose shares are added up one by one; beyond them sums follow a formula.
HEAD = 64


def _tail_sum(k: Column, skew: float, constant: float) -> Column:
    """1 / 1^skew + .. + 1 / k^skew for k of HEAD at least, by the Euler-Maclaurin formula."""
    area = F.log(k) if abs(skew - 1) < 1e-9 else F.pow(k, F.lit(1 - skew)) / (1 - skew)
    return constant + area + F.pow(k, F.lit(-skew)) / 2 - skew * F.pow(k, F.lit(-skew - 1)) / 12 + skew * (skew + 1) * (skew + 2) * F.pow(k, F.lit(-skew - 3)) / 720


def zipf_key(u: Column, size: int, skew: float) -> Column:
    """A key of 0 to size - 1 with chances in proportion to 1 / (key + 1)^skew, for u spread over [0, 1).

    The inverse of the sums of all shares: those of the first HEAD ranks stand in the
    expression, later ones follow from a formula that is right to the double's
    last digits, so the key domain may be of any size.
    """
    head, total = [], 0.0
    for i in range(1, min(size, HEAD) + 1):
        total += i**-skew
        head.append(total)
    if size <= HEAD:
        t = u * total
        return F.least(sum((F.when(t >= x, 1).otherwise(0) for x in head), F.lit(0)), F.lit(size - 1)).cast("int")
    area = lambda x: math.log(x) if abs(skew - 1) < 1e-9 else x ** (1 - skew) / (1 - skew)
    formula = lambda k: area(k) + k**-skew / 2 - skew * k ** (-skew - 1) / 12 + skew * (skew + 1) * (skew + 2) * k ** (-skew - 3) / 720
    constant = total - formula(float(HEAD))
    t = u * (constant + formula(float(size)))
    # The area up to k + 1/2 is about the sum up to k; the ranks around settle the rest.
    x = F.exp(t - constant) if abs(skew - 1) < 1e-9 else F.pow(F.greatest((t - constant) * (1 - skew), F.lit(1e-300)), F.lit(1 / (1 - skew)))
    near = F.least(F.greatest(F.floor(x).cast("double"), F.lit(HEAD + 2.0)), F.lit(float(size))) - 2
    tail = near - 1 + sum((F.when(t >= _tail_sum(near + j, skew, constant), 1).otherwise(0) for j in range(5)), F.lit(0))
    first = sum((F.when(t >= c, 1).otherwise(0) for c in head), F.lit(0))
    return F.least(F.when(t < total, first).otherwise(tail), F.lit(size - 1)).cast("int")


def transactions(spark: SparkSession, events: int, keys: int, accesses: int = 2, skew: float = 0.4, read_ratio: float = 0.75, abort_ratio: float = 0.1, seed: str = "txn") -> DataFrame:
    """(bid, keys, is_read, is_abort): bids from 1, `accesses` distinct keys each.

    Keys after the first step on from it, so they differ as long as there are enough.
    """
    rows = spark.range(1, events + 1).toDF("bid")
    first = zipf_key(uniform(seed + "k", "bid"), keys, skew)
    step = 1 + F.floor(uniform(seed + "s", "bid") * max(1, (keys - 1) // max(1, accesses - 1)))
    return rows.select(
        "bid",
        F.transform(F.sequence(F.lit(0), F.lit(accesses - 1)), lambda i: ((first + i * step) % keys).cast("int")).alias("keys"),
        (uniform(seed + "r", "bid") < read_ratio).alias("is_read"),
        (uniform(seed + "a", "bid") < abort_ratio).alias("is_abort"),
    )


def gs_workload(txns: DataFrame, seed: str = "gs") -> DataFrame:
    """MicroEvents: writes of 0 to 99, -1 if flagged."""
    value = lambda k: F.when(F.col("is_abort"), -1).otherwise(F.floor(F.pmod(F.xxhash64(F.lit(seed), "bid", k), F.lit(100)))).cast("int")
    return txns.select("bid", "keys", F.transform("keys", value).alias("values"), "is_read")


def sl_workload(txns: DataFrame, seed: str = "sl") -> DataFrame:
    """Deposits of 500 to 1499 where is_read, transfers of 0 to 9 else; -1 if flagged."""
    u = uniform(seed, "bid")
    amount = F.when(F.col("is_abort"), -1).when(F.col("is_read"), 500 + F.floor(u * 1000)).otherwise(F.floor(u * 10)).cast("long")
    return txns.select("bid", F.when(F.col("is_read"), "deposit").otherwise("transfer").alias("kind"), F.get("keys", F.lit(0)).cast("long").alias("src"), F.when(~F.col("is_read"), F.get("keys", F.lit(1))).cast("long").alias("tgt"), amount.alias("amount"))


def ob_workload(txns: DataFrame, seed: str = "ob") -> DataFrame:
    """Buys where is_read, else alerts and toppings in turn; flagged ones carry -1."""
    kind = F.when(F.col("is_read"), "buy").when(F.col("bid") % 2 == 0, "alert").otherwise("topping")
    price, qty = F.floor(uniform(seed + "p", "bid") * 100).cast("long"), F.floor(uniform(seed + "q", "bid") * 20).cast("long")
    flag = F.when(F.col("is_abort"), -1)
    return txns.select("bid", kind.alias("kind"), F.transform("keys", lambda k: k.cast("long")).alias("items"), F.when(kind == "alert", F.coalesce(flag, price)).otherwise(price).alias("price"), F.when(kind == "alert", 0).otherwise(F.coalesce(flag, qty)).alias("qty"))


def tp_workload(txns: DataFrame, seed: str = "tp") -> DataFrame:
    """Reports of 120 to 350, flagged ones of 401 to 450, by vehicles 1 to 100."""
    u = uniform(seed, "bid")
    speed = F.when(F.col("is_abort"), 401 + F.floor(u * 50)).otherwise(120 + F.floor(u * 231))
    return txns.select("bid", F.get("keys", F.lit(0)).alias("seg"), speed.cast("int").alias("speed"), (1 + F.floor(uniform(seed + "v", "bid") * 100)).cast("int").alias("vid"))
