"""Counts, rates, percentiles and windows over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Reported percentiles, rows of a moving average, what counts as a spike.
PERCENTILES = (0.5, 20, 40, 60, 80, 99)
SPIKE_ROWS, SPIKE_SHARE = 1000, 0.3


def throughput(events: DataFrame, ts: str = "ts", unit: str = "day") -> DataFrame:
    return events.groupBy(F.date_trunc(unit, F.col(ts)).alias("slot")).agg(F.count(F.lit(1)).alias("cnt"))


def percentiles(df: DataFrame, value: str) -> DataFrame:
    """(pct, value): exact interpolated percentiles, from sorted counts of distinct values."""
    found = df.agg(F.percentile(value, F.array(*[F.lit(p / 100) for p in PERCENTILES])).alias("v"))
    return found.select(F.explode(F.arrays_zip(F.array(*[F.lit(float(p)) for p in PERCENTILES]).alias("pct"), F.col("v").alias("value"))).alias("x")).select("x.*")


def spikes(df: DataFrame, key: str, order: str, value: str, rows: int = SPIKE_ROWS, share: float = SPIKE_SHARE) -> DataFrame:
    """df with the moving average of the last rows of its key and whether value is off it by over a share."""
    recent = Window.partitionBy(key).orderBy(order).rowsBetween(1 - rows, 0)
    out = df.withColumn("moving_avg", F.avg(value).over(recent))
    return out.withColumn("is_spike", F.abs(F.col(value) - F.col("moving_avg")) > share * F.col("moving_avg"))


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """(key, started, cnt): runs of events of a key less than a gap apart."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("cnt")).select(key, F.col("w.start").alias("started"), "cnt")


def tumbling(events: DataFrame, ts: str, width: str, *by: str) -> DataFrame:
    return events.groupBy(F.window(ts, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("cnt")).select(F.col("w.start").alias("started"), *by, "cnt")


def sliding(events: DataFrame, ts: str, width: str, slide: str, *by: str) -> DataFrame:
    """(started, by, cnt): an event counts in each window that it falls into."""
    return events.groupBy(F.window(ts, width, slide).alias("w"), *by).agg(F.count(F.lit(1)).alias("cnt")).select(F.col("w.start").alias("started"), *by, "cnt")
