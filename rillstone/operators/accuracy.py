"""How far results are from a baseline run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _relative(base, other, guard_zero: bool):
    """|other - base| / base; with the guard, base + 1 where base is 0, else such rows have no error."""
    below = F.when(base == 0, base + 1).otherwise(base) if guard_zero else F.nullif(base, F.lit(0))
    return F.abs(other - base) / F.abs(below)


def state_degradation(base: DataFrame, other: DataFrame, key: str, value: str, guard_zero: bool = True) -> DataFrame:
    """(error, rows): mean relative error of a final table, over the keys of both."""
    pairs = base.select(key, F.col(value).alias("_a")).join(other.select(key, F.col(value).alias("_b")), key)
    return pairs.agg(F.avg(_relative(F.col("_a"), F.col("_b"), guard_zero)).alias("error"), F.count(F.lit(1)).alias("rows"))


def relative_error(base: DataFrame, other: DataFrame, columns: list[str], key: str = "bid") -> DataFrame:
    """(error, rows): per row the relative errors of all columns added up, then the mean."""
    a = base.select(key, *[F.col(c).alias(f"_a_{c}") for c in columns])
    b = other.select(key, *[F.col(c).alias(f"_b_{c}") for c in columns])
    total = sum((_relative(F.col(f"_a_{c}"), F.col(f"_b_{c}"), True) for c in columns), F.lit(0.0))
    return a.join(b, key).agg(F.avg(total).alias("error"), F.count(F.lit(1)).alias("rows"))
