"""Keyed state as expressions and windows: prefix sums, halving averages, distinct counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ops of a key that are summed in one window; longer histories are cut into blocks of orders.
BLOCK = 100_000
#: Rows of a key that one task folds into a halving average, and rows before them that it starts from.
HALVING_BLOCK, LOOKBACK = 50_000, 2_200


def _beside(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """rows with what was found for their keys, null keys included."""
    own = {k: f"_own{i}" for i, k in enumerate(keys)}
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(c)) for k, c in own.items()])
    return rows.join(found.withColumnsRenamed(own), same).drop(*own.values())


def prefix_sum(df: DataFrame, keys: list[str], order: str | list[str], value: str, out: str, block: int = BLOCK) -> DataFrame:
    """df with the sum of value over earlier rows of its key, exclusive.

    Of several order columns the later ones decide between rows equal in those before.
    A key's rows are cut into blocks of `block` consecutive values of the first. Sums of blocks are
    combined before they are shuffled and added up per key, then each block is summed on
    its own, so that a key with a large share of all rows still spreads over tasks.
    Null values count as 0. Rows of one key and order see each other in no set sequence;
    callers make order unique within a key.
    """
    order = [order] if isinstance(order, str) else order
    rows = df.withColumn("_block", F.col(order[0]) - F.pmod(F.col(order[0]), F.lit(block)))
    sums = rows.groupBy(*keys, "_block").agg(F.sum(F.coalesce(value, F.lit(0))).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_earlier", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = _beside(rows, sums, [*keys, "_block"])
    return rows.withColumn(out, F.col("_earlier") + F.coalesce(F.sum(F.coalesce(value, F.lit(0))).over(inside), F.lit(0))).drop("_block", "_earlier")


def serial_fold(df: DataFrame, keys: list[str], order: list[Column], reads: list[str], made: str, step: Callable) -> DataFrame:
    """df with the columns `made` that a fold over each key's rows, in order, makes of them.

    step(state, *values of reads) gives the next state and a tuple of what it made; the state is
    None before a key's first row. Keys are sorted within partitions and walked through
    batch by batch with one key's state in hand: a long key takes time but no memory. For
    folds that no window function says.
    """
    fields = T.StructType.fromDDL(made).fields
    ks, vs = [f"_k{i}" for i in range(len(keys))], [f"_v{i}" for i in range(len(reads))]
    by = [f"_o{i}" for i in range(len(order))]
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    rows = df.select(row, *[F.col(c).alias(k) for c, k in zip(keys, ks, strict=True)], *[F.col(c).alias(v) for c, v in zip(reads, vs, strict=True)], *[o.alias(c) for o, c in zip(order, by, strict=True)])
    rows = rows.repartition(*ks).sortWithinPartitions(*ks, *[F.col(c).asc_nulls_first() for c in by]).drop(*by)
    n = len(ks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds, at, now = [to_arrow_type(f.dataType) for f in fields], None, None
        for batch in batches:
            columns, out = [c.to_pylist() for c in batch.columns[1:]], []
            for own, values in zip(zip(*columns[:n], strict=True), zip(*columns[n:], strict=True), strict=True):
                if own != at:
                    at, now = own, None
                now, new = step(now, *values)
                out.append(new)
            arrays = [pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["_row", *[f.name for f in fields]])

    folded = rows.mapInArrow(run, T.StructType([rows.schema["_row"], *fields]))
    return folded.select(*[F.col("_row").getField(c).alias(c) for c in df.columns], *[f.name for f in fields])


def running_halving_average(df: DataFrame, key: str, order: str, value: str, out: str, block: int = HALVING_BLOCK) -> DataFrame:
    """df with the halving average of its key up to and with the row: 0 is no value yet, then (old + new) / 2.

    A key of more than `block` rows is cut into blocks of that many, which fold apart, each from
    LOOKBACK rows before it: a value older than that weighs less than 2^-2200 of itself, beyond
    all doubles, so blocks give what one fold over all rows gives, to the last bit or the
    one before. That needs values of at least 0, which can't cancel each other; where
    any value is below 0 or not a number, each key folds in one piece.
    """
    block = max(block, LOOKBACK)
    # Modules of this package needn't be on the workers, so the step goes along by value.
    step = lambda now, v: (lambda acc: (acc, (acc,)))((now or 0.0) if v is None else v if not now else (now + v) / 2)
    v = F.col(value).cast("double")
    n, odd = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max((v < 0) | F.isnan(v) | (v == float("inf"))).alias("odd")).agg(F.max("n"), F.max("odd")).first()
    rows = df.withColumn("_value", v)
    if (n or 0) <= block or odd:
        return serial_fold(rows, [key], [F.col(order)], ["_value"], f"{out} double", step).drop("_value")
    rows = prefix_sum(rows.withColumn("_one", F.lit(1)), [key], order, "_one", "_nth").drop("_one")
    part = F.floor(F.col("_nth") / block)
    last = (F.pmod(F.col("_nth"), F.lit(block)) >= block - LOOKBACK)
    rows = rows.withColumn("_own", part).withColumn("_block", F.explode(F.when(last, F.array(part, part + 1)).otherwise(F.array(part)))).drop("_nth")
    folded = serial_fold(rows, [key, "_block"], [F.col(order)], ["_value"], f"{out} double", step)
    return folded.filter("_block = _own").drop("_value", "_own", "_block")


def final_halving_average(df: DataFrame, key: str, order: str, value: str, out: str, salts: int = 64) -> DataFrame:
    """(key, out): the halving average of each key after its last row.

    Of values of at least 0 the last LOOKBACK rows decide. They are picked in two steps, so
    that a key's rows spread over tasks first; with other values all rows are folded.
    """
    v = F.col(value).cast("double")
    rows = df.select(F.col(key).alias("_key"), F.col(order).alias("_order"), v.alias("_value")).filter(v.isNotNull())
    if not rows.filter((F.col("_value") < 0) | F.isnan("_value") | (F.col("_value") == float("inf"))).take(1):
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_order"), F.lit(salts)))
        for by in (["_key", "_salt"], ["_key"]):
            newest = Window.partitionBy(*by).orderBy(F.col("_order").desc())
            salted = salted.withColumn("_turn", F.row_number().over(newest)).filter(F.col("_turn") <= LOOKBACK)
        kept = salted.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_order", "_value"))).alias("_last"))
        folded = F.aggregate("_last", F.lit(0.0), lambda acc, x: F.when(acc == 0, x["_value"]).otherwise((acc + x["_value"]) / 2))
        return kept.select(F.col("_key").alias(key), folded.alias(out))
    run = running_halving_average(rows, "_key", "_order", "_value", "_out")
    return run.groupBy("_key").agg(F.max_by("_out", "_order").alias(out)).withColumnRenamed("_key", key)


def running_distinct(df: DataFrame, key: str, member: str, order: str, out: str, block: int = BLOCK) -> DataFrame:
    """df with the count of distinct members of its key up to and with the row.

    A member counts in its first row; the running sum of first rows is the count.
    """
    firsts = df.groupBy(key, member).agg(F.min(order).alias("_first"))
    rows = _beside(df, firsts, [key, member]).withColumn("_new", (F.col(order) == F.col("_first")).cast("long")).drop("_first")
    return prefix_sum(rows, [key], order, "_new", "_seen", block).withColumn(out, F.col("_seen") + F.col("_new")).drop("_new", "_seen")


def value_before(df: DataFrame, keys: list[str], order: str, written: Column, out: str) -> DataFrame:
    """df with the last value written to its key by an earlier row; null before the first write.

    written is null in rows that write nothing.
    """
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.last(written, ignorenulls=True).over(earlier))
