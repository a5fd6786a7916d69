"""Events as `;`-separated text, blank-separated position reports, and results as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = ("bid", "pid", "bid_array", "num_p", "event_type")
#: The fields of each type after the prefix, in order.
FIELDS = {
    "DepositEvent": {"account": "string", "book": "string", "acct_delta": "bigint", "book_delta": "bigint", "ts": "bigint", "is_abort": "boolean"},
    "TransactionEvent": {"src_acct": "string", "src_book": "string", "tgt_acct": "string", "tgt_book": "string", "acct_x": "bigint", "book_x": "bigint", "ts": "bigint", "is_abort": "boolean"},
    "BuyingEvent": {"items": "array<int>", "bid_prices": "array<bigint>", "bid_qtys": "array<bigint>", "ts": "bigint", "is_abort": "boolean"},
    "AlertEvent": {"num_access": "int", "items": "array<int>", "ask_prices": "array<bigint>", "ts": "bigint", "is_abort": "boolean"},
    "ToppingEvent": {"num_access": "int", "items": "array<int>", "top_ups": "array<bigint>", "ts": "bigint", "is_abort": "boolean"},
    "MicroEvent": {"keys": "array<int>", "values": "array<int>", "is_read": "boolean", "ts": "bigint", "is_abort": "boolean"},
    "TollProcessEvent": {"segments": "array<int>", "speed": "int", "vid": "int", "ts": "bigint", "is_abort": "boolean"},
}
#: The exit lane, the least toll, the mean speed below which and the cars above which a road counts as full.
EXIT_LANE, BASE_TOLL, FULL_BELOW_SPEED, FULL_ABOVE_CARS = 4, 20, 40, 50
POSITION = {"time": "bigint", "vid": "int", "speed": "int", "xway": "int", "lane": "smallint", "dir": "smallint", "seg": "smallint", "pos": "int"}


def _typed(part: Column, kind: str) -> Column:
    return F.from_json(part, kind) if kind.startswith("array") else F.trim(part).try_cast(kind)


def parse(lines: DataFrame, event_type: str, value: str = "value") -> DataFrame:
    """Events of one type; lines of other types, blank and null ones are left out, broken fields are null."""
    parts = F.split(F.col(value), ";", -1)
    kinds = {"bid": "bigint", "pid": "int", "bid_array": "array<bigint>", "num_p": "int", "event_type": "string"} | FIELDS[event_type]
    kept = lines.filter(F.trim(F.get(parts, F.lit(4))) == event_type)
    return kept.select(*[_typed(F.get(parts, F.lit(i)), k).alias(c) for i, (c, k) in enumerate(kinds.items())])


def serialise(events: DataFrame, event_type: str) -> DataFrame:
    """Lines (value) that parse() reads back; arrays as [1, 2]."""
    kinds = {"bid": "bigint", "pid": "int", "bid_array": "array<bigint>", "num_p": "int", "event_type": "string"} | FIELDS[event_type]
    shown = [F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]")) if k.startswith("array") else F.col(c).cast("string") for c, k in kinds.items()]
    return events.select(F.concat_ws(";", *shown).alias("value"))


def parse_positions(lines: DataFrame, value: str = "value") -> DataFrame:
    """Position reports with their minute; blank lines are left out."""
    parts = F.split(F.trim(F.col(value)), " +")
    rows = lines.filter(F.trim(F.col(value)) != "").select(*[F.get(parts, F.lit(i)).try_cast(k).alias(c) for i, (c, k) in enumerate(POSITION.items())])
    return rows.withColumn("minute", F.floor(F.col("time") / 60) + 1).withColumn("on_exit_lane", F.col("lane") == EXIT_LANE)


def road_is_full(mean_speed: Column, cars: Column) -> Column:
    """Whether a segment is slow and crowded."""
    return (mean_speed < FULL_BELOW_SPEED) & (cars > FULL_ABOVE_CARS)


def result_lines(results: DataFrame, values: list[str], key: str = "bid") -> DataFrame:
    """Results as `bid;v1,v2,`."""
    return results.select(F.concat(F.col(key).cast("string"), F.lit(";"), *[F.concat(F.col(v).cast("string"), F.lit(",")) for v in values]).alias("value"))
