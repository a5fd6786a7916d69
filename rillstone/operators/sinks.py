"""Results and tables as text, and the figures of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.text_events import result_lines


def last_results(results: DataFrame, key: str = "bid", version: str = "version") -> DataFrame:
    """A row for each bid, of the greatest version: what a replay wrote again counts once."""
    rest = [c for c in results.columns if c != key]
    last = results.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("r"))
    return last.select(key, *[F.col("r").getField(c).alias(c) for c in rest])


def measured(results: DataFrame, value: str, failed: float = 0.0, key: str = "bid", version: str = "version", arrived: str = "arrived", done: str = "done") -> DataFrame:
    """(finished, aborted, mean_seconds): one row on the last result of each bid.

    A result of `failed` counts as aborted; seconds are from arrival to the result. Of no rows
    the counts are 0 and the mean is null.
    """
    last = last_results(results, key, version)
    seconds = F.unix_micros(F.col(done).cast("timestamp")) - F.unix_micros(F.col(arrived).cast("timestamp"))
    return last.agg(F.count_if(F.col(value) != failed).alias("finished"), F.count_if(F.col(value) == failed).alias("aborted"), (F.avg(seconds) / 1e6).alias("mean_seconds"))


def named_values(df: DataFrame) -> DataFrame:
    """Rows as `f=v, f=v`; null values print as null."""
    return df.select(F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in df.columns]).alias("value"))


def dump_results(results: DataFrame, values: list[str], path: str, key: str = "bid") -> None:
    """Result lines in the order of bids, over as many files as the sort has partitions."""
    result_lines(results.orderBy(key), values, key).write.mode("overwrite").text(path)


def dump_table(table: DataFrame, path: str, key: str = "key") -> None:
    """A state table as `key;v1,v2,` lines in the order of whole-number keys."""
    values = [c for c in table.columns if c != key]
    result_lines(table.orderBy(F.col(key).cast("long")), values, key).write.mode("overwrite").text(path)


def run_report(progress: list) -> dict[str, float]:
    """Events, seconds and events a second of a streaming query's progress reports."""
    rows = sum(p["numInputRows"] for p in progress)
    seconds = sum(p["durationMs"].get("triggerExecution", 0) for p in progress) / 1000
    return {"events": rows, "seconds": seconds, "events_per_second": rows / seconds if seconds else 0.0}
