"""Replayable streams: text files, parquet folders and a paced generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text


def text_lines(spark: SparkSession, path: str, files_per_batch: int = 1, word_size: int = 0) -> DataFrame:
    """Lines of the files of a folder, a few files in each epoch. Blank lines are left out.

    word_size pads shorter words to so many characters, for a larger payload.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path).filter(F.trim("value") != "")
    return lines.withColumn("value", text.padded_words(F.col("value"), word_size)) if word_size else lines


def stamped(events: DataFrame) -> DataFrame:
    """events with `arrived`, the time at which their micro-batch took them."""
    return events.withColumn("arrived", F.current_timestamp())


def parquet_events(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).schema(schema).parquet(path)


def paced(spark: SparkSession, per_second: int, partitions: int = 4) -> DataFrame:
    """(bid, arrived): bids from 1 at a steady rate."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).option("numPartitions", partitions).load()
    return ticks.select((F.col("value") + 1).alias("bid"), F.col("timestamp").alias("arrived"))


def counted(spark: SparkSession, per_batch: int) -> DataFrame:
    """(bid, arrived): bids from 1, the same number in each micro-batch; restarts repeat the same rows."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", per_batch).option("numPartitions", 1).load()
    return ticks.select((F.col("value") + 1).alias("bid"), F.col("timestamp").alias("arrived"))


def sensor(line: Column) -> tuple[Column, Column]:
    """Time and value of a blank-separated sensor line; null where they can't be read."""
    parts = F.split(F.trim(line), r"\s+")
    return F.try_to_timestamp(F.concat_ws(" ", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))), F.get(parts, F.lit(2)).try_cast("double")
