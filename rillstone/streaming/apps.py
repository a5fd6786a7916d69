"""The applications on streams: each micro-batch is an epoch, state lives in keyed tables.

A batch reads the tables that the last one left, folds its own operations in, and writes
results and tables under the batch's number. A batch that runs again after a failure
overwrites its own files with the same rows, and readers see a batch once it has
committed, so outputs are exactly once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions import state as fold
from ..operators import apps, sinks
from ..plans import transactions as txn
from ..sources import scratch

Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def run_epochs(source: DataFrame, initial: DataFrame, step: Step, folder: str, trigger: dict | None = None, keep_inputs: bool = False, keep_states: int = 2) -> StreamingQuery:
    """Start a query that applies step(batch, state) -> (results, state) to each micro-batch.

    folder gets results/batch=N, state/batch=N and the checkpoint. Restarting with the same folder
    goes on after the last finished batch. Batch N works on the state of batch N - 1; older states
    than the last keep_states are removed. keep_inputs also writes inputs/batch=N, which replay() runs
    again. trigger: as of DataStreamWriter.trigger(); all there is, if not given.
    """
    spark = source.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        before = spark.read.schema(initial.schema).parquet(f"{folder}/state/batch={number - 1}") if number else initial
        batch = batch.persist()  # results and state both read it
        try:
            if keep_inputs:
                batch.write.mode("overwrite").parquet(f"{folder}/inputs/batch={number}")
            results, after = step(batch, before)
            results.write.mode("overwrite").parquet(f"{folder}/results/batch={number}")
            after.write.mode("overwrite").parquet(f"{folder}/state/batch={number}")
        finally:
            batch.unpersist()
        if number >= keep_states:
            scratch.remove(spark, f"{folder}/state/batch={number - keep_states}")

    return source.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def committed(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that have committed."""
    return sorted(int(x) for x in scratch.names(spark, f"{folder}/checkpoint/commits") if x.isdigit())


def results(spark: SparkSession, folder: str) -> DataFrame:
    """All results of committed batches. Before the first there is nothing to read, which is an error."""
    return spark.read.parquet(*[f"{folder}/results/batch={n}" for n in committed(spark, folder)])


def state(spark: SparkSession, folder: str) -> DataFrame:
    """The tables that the last committed batch left."""
    return spark.read.parquet(f"{folder}/state/batch={committed(spark, folder)[-1]}")


def replay(spark: SparkSession, folder: str, snapshot: DataFrame, step: Step, after: int = -1) -> DataFrame:
    """The tables that the kept inputs of the committed batches beyond `after` make of a snapshot.

    What a stream does after a failure that took its tables: the same answer as without it.
    """
    now = snapshot
    for n in committed(spark, folder):
        if n > after:
            now = scratch.written(step(spark.read.parquet(f"{folder}/inputs/batch={n}"), now)[1], "replay")
    return now


def punctuated(step: Step, size: int) -> Step:
    """A step whose epochs end at each bid divisible by size, also within a micro-batch.

    Micro-batches should hold whole epochs; one that a micro-batch cuts counts as two.
    """

    def each(batch: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
        epoch = F.floor((F.col("bid") - 1) / size)
        done, now = [], before
        for (n,) in sorted(batch.select(epoch).distinct().collect()):  # a number for each epoch
            own, now = step(batch.filter(epoch == n), now)
            done, now = [*done, scratch.written(own, "results")], scratch.written(now, "state")
        return (apps._union(done), now) if done else step(batch, before)

    return each


def gs_step(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Multi-key sums: reads see the table and the batch's earlier writes. State: (key, value)."""
    ops = apps.gs_ops(batch).withColumn("change", F.col("seen") - apps.GS_INITIAL)
    reads = ops.filter("is_read").join(state, "key").groupBy("bid").agg(F.sum(F.col("change") + F.col("value")).alias("read_sum"))
    sums = ops.groupBy("key").agg(F.sum("delta").alias("delta"))
    return reads, state.join(sums, "key", "left").select("key", (F.col("value") + F.coalesce("delta", F.lit(0))).alias("value"))


def sl_step(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ledger: a micro-batch is the epoch whose start balances transfers look at. State: (key, account, asset)."""
    return apps.sl_epoch(batch, state)


def ob_step(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bidding: results as of ob_event_result. State: (item, price, qty)."""
    folded = scratch.written(apps.ob_fold(batch, state), "folded")
    return apps.ob_results(folded, batch), apps.ob_goods(folded)


#: State of toll processing: a row (seg, null, speed) for each segment, and (seg, vid, null) for each of its vehicles.
TP_STATE = "seg long, vid long, speed double"


def tp_step(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tolls, from the segment's halving average and its distinct vehicles, both exact. State: TP_STATE."""
    ok = txn.valid(batch, txn.tp_aborts()).select("bid", F.col("seg").cast("long").alias("seg"), F.col("vid").cast("long").alias("vid"), F.col("speed").cast("double").alias("speed"))
    # What a segment has so far comes before its reports: its average as a first value, its vehicles as a number.
    start = F.lit(-(1 << 62)).cast("long")
    carried = state.filter("vid is null").select(start.alias("bid"), "seg", "vid", "speed")
    speeds = scratch.written(fold.running_halving_average(ok.unionByName(carried.filter("speed <> 0")), "seg", "bid", "speed", "avg_speed"), "speeds")
    known = state.filter("vid is not null").select("seg", "vid")
    before = known.groupBy("seg").agg(F.count(F.lit(1)).alias("_before"))
    fresh = ok.join(known, ["seg", "vid"], "left_anti")
    firsts = fresh.groupBy("seg", "vid").agg(F.min("bid").alias("bid"))
    marked = speeds.filter(F.col("bid") > start).join(firsts.select("bid", F.lit(1).cast("long").alias("_new")), "bid", "left").join(before, "seg", "left")
    counted = fold.prefix_sum(marked, ["seg"], "bid", "_new", "_seen").withColumn("cnt", F.coalesce("_before", F.lit(0)) + F.col("_seen") + F.coalesce("_new", F.lit(0)))
    failed = batch.filter(txn.tp_aborts()).select("bid", F.lit(-1.0).alias("toll"))
    last = speeds.groupBy("seg").agg(F.max_by("avg_speed", "bid").alias("speed"))
    rest = state.filter("vid is null").join(last, "seg", "left_anti").select("seg", "vid", "speed")
    after = rest.unionByName(last.select("seg", F.lit(None).cast("long").alias("vid"), "speed"))
    vehicles = known.unionByName(firsts.select("seg", "vid")).select("seg", "vid", F.lit(None).cast("double").alias("speed"))
    return counted.select("bid", apps.toll_formula().alias("toll")).unionByName(failed), after.unionByName(vehicles)


def word_count_step(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of the words that the batch brought, and of all. State: (word, cnt)."""
    counts = apps.word_count(batch)
    after = state.unionByName(counts).groupBy("word").agg(F.sum("cnt").alias("cnt"))
    return after.join(counts.select("word"), "word", "left_semi"), after


def use_changelogs(spark: SparkSession) -> None:
    """Keyed state of streams started from now on lives in RocksDB; each batch adds its changes to a log over snapshots."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def bidding_by_item(events: DataFrame) -> DataFrame:
    """(key, bid, idx, kind, price, qty, ok) of a stream of bidding events, each item's price and quantity in keyed state.

    An item without a state starts as ob_initial() has it. A micro-batch's operations on an
    item are put in order of bids; bids have to grow from batch to batch, as offsets of a source do.
    """
    ops = txn.key_ops(txn.valid(events, txn.ob_aborts()), "items").select("key", "bid", "idx", "kind", "price", "qty")
    first_qty = apps.OB_INITIAL_QTY

    def walk(key: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["bid", "idx"])
        price, left = held.get if held.exists else (key[0] * 37 % 100, first_qty)
        made = []
        for kind, p, q in zip(rows["kind"], rows["price"], rows["qty"], strict=True):
            ok = kind != "buy" or (p > price and q < left)
            if kind == "alert":
                price = p
            elif kind == "topping":
                left += q
            elif ok:
                left -= q
            made.append((int(price), int(left), bool(ok)))
        held.update((int(price), int(left)))
        prices, lefts, oks = zip(*made, strict=True)
        yield rows.assign(key=key[0], price=prices, qty=lefts, ok=oks)[["key", "bid", "idx", "kind", "price", "qty", "ok"]]

    return ops.groupBy("key").applyInPandasWithState(walk, "key long, bid long, idx int, kind string, price long, qty long, ok boolean", "price long, qty long", "append", "NoTimeout")


class ProgressLog(StreamingQueryListener):
    """Keeps the progress reports of a session's streams; spark.streams.addListener() starts it."""

    def __init__(self) -> None:
        self.progress: list = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.progress.append({"numInputRows": event.progress.numInputRows, "durationMs": dict(event.progress.durationMs)})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def report(self) -> dict[str, float]:
        return sinks.run_report(self.progress)


def tolls_by_window(reports: DataFrame, ts: str = "ts", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Extension: reports, mean speed and vehicles (an estimate) of each segment and event-time window, closed by a watermark."""
    ok = txn.valid(reports, txn.tp_aborts()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = ok.groupBy(F.window(ts, width).alias("w"), "seg").agg(F.count(F.lit(1)).alias("reports"), F.avg("speed").alias("mean_speed"), F.approx_count_distinct("vid").alias("vehicles"))
    return out.select(F.col("w.start").alias("started"), "seg", "reports", "mean_speed", "vehicles")
