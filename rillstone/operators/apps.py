"""The five applications: word count, multi-key sums, ledger, bidding and tolls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import state
from ..plans import transactions as txn
from ..sources import scratch

#: Fixed initial values of the shared tables.
GS_INITIAL, SL_INITIAL, OB_INITIAL_QTY = 100, 10_000, 100
#: Epochs that are sent to all tasks; more of them are joined by a shuffle.
MAX_BROADCAST = 1_000_000


# Word count


def split_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """Words between single blanks with their position; empty ones between blanks stay, a trailing one goes."""
    parts = F.split(text, " ", -1)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return docs.select("doc_id", F.posexplode(whole).alias("pos", "word"))


def word_count(docs: DataFrame) -> DataFrame:
    return split_words(docs).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def running_word_count(docs: DataFrame, block: int = 1000) -> DataFrame:
    """(doc_id, pos, word, cnt): how often the word has come, in the order of documents and positions.

    Words are gathered once, as their positions in each document; what is added up beyond a
    document is a number for each word and document. A word's documents are cut into blocks of
    `block` consecutive doc_ids, so that a common word spreads over tasks.
    """
    places = split_words(docs).groupBy("word", "doc_id").agg(F.sort_array(F.collect_list("pos")).alias("_at"))
    places = scratch.written(places.withColumn("_n", F.size("_at").cast("long")), "words")
    counted = state.prefix_sum(places, ["word"], "doc_id", "_n", "_before", block=block)
    return counted.select("doc_id", F.posexplode("_at").alias("_nth", "pos"), "word", "_before").select("doc_id", "pos", "word", (F.col("_before") + F.col("_nth") + 1).alias("cnt"))


# Grep and sum


def gs_ops(events: DataFrame, abort_enabled: bool = True, n_keys: int | None = None) -> DataFrame:
    """Reads and writes on single keys, `seen` being the key's value before the operation.

    With n_keys, operations on keys beyond 0 to n_keys - 1 are left out, and only they.
    """
    ops = txn.key_ops(txn.valid(events, txn.gs_aborts(), abort_enabled), "keys", "values")
    if n_keys is not None:
        ops = txn.on_known_keys(ops, n_keys)
    ops = ops.withColumn("delta", F.when(F.col("is_read"), 0).otherwise(F.col("values_op")))
    return state.prefix_sum(ops, ["key"], "bid", "delta", "_sum").withColumn("seen", F.col("_sum") + GS_INITIAL)


def gs_read_sum(events: DataFrame, abort_enabled: bool = True, n_keys: int | None = None) -> DataFrame:
    return gs_ops(events, abort_enabled, n_keys).filter("is_read").groupBy("bid").agg(F.sum("seen").cast("long").alias("read_sum"))


def gs_write_result(events: DataFrame) -> DataFrame:
    return events.filter(~F.col("is_read")).select("bid", F.when(txn.gs_aborts(), 0.0).otherwise(1.0).alias("result"))


def gs_final_state(events: DataFrame, n_keys: int, abort_enabled: bool = True) -> DataFrame:
    """(key, value) of all keys. Sums commute, so a hot key is combined before the shuffle."""
    writes = txn.key_ops(txn.valid(events, txn.gs_aborts(), abort_enabled).filter(~F.col("is_read")), "keys", "values")
    sums = writes.groupBy("key").agg(F.sum("values_op").alias("delta"))
    every = events.sparkSession.range(n_keys).toDF("key")
    return every.join(sums, "key", "left").select("key", (F.coalesce("delta", F.lit(0)) + GS_INITIAL).alias("value"))


# Stream ledger


def sl_deposit_result(events: DataFrame) -> DataFrame:
    return events.filter(F.col("kind") == "deposit").select("bid", F.when(txn.sl_aborts(), 0.0).otherwise(1.0).alias("result"))


def sl_epoch(events: DataFrame, balances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One epoch: (transfer results, next balances).

    A transfer pays a bonus of a tenth of the source's balance at the epoch's start,
    so within an epoch all changes are known at once and only add up.
    """
    ok = txn.valid(events, txn.sl_aborts())
    moves = ok.filter(F.col("kind") == "transfer").join(balances.withColumnRenamed("key", "src"), "src")
    bonus = lambda s: (F.col("amount") + F.col(s) * 0.1).cast("long")
    changes = ok.filter(F.col("kind") == "deposit").select(F.col("src").alias("key"), F.col("amount").alias("da"), F.col("amount").alias("db"))
    both = F.explode(F.array(F.struct(F.col("src").alias("key"), (-F.col("amount")).alias("da"), (-F.col("amount")).alias("db")), F.struct(F.col("tgt").alias("key"), bonus("account").alias("da"), bonus("asset").alias("db"))))
    changes = changes.unionByName(moves.select(both.alias("c")).select("c.*"))
    sums = changes.groupBy("key").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    after = balances.join(sums, "key", "left").select("key", (F.col("account") + F.coalesce("da", F.lit(0))).alias("account"), (F.col("asset") + F.coalesce("db", F.lit(0))).alias("asset"))
    return moves.select("bid", F.col("account").alias("v1"), F.col("account").alias("v2")), after


def sl_initial(spark: SparkSession, n_keys: int) -> DataFrame:
    start = F.lit(SL_INITIAL).cast("long")
    return spark.range(n_keys).select(F.col("id").alias("key"), start.alias("account"), start.alias("asset"))


#: Rows that a fold's task holds before it adds them up or hands them on.
FOLD_ROWS = 1 << 17


def sl_ops(events: DataFrame) -> DataFrame:
    """(epoch, moves, key, tgt, da, db): what committing events do. A transfer moves from key to tgt; all else adds to key alone."""
    ok = txn.valid(events, txn.sl_aborts()).filter(F.col("kind").isin("deposit", "transfer") & F.col("epoch").isNotNull())
    moves, amount = F.col("kind") == "transfer", F.col("amount").cast("long")
    return ok.select(F.col("epoch").cast("long").alias("epoch"), moves.alias("moves"), F.col("src").cast("long").alias("key"), F.when(moves, F.col("tgt")).cast("long").alias("tgt"), amount.alias("da"), amount.alias("db"))


def sl_history(ops: DataFrame, balances: DataFrame) -> DataFrame:
    """(epoch, key, account, asset, new_account, new_asset): the balances that each epoch found and left, of keys that it names.

    Any transfer may tie any two keys, so epochs run one after another: one task walks through the
    sorted operations with all balances in hand, 24 bytes a key, and adds up one epoch at a time.
    Operations on keys without balances are left out, and so is a transfer from one.
    """
    number = F.col("key").cast("long").alias("key")
    start = balances.select(F.lit(None).cast("long").alias("epoch"), F.lit(False).alias("moves"), number, F.lit(None).cast("long").alias("tgt"), F.col("account").cast("long").alias("da"), F.col("asset").cast("long").alias("db"))
    rows = start.unionByName(ops).repartition(1).sortWithinPartitions(F.col("epoch").asc_nulls_first())
    names, limit = ["epoch", "key", "account", "asset", "new_account", "new_asset"], FOLD_ROWS

    # Modules of this package needn't be on the workers, so all of it goes along by value.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = lambda batch, c: batch.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        opening, keys, now = [], None, None

        def placed(batch, c):
            """Places of keys, and which of them have one."""
            x = numbers(batch, c)
            at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
            return at, batch.column(c).is_valid().to_numpy(zero_copy_only=False) & (keys[at] == x)

        def added(changes):
            """One change for each place, summed exactly, and beside it as doubles that show an overflow."""
            places, to = np.unique(np.concatenate([c[0] for c in changes]), return_inverse=True)
            exact, rough = np.zeros((2, len(places)), np.int64), np.zeros((2, len(places)))
            for s in (0, 1):
                np.add.at(exact[s], to, np.concatenate([c[1][s] for c in changes]))
                rough[s] = np.bincount(to, np.concatenate([c[2][s] for c in changes]), len(places))
            return places, exact, rough

        def closed(epoch, changes):
            places, exact, rough = added(changes)
            before = now[:, places]
            after = before + exact
            if (np.abs(after - (before + rough)) > 2.0**62).any():
                raise OverflowError(f"a balance is beyond 64 bits after epoch {epoch}")
            now[:, places] = after
            return np.full(len(places), epoch), keys[places], *before, *after

        def batched(made):
            columns = [np.concatenate(x) for x in zip(*made, strict=True)]
            for i in range(0, len(columns[0]), limit):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + limit], pa.int64()) for c in columns], names=names)

        epoch, changes, held, made, ready = None, [], 0, [], 0
        for batch in batches:
            first = batch.column("epoch").null_count
            if first:
                opening.append([numbers(batch.slice(0, first), c) for c in ("key", "da", "db")])
            batch = batch.slice(first)
            if not batch.num_rows or not opening:
                continue
            if keys is None:
                keys, *now = (np.concatenate(x) for x in zip(*opening, strict=True))
                order = np.argsort(keys, kind="stable")
                keys, now, opening = keys[order], np.stack(now)[:, order], [None]
            moves = batch.column("moves").to_numpy(zero_copy_only=False).astype(bool)
            (key, known), (tgt, there) = placed(batch, "key"), placed(batch, "tgt")
            amounts, epochs = np.stack([numbers(batch, c) for c in ("da", "db")]), numbers(batch, "epoch")
            cuts = np.flatnonzero(np.diff(epochs)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(epochs)], strict=True):
                if epochs[i] != epoch:
                    if changes:
                        made.append(closed(epoch, changes))
                        ready += len(made[-1][0])
                    epoch, changes, held = epochs[i], [], 0
                    if ready >= limit:
                        yield from batched(made)
                        made, ready = [], 0
                own = np.arange(i, j)[known[i:j]]
                if not len(own):
                    continue
                moved = own[moves[own]]
                moved = moved[there[moved]]
                # A bonus of a tenth of what the source had at the epoch's start.
                bonus = np.trunc(amounts[:, moved] + now[:, key[moved]] * 0.1)
                if (np.abs(bonus) >= 2.0**63).any():
                    raise OverflowError(f"a transfer is beyond 64 bits in epoch {epoch}")
                change = np.where(moves[own], -amounts[:, own], amounts[:, own])
                change = np.concatenate([change, bonus.astype(np.int64)], axis=1)
                changes.append((np.concatenate([key[own], tgt[moved]]), change, change.astype(float)))
                held += change.shape[1]
                if held > 8 * limit:
                    changes = [added(changes)]
                    held = len(changes[0][0])
        if changes:
            made.append(closed(epoch, changes))
        if made:
            yield from batched(made)

    return scratch.written(rows.mapInArrow(run, ", ".join(f"{c} long" for c in names)), "ledger")


def sl_after(history: DataFrame, balances: DataFrame) -> DataFrame:
    """(key, account, asset) after the last epoch; balances stand before the first."""
    latest = history.groupBy("key").agg(F.max_by(F.struct("new_account", "new_asset"), "epoch").alias("_l"))
    return balances.join(latest, "key", "left").select("key", F.coalesce("_l.new_account", "account").alias("account"), F.coalesce("_l.new_asset", "asset").alias("asset"))


def sl_starts(history: DataFrame, balances: DataFrame, epochs: list[int]) -> DataFrame:
    """(epoch, key, account, asset) of all keys at the start of each of the epochs, which have those of the history.

    What an epoch left in a key stands until the next one that names the key.
    """
    spark = history.sparkSession
    nth = spark.createDataFrame(list(enumerate(epochs)), "nth long, epoch long")
    nth = F.broadcast(nth) if len(epochs) <= MAX_BROADCAST else nth
    left = history.join(nth, "epoch").select("nth", "key", F.col("new_account").alias("account"), F.col("new_asset").alias("asset"))
    left = balances.select(F.lit(-1).cast("long").alias("nth"), "key", "account", "asset").unionByName(left)
    until = F.lead("nth", 1, len(epochs) - 1).over(Window.partitionBy("key").orderBy("nth"))
    spans = left.withColumn("_until", until).filter("_until > nth")
    return spans.select(F.explode(F.sequence(F.col("nth") + 1, "_until")).alias("nth"), "key", "account", "asset").join(nth, "nth").select("epoch", "key", "account", "asset")


def sl_transfers(events: DataFrame, history: DataFrame) -> DataFrame:
    """(bid, v1, v2): what each committed transfer saw at its source."""
    moves = txn.valid(events, txn.sl_aborts()).filter(F.col("kind") == "transfer").select("bid", "epoch", F.col("src").alias("key"))
    seen = history.select("epoch", "key", F.col("account").alias("v1"))
    return moves.join(seen, ["epoch", "key"]).select("bid", "v1", F.col("v1").alias("v2"))


def sl_run(events: DataFrame, n_keys: int, balances: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(transfer results, balances at the start of each epoch, final balances).

    balances, of which n_keys is the number of keys if there are none, stand before the first epoch.
    """
    start = sl_initial(events.sparkSession, n_keys) if balances is None else balances.select("key", "account", "asset")
    history = sl_history(sl_ops(events), start)
    epochs = sorted(e for (e,) in events.select("epoch").distinct().collect() if e is not None)
    return sl_transfers(events, history), sl_starts(history, start, epochs), sl_after(history, start)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


# Online bidding


def ob_initial(spark: SparkSession, n_keys: int) -> DataFrame:
    return spark.range(n_keys).select(F.col("id").alias("item"), (F.col("id") * 37 % 100).alias("price"), F.lit(OB_INITIAL_QTY).cast("long").alias("qty"))


def ob_fold(events: DataFrame, goods: DataFrame) -> DataFrame:
    """Every operation with the price and quantity it leaves and whether it succeeded.

    goods: (item, price, qty) before the first event. A buy depends on what all earlier ones left, which
    no window says, so each key is folded row by row. A row of kind `start`, with a null bid,
    opens each key; operations on items that aren't among the goods are left out.
    """
    ops = txn.key_ops(txn.valid(events, txn.ob_aborts()), "items").select("key", "bid", "idx", "kind", F.col("price").alias("p"), F.col("qty").alias("q"))
    start = goods.select(F.col("item").alias("key"), F.lit(None).cast("long").alias("bid"), F.lit(0).alias("idx"), F.lit("start").alias("kind"), F.col("price").alias("p"), F.col("qty").alias("q"))

    def step(now, kind, p, q):
        if kind == "start":
            return (p, q), (p, q, True)
        if now is None:
            return None, (None, None, None)
        price, left = now
        ok = kind != "buy" or (p > price and q < left)
        if kind == "alert":
            price = p
        elif kind == "topping":
            left += q
        elif ok:
            left -= q
        return (price, left), (price, left, ok)

    folded = state.serial_fold(start.unionByName(ops), ["key"], [F.col("bid"), F.col("idx")], ["kind", "p", "q"], "price long, qty long, ok boolean", step)
    return folded.filter(F.col("ok").isNotNull()).drop("p", "q")


def ob_results(folded: DataFrame, events: DataFrame) -> DataFrame:
    """(bid, kind, result): 1 if the event did all it asked for, 0 if not or aborted. Partial buys stay."""
    done = folded.filter("kind <> 'start'").groupBy("bid", "kind").agg(F.min("ok").alias("ok"))
    failed = events.filter(txn.ob_aborts()).select("bid", "kind", F.lit(0.0).alias("result"))
    return done.select("bid", "kind", F.col("ok").cast("double").alias("result")).unionByName(failed)


def ob_goods(folded: DataFrame) -> DataFrame:
    """(item, price, qty) after the last operation."""
    final = folded.groupBy("key").agg(F.max(F.struct("bid", "idx", "price", "qty")).alias("l"))
    return final.select(F.col("key").alias("item"), "l.price", "l.qty")


def ob_event_result(events: DataFrame, n_keys: int) -> DataFrame:
    return ob_results(ob_fold(events, ob_initial(events.sparkSession, n_keys)), events)


def ob_final_goods(events: DataFrame, n_keys: int) -> DataFrame:
    return ob_goods(ob_fold(events, ob_initial(events.sparkSession, n_keys)))


# Toll processing


def tp_state(events: DataFrame, abort_enabled: bool = True) -> DataFrame:
    """Valid reports with the segment's average speed and distinct vehicles after each."""
    ok = txn.valid(events, txn.tp_aborts(), abort_enabled)
    return state.running_distinct(state.running_halving_average(ok, "seg", "bid", "speed", "avg_speed"), "seg", "vid", "bid", "cnt")


def toll_formula(speed=None, cnt=None):
    """50 for each unit of speed, times the square of the vehicles beyond 50."""
    flat = (F.col("avg_speed") if speed is None else speed) * 50
    over = (F.col("cnt") if cnt is None else cnt) - 50
    return F.when(over <= 0, flat).otherwise(flat * over * over)


def _toll(events: DataFrame, formula) -> DataFrame:
    failed = events.filter(txn.tp_aborts()).select("bid", F.lit(-1.0).alias("toll"))
    return tp_state(events).select("bid", formula.alias("toll")).unionByName(failed)


def tp_toll(events: DataFrame) -> DataFrame:
    """(bid, toll) of all reports; -1 on abort."""
    return _toll(events, toll_formula())


def tp_conventional_toll(events: DataFrame) -> DataFrame:
    return _toll(events, F.col("avg_speed") / F.col("cnt"))


#: Fixed value: the average speed beyond which the second dialect aborts.
MAX_AVERAGE = 350


def tp_late_abort_toll(events: DataFrame) -> DataFrame:
    """(bid, toll) in the dialect that applies each report first and gives -1 where the average is over MAX_AVERAGE then."""
    toll = F.when(F.col("avg_speed") > MAX_AVERAGE, -1.0).otherwise(toll_formula())
    return tp_state(events, abort_enabled=False).select("bid", toll.alias("toll"))


def tp_segment_speed(events: DataFrame) -> DataFrame:
    return state.final_halving_average(txn.valid(events, txn.tp_aborts()), "seg", "bid", "speed", "avg_speed")


def tp_segment_count(events: DataFrame) -> DataFrame:
    return txn.valid(events, txn.tp_aborts()).groupBy("seg").agg(F.count_distinct("vid").alias("cnt"))


def tp_running_count(events: DataFrame) -> DataFrame:
    return state.running_distinct(txn.valid(events, txn.tp_aborts()), "seg", "vid", "bid", "cnt").select("bid", "seg", "cnt")
