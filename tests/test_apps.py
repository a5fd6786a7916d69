"""The applications against a serial interpreter, by hand-made cases and random streams."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rillstone.functions import state
from rillstone.operators import accuracy, apps, metrics, recovery
from rillstone.plans import transactions as txn
from rillstone.sources import generators, text_events
from rillstone.streaming import apps as streams

GS = "bid long, epoch long, keys array<long>, values array<long>, is_read boolean"
SL = "bid long, epoch long, kind string, src long, tgt long, amount long"
OB = "bid long, kind string, items array<long>, price long, qty long"
TP = "bid long, seg long, speed long, vid long"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def jobs_of(spark, name, run):
    """How many Spark jobs run() takes."""
    spark.sparkContext.setJobGroup(name, name)
    run()
    spark.sparkContext._jsc.sc().clearJobGroup()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_grep_sum_by_hand(spark):
    ev = spark.createDataFrame([(1, 0, [1, 2], [5, 7], False), (2, 0, [1, 2], [0, 0], True), (3, 0, [1, 2], [-1, -1], False), (4, 0, [1, 3], [-1, -1], True)], GS)
    assert rows(apps.gs_read_sum(ev), "bid", "read_sum") == [(2, 212), (4, 205)]
    assert rows(apps.gs_write_result(ev), "bid", "result") == [(1, 1.0), (3, 0.0)]
    assert rows(apps.gs_final_state(ev, 4), "key", "value") == [(0, 100), (1, 105), (2, 107), (3, 100)]
    assert rows(apps.gs_read_sum(ev, abort_enabled=False), "bid", "read_sum") == [(2, 212), (4, 204)]


def test_toll_by_hand(spark):
    ev = spark.createDataFrame([(1, 1, 200, 9), (2, 1, 300, 9), (3, 1, 410, 8), (4, 1, 120, 7)], TP)
    assert rows(apps.tp_toll(ev), "bid", "toll") == [(1, 10000.0), (2, 12500.0), (3, -1.0), (4, 9250.0)]
    assert rows(apps.tp_running_count(ev), "bid", "cnt") == [(1, 1), (2, 1), (4, 2)]
    assert rows(apps.tp_segment_speed(ev), "seg", "avg_speed") == [(1, 185.0)]
    assert rows(apps.tp_segment_count(ev), "seg", "cnt") == [(1, 2)]


def test_bidding_by_hand(spark):
    buy = lambda b, p, q: (b, "buy", [0], p, q)
    ev = spark.createDataFrame([buy(1, 60, 20), buy(2, 0, 1), buy(3, 99, 80), (4, "topping", [0], 0, 1), buy(5, 99, 80), (6, "alert", [0], 99, 0), buy(7, 99, 1), buy(8, 50, -1), (9, "alert", [0], -1, 0)], OB)
    assert rows(apps.ob_event_result(ev, 1), "bid", "result") == [(1, 1.0), (2, 0.0), (3, 0.0), (4, 1.0), (5, 1.0), (6, 1.0), (7, 0.0), (8, 0.0), (9, 0.0)]
    assert rows(apps.ob_final_goods(ev, 1), "item", "price", "qty") == [(0, 99, 1)]


@pytest.mark.parametrize("second_epoch,target,seen", [(0, 11004, 10000), (1, 11064, 10600)])
def test_ledger_by_hand(spark, tmp_path, second_epoch, target, seen):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    ev = spark.createDataFrame([(1, 0, "deposit", 1, None, 600), (2, second_epoch, "transfer", 1, 2, 4), (3, 0, "deposit", 0, None, -1), (4, 0, "transfer", 1, 2, 0)], SL)
    moved, _, final = apps.sl_run(ev, 3)
    assert rows(moved, "bid", "v1", "v2") == [(2, seen, seen)]
    assert rows(final, "key", "account", "asset") == [(0, 10000, 10000), (1, 10596, 10596), (2, target, target)]
    assert rows(apps.sl_deposit_result(ev), "bid", "result") == [(1, 1.0), (3, 0.0)]


def test_generated_workloads_against_a_serial_run(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    n, keys = 600, 20
    txns = generators.transactions(spark, n, keys).cache()
    assert txns.filter(F.size(F.array_distinct("keys")) < 2).count() == 0
    gs = generators.gs_workload(txns).withColumn("epoch", F.lit(0))
    value, reads = {}, []
    for e in sorted(gs.collect(), key=lambda r: r["bid"]):
        if e["is_read"]:
            reads.append((e["bid"], sum(value.get(k, 100) for k in e["keys"])))
        elif min(e["values"]) >= 0:
            for k, v in zip(e["keys"], e["values"], strict=True):
                value[k] = value.get(k, 100) + v
    assert rows(apps.gs_read_sum(gs), "bid", "read_sum") == reads

    ob = generators.ob_workload(txns)
    goods, done = {i: [i * 37 % 100, 100] for i in range(keys)}, []
    for e in sorted(ob.collect(), key=lambda r: r["bid"]):
        ok = e["price"] != -1 if e["kind"] == "alert" else e["qty"] >= 0
        if ok:
            for i in e["items"]:
                if e["kind"] == "alert":
                    goods[i][0] = e["price"]
                elif e["kind"] == "topping":
                    goods[i][1] += e["qty"]
                elif e["price"] > goods[i][0] and e["qty"] < goods[i][1]:
                    goods[i][1] -= e["qty"]
                else:
                    ok = False
        done.append((e["bid"], float(ok)))
    assert rows(apps.ob_event_result(ob, keys), "bid", "result") == done
    assert rows(apps.ob_final_goods(ob, keys), "item", "price", "qty") == [(i, *goods[i]) for i in range(keys)]

    sl = generators.sl_workload(txns).withColumn("epoch", F.floor((F.col("bid") - 1) / 100))
    now = {k: [10000, 10000] for k in range(keys)}
    start, epoch = {k: list(v) for k, v in now.items()}, 0
    for e in sorted(sl.collect(), key=lambda r: r["bid"]):
        if e["epoch"] != epoch:
            start, epoch = {k: list(v) for k, v in now.items()}, e["epoch"]
        if e["kind"] == "deposit" and e["amount"] >= 0:
            now[e["src"]] = [x + e["amount"] for x in now[e["src"]]]
        elif e["kind"] == "transfer" and e["amount"] > 0:
            for s in (0, 1):
                now[e["tgt"]][s] += math.trunc(e["amount"] + start[e["src"]][s] * 0.1)
                now[e["src"]][s] -= e["amount"]
    assert rows(apps.sl_run(sl, keys)[2], "key", "account", "asset") == [(k, *now[k]) for k in range(keys)]

    tp = generators.tp_workload(txns)
    speed, cars, tolls = {}, {}, []
    for e in sorted(tp.collect(), key=lambda r: r["bid"]):
        if e["speed"] > 400:
            tolls.append((e["bid"], -1.0))
            continue
        s = e["seg"]
        speed[s] = float(e["speed"]) if not speed.get(s) else (speed[s] + e["speed"]) / 2
        cars.setdefault(s, set()).add(e["vid"])
        c = len(cars[s])
        tolls.append((e["bid"], speed[s] * 50 * ((c - 50) ** 2 if c > 50 else 1)))
    assert rows(apps.tp_toll(tp), "bid", "toll") == tolls


def test_prefix_sum_does_not_depend_on_blocks(spark):
    rng = random.Random(3)
    data = [(rng.choice([0, 0, 0, 1, None]), i, rng.choice([None, 1, -2, 7])) for i in range(300)]
    df = spark.createDataFrame([d for d in data if d[0] is not None], "k long, o long, v long")
    want = rows(state.prefix_sum(df, ["k"], "o", "v", "p", block=10**6), "k", "o", "p")
    for block in (1, 7, 100):
        assert rows(state.prefix_sum(df, ["k"], "o", "v", "p", block=block), "k", "o", "p") == want


def test_word_count_keeps_empty_words_between_blanks(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "a  b "), (3, None), (4, "")], "doc_id long, text string")
    assert rows(apps.word_count(docs), "word", "cnt") == [("", 1), ("a", 3), ("b", 2)]
    assert rows(apps.running_word_count(docs).filter("word = 'a'"), "doc_id", "pos", "cnt") == [(1, 0, 1), (1, 2, 2), (2, 0, 3)]


def test_running_count_of_a_text_of_over_a_million_words(spark):
    n = (1 << 20) + 1
    docs = spark.range(1, 4).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 1, F.concat(F.repeat(F.lit(" "), n), F.lit("a"))).otherwise("a a").alias("text"))
    for block in ({}, {"block": 1}):
        got = apps.running_word_count(docs, **block).filter("word = 'a'")
        assert rows(got, "doc_id", "pos", "cnt") == [(1, n, 1), (2, 0, 2), (2, 1, 3), (3, 0, 4), (3, 1, 5)]
    far = docs.withColumn("doc_id", F.col("doc_id") + (1 << 60))
    assert rows(apps.running_word_count(far).filter("word = 'a'"), "cnt") == [(i,) for i in range(1, 6)]


def test_errors_by_hand(spark):
    a, b = spark.createDataFrame([(1, 2.0), (2, 0.0)], "bid long, v double"), spark.createDataFrame([(1, 3.0), (2, 1.0)], "bid long, v double")
    assert accuracy.relative_error(a, b, ["v"]).first()["error"] == 0.75
    assert accuracy.state_degradation(a, b, "bid", "v").first()["error"] == 0.75
    assert accuracy.state_degradation(a, b, "bid", "v", guard_zero=False).first()["error"] == 0.5


def test_closure_against_search(spark):
    edges = [(0, 3), (3, 5), (7, 8), (5, 9)]
    both = edges + [(b, a) for a, b in edges]
    want = set()
    for i in range(10):
        seen, todo = {i}, [i]
        while todo:
            x = todo.pop()
            for a, b in both:
                if a == x and b not in seen:
                    seen.add(b), todo.append(b)
        want |= {(i, j) for j in seen}
    assert set(rows(recovery.dependency_closure(spark.createDataFrame(both, "src long, dst long"), 10), "lost", "affected")) == want


def test_text_events(spark):
    lines = [
        "7;0;[0, 0];2;DepositEvent;12;40;731;902;1000;false",
        "8;1;[0, 0];2;TransactionEvent;3;9;5;11;4;6;1001;false",
        "9;0;[0, 0];2;BuyingEvent;[3, 17];[55, 80];[2, 19];1002;false",
        "10;0;[0, 0];2;AlertEvent;2;[3, 17];[40, 61];1003;false",
        "11;1;[0, 0];2;ToppingEvent;2;[3, 17];[5, 1];1004;false",
        "12;0;[0, 0];2;MicroEvent;[1, 64];[30, 7];false;1005;false",
        "13;0;[0, 0];2;TollProcessEvent;[21];188;42;1006;false",
    ]
    df = spark.createDataFrame([(x,) for x in [*lines, "", None, "broken", "x;y;z;w;MicroEvent"]], "value string")
    for line, kind in zip(lines, text_events.FIELDS, strict=True):
        back = [r["value"] for r in text_events.serialise(text_events.parse(df, kind), kind).collect()]
        assert line in back
    report = text_events.parse_positions(spark.createDataFrame([("30 501 55 0 4 0 17 90112",), ("",)], "value string")).collect()
    assert [(r["vid"], r["minute"], r["on_exit_lane"], r["pos"]) for r in report] == [(501, 1, True, 90112)]
    assert rows(text_events.result_lines(spark.createDataFrame([(1, 2.0, 3.5)], "bid long, a double, b double"), ["a", "b"]), "value") == [("1;2.0,3.5,",)]


def test_zipf_keys_follow_their_distribution(spark):
    p = {r["rank"]: r["p"] for r in generators.zipf_pmf(spark, 50, 0.9).collect()}
    assert abs(sum(p.values()) - 1) < 1e-9 and p[1] > p[2] > p[50]
    n = 50_000
    got = {r["k"]: r["count"] / n for r in spark.range(n).select(generators.zipf_key(generators.uniform("z", "id"), 50, 0.9).alias("k")).groupBy("k").count().collect()}
    assert set(got) <= set(range(50)) and got[0] == max(got.values())
    assert abs(got[10] - p[11]) < 0.01


@pytest.mark.parametrize("size,skew", [(1, 0.4), (5, 0.9), (64, 0.4), (65, 0.4), (1000, 0.4), (1000, 1.0), (3000, 1.7), (3000, 0.0), (200_000, 0.4)])
def test_zipf_keys_are_the_exact_inverse(spark, size, skew):
    """Every rank begins and ends where the sums of the shares say."""
    weights = [i**-skew for i in range(1, size + 1)]
    total, at, cuts = math.fsum(weights), 0.0, []
    for i in range(0, size, max(1, size // 5000)):
        at = math.fsum(weights[:i]) if size <= 5000 else at
        cuts.append((i, at / total, weights[i] / total))
        if size > 5000:
            at += math.fsum(weights[i : i + max(1, size // 5000)])
    rows_ = spark.createDataFrame(cuts, "rank long, low double, p double")
    for share in (0.001, 0.5, 0.999):
        got = rows_.select("rank", generators.zipf_key(F.col("low") + F.col("p") * share, size, skew).alias("k"))
        assert got.filter("rank <> k").count() == 0
    assert spark.range(1).select(generators.zipf_key(F.lit(1 - 2**-52), size, skew).alias("k")).first()["k"] == size - 1


def fold(values):
    out, now = [], 0.0
    for v in values:
        now = now if v is None else v if now == 0 else (now + v) / 2
        out.append(now)
    return out


@pytest.mark.parametrize("make", [
    lambda r, i: 1e300 if i == 0 else 1e-10,
    lambda r, i: r.choice([0.0, 0.0, 1e-300, 5.0, 1e300, None]),
    lambda r, i: 0.0 if 10 < i < 9000 else float(r.randrange(400)),
    lambda r, i: r.choice([-1.0, 1.0, -1e200, 1e200, 0.25]),
])
def test_halving_averages_look_back_on_everything(spark, make):
    rng = random.Random(4)
    values = [make(rng, i) for i in range(10_000)]
    df = spark.createDataFrame([(k, i, v) for i, v in enumerate(values) for k in ((1,) if i > 300 else (1, None))], "k long, o long, v double").repartition(5)
    for block in (3000, 10**6):
        got = {(r["k"], r["o"]): r["a"] for r in state.running_halving_average(df, "k", "o", "v", "a", block=block).collect()}
        want = {(1, i): x for i, x in enumerate(fold(values))} | {(None, i): x for i, x in enumerate(fold(values[:301]))}
        assert set(got) == set(want)
        for at, x in want.items():
            assert got[at] == pytest.approx(x, rel=1e-12, abs=0.0)
    last = {r["k"]: r["a"] for r in state.final_halving_average(df, "k", "o", "v", "a").collect()}
    assert last[1] == pytest.approx(fold(values)[-1], rel=1e-12, abs=0.0) and set(last) == {1, None}


def test_spikes_and_sessions(spark):
    ev = spark.createDataFrame([(1, i, 100) for i in range(20)] + [(1, 20, 500)], "k long, o long, v long")
    assert rows(metrics.spikes(ev, "k", "o", "v").filter("is_spike"), "o") == [(20,)]
    ts = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:20:00"), (1, "2024-01-01 02:00:00")], "k long, t string").withColumn("t", F.to_timestamp("t"))
    assert rows(metrics.sessions(ts, "k", "t", "30 minutes"), "cnt") == [(1,), (2,)]


def started_again(spark, events, tmp_path, initial, step, **more):
    """The folder of a stream that was stopped and started anew after each quarter of the events."""
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    last = events.agg(F.max("bid")).first()[0]
    for part in range(4):
        events.filter((F.col("bid") > part * last // 4) & (F.col("bid") <= (part + 1) * last // 4)).coalesce(1).write.mode("append").parquet(source)
        streams.run_epochs(spark.readStream.schema(events.schema).parquet(source), initial, step, folder, **more).awaitTermination()
    return folder


def test_bidding_stream(spark, tmp_path):
    ob = generators.ob_workload(generators.transactions(spark, 400, 10))
    folder = started_again(spark, ob, tmp_path, apps.ob_initial(spark, 10), streams.ob_step, keep_inputs=True)
    assert rows(streams.results(spark, folder), "bid", "kind", "result") == rows(apps.ob_event_result(ob, 10), "bid", "kind", "result")
    assert rows(streams.state(spark, folder), "item", "price", "qty") == rows(apps.ob_final_goods(ob, 10), "item", "price", "qty")
    # What a failure took comes back from the inputs; old states are gone.
    again = streams.replay(spark, folder, apps.ob_initial(spark, 10), streams.ob_step)
    assert rows(again, "item", "price", "qty") == rows(apps.ob_final_goods(ob, 10), "item", "price", "qty")
    from rillstone.sources import scratch

    assert scratch.names(spark, f"{folder}/state") == ["batch=2", "batch=3"]


def test_toll_stream(spark, tmp_path):
    tp = generators.tp_workload(generators.transactions(spark, 2400, 6))
    none = spark.createDataFrame([], streams.TP_STATE)
    folder = started_again(spark, tp, tmp_path, none, streams.tp_step)
    want = {r["bid"]: r["toll"] for r in apps.tp_toll(tp).collect()}
    got = {r["bid"]: r["toll"] for r in streams.results(spark, folder).collect()}
    assert set(got) == set(want) and max(want.values()) > 20_000
    for bid, toll in want.items():
        assert got[bid] == pytest.approx(toll, rel=1e-12)
    held = streams.state(spark, folder)
    assert held.filter("vid is not null").count() == sum(r["cnt"] for r in apps.tp_segment_count(tp).collect())


def test_ledger_stream_with_punctuation(spark, tmp_path):
    """Epochs of 50 bids within micro-batches of 100 give what epochs of 50 give in one run."""
    sl = generators.sl_workload(generators.transactions(spark, 400, 10))
    folder = started_again(spark, sl, tmp_path, apps.sl_initial(spark, 10), streams.punctuated(streams.sl_step, 50))
    results, _, final = apps.sl_run(sl.withColumn("epoch", F.floor((F.col("bid") - 1) / 50)), 10)
    assert rows(streams.results(spark, folder), "bid", "v1", "v2") == rows(results, "bid", "v1", "v2")
    assert rows(streams.state(spark, folder), "key", "account", "asset") == rows(final, "key", "account", "asset")


def test_word_count_stream(spark, tmp_path):
    docs = spark.range(1, 41).select(F.col("id").alias("bid"), F.col("id").alias("doc_id"), F.concat(F.lit("a w"), F.col("id") % 7, F.lit(" w"), F.col("id") % 3).alias("text"))
    folder = started_again(spark, docs, tmp_path, spark.createDataFrame([], "word string, cnt long"), streams.word_count_step)
    assert rows(streams.state(spark, folder), "word", "cnt") == rows(apps.word_count(docs), "word", "cnt")


def test_readers_see_committed_batches_only(spark, tmp_path):
    gs = generators.gs_workload(generators.transactions(spark, 400, 10))
    initial = spark.range(10).select(F.col("id").alias("key"), F.lit(100).cast("long").alias("value"))
    folder = started_again(spark, gs, tmp_path, initial, streams.gs_step)
    whole = streams.results(spark, folder).count()
    spark.range(5).select(F.col("id").alias("bid"), F.col("id").alias("read_sum")).write.parquet(f"{folder}/results/batch=4")  # of a batch that failed
    assert streams.committed(spark, folder) == [0, 1, 2, 3] and streams.results(spark, folder).count() == whole


def test_bidding_in_keyed_state(spark, tmp_path):
    """Items in RocksDB, with a restart in between, against the batch run."""
    kept = {c: spark.conf.get(c, None) for c in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled")}
    ob = generators.ob_workload(generators.transactions(spark, 300, 8))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    streams.use_changelogs(spark)
    try:
        for part in range(3):
            ob.filter((F.col("bid") > part * 100) & (F.col("bid") <= part * 100 + 100)).coalesce(1).write.mode("append").parquet(source)
            done = streams.bidding_by_item(spark.readStream.schema(ob.schema).parquet(source))
            done.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    finally:
        for c, v in kept.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    folded = spark.read.parquet(out)
    want = apps.ob_fold(ob, apps.ob_initial(spark, 8)).filter("kind <> 'start'")
    assert rows(folded, "bid", "idx", "key", "price", "qty", "ok") == rows(want, "bid", "idx", "key", "price", "qty", "ok")
    assert rows(apps.ob_results(folded, ob), "bid", "result") == rows(apps.ob_event_result(ob, 8), "bid", "result")


def test_missing_items_and_early_bids(spark):
    """An operation on an item that isn't there is dropped alone; bids may be 0 or less."""
    ev = spark.createDataFrame([(-5, "buy", [0, 7], 60, 20), (0, "alert", [1], 5, 0), (3, "buy", [7], 60, 1)], OB)
    folded = apps.ob_fold(ev, apps.ob_initial(spark, 2))
    assert rows(apps.ob_results(folded, ev), "bid", "result") == [(-5, 1.0), (0, 1.0)]
    assert rows(apps.ob_goods(folded), "item", "price", "qty") == [(0, 0, 80), (1, 5, 100)]
    gs = spark.createDataFrame([(1, 0, [1, 9], [5, 5], False), (2, 0, [1, 9], [0, 0], True)], GS)
    assert rows(apps.gs_read_sum(gs, n_keys=4), "bid", "read_sum") == [(2, 105)]


def test_recoveries_against_undisturbed_runs(spark, tmp_path):
    n, parts = 24, 6
    # Keys of three groups of partitions that never meet, so that some don't depend on the lost one.
    txns = generators.transactions(spark, 600, n).withColumn("keys", F.transform("keys", lambda k: (k % 8 + F.col("bid") % 3 * 8).cast("int"))).filter(F.get("keys", F.lit(0)) != F.get("keys", F.lit(1)))
    gs = generators.gs_workload(txns).withColumn("epoch", F.floor((F.col("bid") - 1) / 100))
    before, since, final = gs.filter("bid <= 300"), gs.filter("bid > 300"), apps.gs_final_state(gs, n)
    assert rows(recovery.dependent_keys(since, 1, n, parts), "pid") == [(0,), (1,)]
    current = final.withColumn("value", F.when(txn.partition_of(F.col("key"), n, parts) != 1, F.col("value")))
    assert rows(recovery.rolled_back(current, apps.gs_final_state(before, n), since, 1, n, parts), "key", "value") == rows(final, "key", "value")
    first = spark.range(n).select(F.col("id").alias("key"), F.lit(100).cast("long").alias("value"))
    log = recovery.changes(txn.key_ops(txn.valid(gs, txn.gs_aborts()).filter("not is_read"), "keys", "values").select("epoch", "key", F.col("values_op").alias("delta")), first, n)
    for epoch in (0, 2, 5):
        want = apps.gs_final_state(gs.filter(F.col("epoch") <= epoch), n)
        assert rows(recovery.redo(first, log, epoch), "key", "value") == rows(want, "key", "value")
    sl = generators.sl_workload(generators.transactions(spark, 600, n)).withColumn("epoch", F.floor((F.col("bid") - 1) / 100))
    _, starts, final = apps.sl_run(sl, n)
    late = sl.filter("epoch >= 2")
    log = recovery.determinants(late, starts, n, parts)
    for lost in (0, 3):
        own = recovery.ledger_with_determinants(late, starts.filter("epoch = 2"), log, lost, n, parts)
        assert rows(own, "key", "account", "asset") == rows(final.filter(txn.partition_of(F.col("key"), n, parts) == lost), "key", "account", "asset")


def test_recovery_by_determinants_takes_as_many_jobs_for_many_epochs(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    n, parts = 24, 6
    sl = generators.sl_workload(generators.transactions(spark, 240, n))
    took = []
    for size, middle in ((60, 2), (4, 30)):
        events = sl.withColumn("epoch", F.floor((F.col("bid") - 1) / size))
        _, starts, final = apps.sl_run(events, n)
        late = events.filter(F.col("epoch") >= middle)
        log = recovery.determinants(late, starts, n, parts).localCheckpoint()
        snapshot = starts.filter(F.col("epoch") == middle).localCheckpoint()
        own = []
        took.append(jobs_of(spark, f"recovery-{size}", lambda own=own, late=late, snapshot=snapshot, log=log: own.extend(rows(recovery.ledger_with_determinants(late, snapshot, log, 3, n, parts), "key", "account", "asset"))))
        assert own == rows(final.filter(txn.partition_of(F.col("key"), n, parts) == 3), "key", "account", "asset")
    assert took[1] <= took[0] + 2


def test_store_of_tables(spark, tmp_path):
    from rillstone.sources import tables

    store = tables.Store(spark, str(tmp_path / "store"))
    first = tables.micro_table(spark, 3)
    store.create("counters", first)
    assert all(len(r["value"]) == 32 for r in store.read("counters").collect())
    with pytest.raises(ValueError):
        store.create("counters", first)
    store.insert("counters", spark.createDataFrame([(1, "7"), (9, "8")], "key long, value string"))
    assert [(k, v.strip()) for k, v in rows(store.read("counters"), "key", "value")] == [(0, "100"), (1, "7"), (2, "100"), (9, "8")]
    assert store.read("counters", version=0).count() == 3 and store.versions("counters") == [0, 1]
    store.clean("counters")
    assert store.versions("counters") == [1]
    store.drop("counters")
    with pytest.raises(KeyError):
        store.read("counters")
    assert rows(tables.segment_speed(spark, 1), "key", "value") == [("0", 0.0)] and tables.segment_cnt(spark, 2).first()["value"] == []


def test_text_values(spark):
    from rillstone.functions import text

    df = spark.createDataFrame([("ab",), ("x" * 40,), (" 12 ",), (None,)], "v string")
    got = [r["p"] for r in df.select(text.right_pad(F.col("v")).alias("p")).collect()]
    assert got == ["ab".ljust(32), "x" * 40, " 12 ".ljust(32), None]
    assert [r["n"] for r in df.select(text.stored_number(F.col("v")).alias("n")).collect()] == [None, None, 12, None]
    assert df.select(text.padded_words(F.lit("a bcd  e"), 3).alias("w")).first()["w"] == "axx bcd  exx"
    assert text.workload_name({"b": 1, "a": 2}) == text.workload_name({"a": 2, "b": 1}) != text.workload_name({"a": 2, "b": 2})
    assert df.select(text.row_hash("v").alias("h")).distinct().count() == 4
    assert spark.range(1).select(text_events.road_is_full(F.lit(39), F.lit(51)).alias("f")).first()["f"] is True


def test_progress_log_and_timed_trigger(spark, tmp_path):
    import time

    log = streams.ProgressLog()
    spark.streams.addListener(log)
    try:
        docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
        docs.write.parquet(str(tmp_path / "in"))
        query = streams.run_epochs(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), spark.createDataFrame([], "word string, cnt long"), streams.word_count_step, str(tmp_path / "out"), {"processingTime": "1 second"})
        query.processAllAvailable()
        query.stop()
        for _ in range(100):
            if log.progress:
                break
            time.sleep(0.1)
        assert log.report()["events"] >= 1
    finally:
        spark.streams.removeListener(log)


def test_streams_match_batches_and_go_on_after_a_stop(spark, tmp_path):
    txns = generators.transactions(spark, 400, 10)
    gs = generators.gs_workload(txns)
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    initial = spark.range(10).select(F.col("id").alias("key"), F.lit(100).cast("long").alias("value"))
    for part in range(4):
        gs.filter((F.col("bid") > part * 100) & (F.col("bid") <= part * 100 + 100)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(gs.schema).parquet(source)
        streams.run_epochs(stream, initial, streams.gs_step, folder).awaitTermination()  # a new query each time: a restart
    batch = gs.withColumn("epoch", F.lit(0))
    assert rows(streams.results(spark, folder), "bid", "read_sum") == rows(apps.gs_read_sum(batch), "bid", "read_sum")
    assert rows(spark.read.parquet(f"{folder}/state/batch=3"), "key", "value") == rows(apps.gs_final_state(batch, 10), "key", "value")


def test_aborts_are_static(spark):
    ev = spark.createDataFrame([(1, 1, 400, 1), (2, 1, 401, 1)], TP)
    assert rows(txn.valid(ev, txn.tp_aborts()), "bid") == [(1,)]
    assert rows(txn.valid(ev, txn.tp_aborts(), False), "bid") == [(1,), (2,)]


def test_ledger_jobs_do_not_grow_with_epochs(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    sl = generators.sl_workload(generators.transactions(spark, 240, 12))
    few, many = (jobs_of(spark, f"ledger-{size}", lambda size=size: [x.collect() for x in apps.sl_run(sl.withColumn("epoch", F.floor((F.col("bid") - 1) / size)), 12)]) for size in (120, 4))
    assert many <= few + 2


def test_ledger_epochs_across_batches_and_missing_keys(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    # Key 7 has no balances: a transfer from it does nothing, one to it still pays; epoch 5 only aborts, 3 and 4 are not there.
    ev = [(1, 2, "deposit", 0, None, 600), (2, 2, "transfer", 7, 1, 5), (3, 2, "transfer", 0, 7, 5), (4, 2, "deposit", 7, None, 9), (5, 5, "deposit", 1, None, -1), (6, 6, "transfer", 0, 1, 1), (7, 6, "transfer", 1, 0, 2), (8, 6, "transfer", 0, None, 3), (9, 6, "deposit", None, None, 4)]
    moved, starts, final = apps.sl_run(spark.createDataFrame(ev, SL), 2)
    assert rows(moved, "bid", "v1", "v2") == [(3, 10000, 10000), (6, 10595, 10595), (7, 10000, 10000), (8, 10595, 10595)]
    assert rows(starts, "epoch", "key", "account", "asset") == [(2, 0, 10000, 10000), (2, 1, 10000, 10000), (5, 0, 10595, 10595), (5, 1, 10000, 10000), (6, 0, 10595, 10595), (6, 1, 10000, 10000)]
    assert rows(final, "key", "account", "asset") == [(0, 11593, 11593), (1, 11058, 11058)]
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
        assert rows(apps.sl_run(spark.createDataFrame(ev, SL), 2)[2], "key", "account", "asset") == [(0, 11593, 11593), (1, 11058, 11058)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert all(not x.collect() for x in apps.sl_run(spark.createDataFrame([], SL), 0))
    with pytest.raises(Exception, match="beyond 64 bits"):
        apps.sl_run(spark.createDataFrame([(1, 0, "deposit", 0, None, (1 << 63) - 10)], SL), 1)


def test_ledger_conserves_money_but_for_bonuses(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    sl = generators.sl_workload(generators.transactions(spark, 300, 12)).withColumn("epoch", F.lit(0))
    final = apps.sl_run(sl, 12)[2].agg(F.sum("account")).first()[0]
    deposits = sl.filter("kind = 'deposit' and amount >= 0").agg(F.sum("amount")).first()[0]
    bonus = sl.filter("kind = 'transfer' and amount > 0").count() * 1000
    assert final == 12 * 10000 + deposits + bonus


def test_text_streams_and_sinks(spark, tmp_path):
    from rillstone.operators import sinks
    from rillstone.sources import streams as sources

    (tmp_path / "in").mkdir()
    for i, words in enumerate(["a b", "", "b c\nb"]):
        (tmp_path / "in" / f"{i}.txt").write_text(words)
    lines = sources.text_lines(spark, str(tmp_path / "in")).withColumnRenamed("value", "text").withColumn("doc_id", F.lit(1).cast("long"))
    empty = spark.createDataFrame([], "word string, cnt long")
    query = streams.run_epochs(lines, empty, streams.word_count_step, str(tmp_path / "out"))
    query.awaitTermination()
    last = max(int(p["batchId"]) for p in query.recentProgress)
    assert rows(spark.read.parquet(f"{tmp_path}/out/state/batch={last}"), "word", "cnt")[0] == ("a", 1)
    report = sinks.run_report(query.recentProgress)
    assert report["events"] >= 3 and report["events_per_second"] > 0
    again = spark.createDataFrame([(1, 1, 5.0), (1, 2, 6.0), (2, 1, None)], "bid long, version int, v double")
    assert rows(sinks.last_results(again).filter("bid = 1"), "bid", "v") == [(1, 6.0)]
    assert rows(sinks.named_values(again.filter("bid = 2")), "value") == [("bid=2, version=1, v=null",)]
    sinks.dump_table(spark.createDataFrame([("10", 1), ("9", 2)], "key string, value long").coalesce(1), str(tmp_path / "dump"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "dump")).collect()] == ["9;2,", "10;1,"]


def test_measures_and_dumps(spark, tmp_path):
    from rillstone.operators import sinks
    from rillstone.sources import streams as sources

    data = [(3, 1, 1.0, 0, 2), (1, 1, 0.0, 0, 1), (1, 2, 5.0, 1, 4), (2, 1, 0.0, 2, 3)]
    df = spark.createDataFrame(data, "bid long, version int, v double, a long, d long").withColumns({"arrived": F.timestamp_seconds("a"), "done": F.timestamp_seconds("d")})
    assert rows(sinks.measured(df, "v"), "finished", "aborted", "mean_seconds") == [(2, 1, 2.0)]
    assert rows(sinks.measured(df.limit(0), "v"), "finished", "aborted", "mean_seconds") == [(0, 0, None)]
    sinks.dump_results(sinks.last_results(df).coalesce(1), ["v"], str(tmp_path / "results"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "results")).collect()]
    assert sorted(lines) == ["1;5.0,", "2;0.0,", "3;1.0,"] and spark.read.text(str(tmp_path / "results")).first()["value"].startswith("1;")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a bcd\n\n")
    stream = sources.stamped(sources.text_lines(spark, str(tmp_path / "in"), word_size=3))
    query = stream.writeStream.format("memory").queryName("padded").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.sql("select value, arrived from padded").collect()
    assert [r["value"] for r in got] == ["axx bcd"] and got[0]["arrived"] is not None


def test_values_before_a_row_may_be_structs(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "b"), (2, 3, None)], "k long, bid long, w string")
    got = state.value_before(df, ["k"], "bid", F.when(F.col("w").isNotNull(), F.struct("w", "bid")), "seen")
    assert {(r["k"], r["bid"]): r["seen"] and tuple(r["seen"]) for r in got.collect()} == {(1, 1): None, (1, 2): ("a", 1), (1, 3): ("a", 1), (2, 3): None}


def test_event_time_windows_close_with_the_watermark(spark, tmp_path):
    from rillstone.sources import streams as sources

    data = [(1, 1, 100, 1, "2024-01-01 10:00:00"), (2, 1, 200, 2, "2024-01-01 11:00:00"), (3, 1, 500, 3, "2024-01-01 11:30:00"), (4, 2, 50, 1, "2024-01-03 00:00:00"), (5, 2, 50, 1, "2024-01-05 00:00:00")]
    df = spark.createDataFrame(data, "bid long, seg long, speed long, vid long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = streams.tolls_by_window(sources.parquet_events(spark, str(tmp_path / "in"), df.schema))
    query = out.writeStream.format("memory").queryName("tolls").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = rows(spark.sql("select seg, reports, mean_speed, vehicles from tolls"), "seg", "reports", "mean_speed", "vehicles")
    assert got[0] == (1, 2, 150.0, 2)


def test_paced_sources_have_bids(spark):
    from rillstone.sources import streams as sources

    assert sources.paced(spark, 10).isStreaming and sources.counted(spark, 10).columns == ["bid", "arrived"]
    df = spark.createDataFrame([("2024-01-01 10:00:00 3.5 x",), ("broken",)], "l string")
    ts, v = sources.sensor(F.col("l"))
    assert [r["v"] for r in df.select(v.alias("v"), ts.alias("t")).collect()] == [3.5, None]


def test_groupings(spark):
    from rillstone.plans import routing

    df = spark.range(100).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    assert routing.shuffle_grouping(df, 5).rdd.getNumPartitions() == 5
    placed = routing.fields_grouping(df, 4, "k").select("k", F.spark_partition_id().alias("p")).distinct()
    assert placed.count() == 7
    ranges = routing.key_grouping(df, "k", 7, 3)
    assert rows(ranges.groupBy("pid").agg(F.min("k").alias("a"), F.max("k").alias("b")), "pid", "a", "b") == [(0, 0, 2), (1, 3, 5), (2, 6, 6)]
    assert rows(routing.partial_key_sum(df, "k", "v"), "k", "total") == rows(df.groupBy("k").agg(F.sum("v").alias("total")), "k", "total")
    assert df.join(routing.all_tasks(df.select("k").distinct()), "k").count() == 100
    assert routing.one_task(df).rdd.getNumPartitions() == 1
    with pytest.raises(ValueError):
        routing.one_task(spark.range(routing.MAX_EVERYWHERE + 1))
