"""Registered queries of the applications, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import state, text
from .operators import accuracy, apps, metrics, recovery
from .plans import routing
from .plans import transactions as txn
from .sources import generators, scratch, tables, text_events

Query = Callable[[SparkSession, str], DataFrame]

PARTITIONS = 16
SEGMENTS = 100


def _streams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    return tables.app_events(spark, sf_dir), tables.key_count(spark, sf_dir)


def _gs(spark, sf_dir):
    return tables.gs_events(tables.app_events(spark, sf_dir))


def _ob(spark, sf_dir):
    return tables.ob_events(tables.app_events(spark, sf_dir)), tables.key_count(spark, sf_dir)


def _sl(spark, sf_dir):
    ev, n = _streams(spark, sf_dir)
    return tables.sl_events(ev), n


def _tp(spark, sf_dir):
    return tables.tp_events(tables.app_events(spark, sf_dir), SEGMENTS)


def wc_count(spark, sf_dir):
    return apps.word_count(tables.table(spark, sf_dir, "documents"))


def wc_running(spark, sf_dir):
    return apps.running_word_count(tables.table(spark, sf_dir, "documents"))


def gs_final_state(spark, sf_dir):
    ev, n = _streams(spark, sf_dir)
    return apps.gs_final_state(tables.gs_events(ev), n)


def state_degradation_gs(spark, sf_dir):
    """Tables of a run that takes flagged writes as data, against one that aborts them."""
    ev, n = _streams(spark, sf_dir)
    gs = tables.gs_events(ev)
    return accuracy.state_degradation(apps.gs_final_state(gs, n), apps.gs_final_state(gs, n, abort_enabled=False), "key", "value")


def state_degradation_rollback(spark, sf_dir):
    """Tables after partition 3 was rolled back alone at bid 5000, against those of an undisturbed run."""
    ev, n = _streams(spark, sf_dir)
    gs = tables.gs_events(ev)
    kept = recovery.local_rollback(txn.valid(gs, txn.gs_aborts()).filter(~F.col("is_read")), 5000, 3, n, PARTITIONS)
    sums = kept.groupBy("key").agg(F.sum("delta").alias("d"))
    after = spark.range(n).toDF("key").join(sums, "key", "left").select("key", (F.coalesce("d", F.lit(0)) + apps.GS_INITIAL).alias("value"))
    return accuracy.state_degradation(apps.gs_final_state(gs, n), after, "key", "value")


def relative_error_tp(spark, sf_dir):
    """Running counts as if only every vehicle's reports of odd bids had come, against all."""
    tp = _tp(spark, sf_dir)
    base = apps.tp_running_count(tp)
    return accuracy.relative_error(base, apps.tp_running_count(tp.filter("bid % 2 = 1")), ["cnt"])


def abort_counts(spark, sf_dir):
    ev, _ = _streams(spark, sf_dir)
    apps_of = [("gs", tables.gs_events(ev), txn.gs_aborts()), ("sl", tables.sl_events(ev), txn.sl_aborts()), ("ob", tables.ob_events(ev), txn.ob_aborts()), ("tp", tables.tp_events(ev, SEGMENTS), txn.tp_aborts())]
    counts = [e.agg(F.count_if(a).alias("aborted"), F.count_if(~a).alias("finished")).select(F.lit(name).alias("app"), "aborted", "finished") for name, e, a in apps_of]
    return apps._union(counts)


def events_per_epoch(spark, sf_dir):
    return tables.app_events(spark, sf_dir).groupBy("epoch").agg(F.count(F.lit(1)).alias("cnt"), F.min("bid").alias("first_bid"), F.max("bid").alias("last_bid"))


def key_partition_histogram(spark, sf_dir):
    ev, n = _streams(spark, sf_dir)
    return ev.groupBy(txn.partition_of(F.col("user_id"), n, PARTITIONS).alias("pid")).agg(F.count(F.lit(1)).alias("cnt"))


#: The last bid before the snapshot that recoveries start from, and the partition that is lost.
SNAPSHOT_BID, LOST = 5000, 3


def recovery_log_gs(spark, sf_dir):
    """Counters from the snapshot of the first epoch and the log of all later ones."""
    ev, n = _streams(spark, sf_dir)
    writes = txn.key_ops(txn.valid(tables.gs_events(ev), txn.gs_aborts()).filter(~F.col("is_read")), "keys", "values").select("epoch", "key", F.col("values_op").alias("delta"))
    first = tables.micro_table(spark, n).select("key", text.stored_number(F.col("value")).alias("value"))
    log = scratch.written(recovery.changes(writes, first, n), "log")
    return recovery.redo(recovery.redo(first, log, 0), log.filter("epoch > 0"), 1 << 62)


def recovery_dependency_gs(spark, sf_dir):
    """Counters after partition LOST was lost and it and all that depends on it ran again from the snapshot."""
    ev, n = _streams(spark, sf_dir)
    gs = tables.gs_events(ev)
    before, since = gs.filter(F.col("bid") <= SNAPSHOT_BID), gs.filter(F.col("bid") > SNAPSHOT_BID)
    gone = txn.partition_of(F.col("key"), n, PARTITIONS) == LOST
    current = apps.gs_final_state(gs, n).withColumn("value", F.when(~gone, F.col("value")))
    return recovery.rolled_back(current, apps.gs_final_state(before, n), since, LOST, n, PARTITIONS)


def recovery_replay_ob(spark, sf_dir):
    """Goods from the snapshot and all input since, run again."""
    events, n = _ob(spark, sf_dir)
    snapshot = apps.ob_goods(apps.ob_fold(events.filter(F.col("bid") <= SNAPSHOT_BID), apps.ob_initial(spark, n)))
    return apps.ob_goods(apps.ob_fold(events.filter(F.col("bid") > SNAPSHOT_BID), scratch.written(snapshot, "snapshot")))


def recovery_determinants_sl(spark, sf_dir):
    """Balances after partition LOST alone ran again from a snapshot, with logged balances of other partitions."""
    events, n = _sl(spark, sf_dir)
    first = apps.sl_initial(spark, n)
    history = apps.sl_history(apps.sl_ops(events), first)
    epoch = (events.agg(F.max("epoch")).first()[0] or 0) // 2
    since = events.filter(F.col("epoch") >= epoch)
    log = scratch.written(recovery.determinants(since, history, n, PARTITIONS), "determinants")
    snapshot = apps.sl_after(history.filter(F.col("epoch") < epoch), first)
    own = recovery.ledger_with_determinants(since, snapshot, log, LOST, n, PARTITIONS)
    return apps.sl_after(history, first).filter(txn.partition_of(F.col("key"), n, PARTITIONS) != LOST).unionByName(own)


def gs_stored_values(spark, sf_dir):
    """Final counters as the text that a table stores, and as numbers read back from it."""
    stored = gs_final_state(spark, sf_dir).select("key", text.right_pad(F.col("value")).alias("stored"))
    return stored.select("key", "stored", text.stored_number(F.col("stored")).alias("value"))


def position_reports(spark, sf_dir):
    """Position reports as text lines, parsed again."""
    ev = tables.app_events(spark, sf_dir)
    fields = [F.col("bid") * 7, F.col("user_id"), F.col("cents") % 100, F.lit(0), F.col("bid") % 5, F.col("bid") % 2, F.col("user_id") % 100, F.col("cents")]
    back = text_events.parse_positions(ev.select(F.concat_ws(" ", *[f.cast("string") for f in fields]).alias("value")))
    return back.select("time", "vid", "speed", "seg", "pos", "minute", "on_exit_lane", text_events.road_is_full(F.col("speed"), F.col("vid")).alias("is_full"))


def event_text_types(spark, sf_dir):
    """Events of all other types as text lines, parsed again: who, which keys, and what amount."""
    ev = tables.app_events(spark, sf_dir)
    zeros, item = F.array(F.lit(0), F.lit(0)).cast("array<bigint>"), lambda c: F.array(c, c)
    sl, ob, tp = tables.sl_events(ev), tables.ob_events(ev), tables.tp_events(ev, SEGMENTS)

    def lines(rows, kind, **fields):
        head = {"bid": F.col("bid"), "pid": F.lit(0), "bid_array": zeros, "num_p": F.lit(2), "event_type": F.lit(kind)}
        return rows.select(*[c.alias(n) for n, c in (head | fields | {"ts": F.col("bid") + 1000, "is_abort": F.lit(False)}).items()])

    amount, two = F.col("amount"), F.lit(2)
    made = [
        ("DepositEvent", lines(sl.filter("kind = 'deposit'"), "DepositEvent", account=F.col("src"), book=F.col("src"), acct_delta=amount, book_delta=amount), F.col("account").cast("long"), F.col("acct_delta")),
        ("TransactionEvent", lines(sl.filter("kind = 'transfer'"), "TransactionEvent", src_acct=F.col("src"), src_book=F.col("src"), tgt_acct=F.col("tgt"), tgt_book=F.col("tgt"), acct_x=amount, book_x=amount), F.col("src_acct").cast("long"), F.col("book_x")),
        ("BuyingEvent", lines(ob.filter("kind = 'buy'"), "BuyingEvent", items=F.col("items"), bid_prices=item(F.col("price")), bid_qtys=item(F.col("qty"))), F.get("items", F.lit(1)), F.get("bid_qtys", F.lit(1))),
        ("AlertEvent", lines(ob.filter("kind = 'alert'"), "AlertEvent", num_access=two, items=F.col("items"), ask_prices=item(F.col("price"))), F.get("items", F.lit(1)), F.get("ask_prices", F.lit(0))),
        ("ToppingEvent", lines(ob.filter("kind = 'topping'"), "ToppingEvent", num_access=two, items=F.col("items"), top_ups=item(F.col("qty"))), F.get("items", F.lit(1)), F.get("top_ups", F.lit(0))),
        ("TollProcessEvent", lines(tp, "TollProcessEvent", segments=F.array("seg"), speed=F.col("speed"), vid=F.col("vid")), F.get("segments", F.lit(0)), F.col("speed")),
    ]
    back = [text_events.parse(text_events.serialise(rows, kind), kind).select("bid", "event_type", key.cast("long").alias("key"), value.cast("long").alias("amount"), "ts") for kind, rows, key, value in made]
    return apps._union(back)


def sliding_window_counts(spark, sf_dir):
    ev = tables.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return metrics.sliding(ev, "ts", "6 hours", "2 hours", "event_type").withColumn("started", F.col("started").cast("string"))


def partition_dependency_closure(spark, sf_dir):
    """Over all transfers."""
    ev, n = _streams(spark, sf_dir)
    return recovery.dependency_closure(recovery.dependency_edges(tables.sl_events(ev), n, PARTITIONS), PARTITIONS)


def event_text_roundtrip(spark, sf_dir):
    """Write events as text lines, parsed again."""
    gs = _gs(spark, sf_dir)
    typed = gs.select("bid", F.lit(0).alias("pid"), F.array(F.lit(0)).cast("array<bigint>").alias("bid_array"), F.lit(1).alias("num_p"), F.lit("MicroEvent").alias("event_type"), F.col("keys").cast("array<int>").alias("keys"), F.col("values").cast("array<int>").alias("values"), "is_read", F.col("bid").alias("ts"), txn.gs_aborts().alias("is_abort"))
    back = text_events.parse(text_events.serialise(typed, "MicroEvent"), "MicroEvent")
    return back.select("bid", F.get("keys", F.lit(0)).alias("k1"), F.get("keys", F.lit(1)).alias("k2"), F.get("values", F.lit(0)).alias("v1"), "is_read", "is_abort")


def result_text(spark, sf_dir):
    return text_events.result_lines(apps.gs_read_sum(_gs(spark, sf_dir)), ["read_sum"])


def spike_moving_average(spark, sf_dir):
    ev = tables.table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return metrics.spikes(ev, "user_id", "event_id", "cents").filter("is_spike").select("event_id", "user_id", "cents")


def tumbling_window_counts(spark, sf_dir):
    ev = tables.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return metrics.tumbling(ev, "ts", "6 hours", "event_type").withColumn("started", F.col("started").cast("string"))


def session_windows(spark, sf_dir):
    ev = tables.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return metrics.sessions(ev, "user_id", "ts", "30 minutes").withColumn("started", F.unix_timestamp("started"))


def throughput_per_day(spark, sf_dir):
    days = metrics.throughput(tables.table(spark, sf_dir, "events"))
    return days.select(F.date_format("slot", "yyyy-MM-dd").alias("day"), "cnt")


def latency_percentiles(spark, sf_dir):
    ev = tables.table(spark, sf_dir, "events").select(F.round(F.col("value") * 100).cast("long").alias("cents"))
    return metrics.percentiles(ev, "cents").select("pct", F.round("value", 6).alias("value"))


def mean_latency_by_type(spark, sf_dir):
    ev = tables.table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return ev.groupBy("event_type").agg(F.sum("cents").alias("total"), F.count(F.lit(1)).alias("cnt"), F.round(F.avg("cents"), 6).alias("mean"))


def zipf_pmf(spark, sf_dir):
    return generators.zipf_pmf(spark, 1000, 0.4).select("rank", F.round("p", 12).alias("p"))


def partition_load(spark, sf_dir):
    """Cents that events bring to each range of keys, added up in two steps."""
    ev, n = _streams(spark, sf_dir)
    load = routing.key_grouping(ev, "user_id", n, PARTITIONS)
    return routing.partial_key_sum(load, "pid", "cents")


def latest_version(spark, sf_dir):
    """As-of read: for each read event, the last committed write before it on its first key."""
    gs = _gs(spark, sf_dir)
    ops = txn.key_ops(txn.valid(gs, txn.gs_aborts()), "keys", "values").filter("idx = 0")
    ops = state.value_before(ops, ["key"], "bid", F.when(~F.col("is_read"), F.col("bid")), "version")
    return ops.filter("is_read").select("bid", "key", "version")


QUERIES: dict[str, Query] = {
    "gs_read_sum": lambda s, d: apps.gs_read_sum(_gs(s, d)),
    "gs_write_result": lambda s, d: apps.gs_write_result(_gs(s, d)),
    "gs_final_state": gs_final_state,
    "gs_read_sum_no_abort": lambda s, d: apps.gs_read_sum(_gs(s, d), abort_enabled=False),
    "wc_count": wc_count,
    "wc_running": wc_running,
    "tp_toll": lambda s, d: apps.tp_toll(_tp(s, d)),
    "tp_segment_speed": lambda s, d: apps.tp_segment_speed(_tp(s, d)),
    "tp_segment_count": lambda s, d: apps.tp_segment_count(_tp(s, d)),
    "tp_running_count": lambda s, d: apps.tp_running_count(_tp(s, d)),
    "tp_conventional_toll": lambda s, d: apps.tp_conventional_toll(_tp(s, d)),
    "tp_late_abort_toll": lambda s, d: apps.tp_late_abort_toll(_tp(s, d)),
    "ob_buy_result": lambda s, d: apps.ob_event_result(*_ob(s, d)).filter("kind = 'buy'").select("bid", "result"),
    "ob_event_result": lambda s, d: apps.ob_event_result(*_ob(s, d)),
    "ob_final_goods": lambda s, d: apps.ob_final_goods(*_ob(s, d)),
    "sl_deposit_result": lambda s, d: apps.sl_deposit_result(_sl(s, d)[0]),
    "sl_epoch_transfer_result": lambda s, d: apps.sl_run(*_sl(s, d))[0],
    "sl_epoch_balances": lambda s, d: apps.sl_run(*_sl(s, d))[1],
    "sl_final_balances": lambda s, d: apps.sl_run(*_sl(s, d))[2],
    "recovery_log_gs": recovery_log_gs,
    "recovery_dependency_gs": recovery_dependency_gs,
    "recovery_replay_ob": recovery_replay_ob,
    "recovery_determinants_sl": recovery_determinants_sl,
    "gs_stored_values": gs_stored_values,
    "position_reports": position_reports,
    "event_text_types": event_text_types,
    "sliding_window_counts": sliding_window_counts,
    "abort_counts": abort_counts,
    "state_degradation_gs": state_degradation_gs,
    "state_degradation_rollback": state_degradation_rollback,
    "relative_error_tp": relative_error_tp,
    "events_per_epoch": events_per_epoch,
    "throughput_per_day": throughput_per_day,
    "latency_percentiles": latency_percentiles,
    "mean_latency_by_type": mean_latency_by_type,
    "key_partition_histogram": key_partition_histogram,
    "partition_dependency_closure": partition_dependency_closure,
    "event_text_roundtrip": event_text_roundtrip,
    "result_text": result_text,
    "latest_version": latest_version,
    "partition_load": partition_load,
    "zipf_pmf": zipf_pmf,
    "spike_moving_average": spike_moving_average,
    "tumbling_window_counts": tumbling_window_counts,
    "session_windows": session_windows,
}


# SQL twins. The streams are derived once here, independently of sources/tables.py.

_EV = """
nk AS (SELECT max(user_id) + 1 AS n FROM events),
ev AS (SELECT event_id + 1 AS bid, event_id // 5000 AS epoch, user_id, (user_id * 7 + 13) % (SELECT n FROM nk) AS k2,
              event_type AS t, CAST(round(value * 100) AS BIGINT) AS cents
       FROM events WHERE (user_id * 7 + 13) % (SELECT n FROM nk) <> user_id)"""

_GS = (
    _EV
    + """,
gse AS (SELECT *, t IN ('view', 'click') AS rd, CASE WHEN t = 'error' THEN -1 ELSE cents % 100 END AS d FROM ev),
gso AS (SELECT bid, rd, d, user_id AS key, user_id AS fk FROM gse UNION ALL SELECT bid, rd, d, k2, user_id FROM gse)"""
)


def _gs_reads(keep: str) -> str:
    return f"""WITH {_GS},
seen AS (SELECT bid, rd, 100 + coalesce(sum(CASE WHEN rd THEN 0 ELSE d END) OVER (PARTITION BY key ORDER BY bid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS v FROM gso WHERE {keep})
SELECT bid, CAST(sum(v) AS BIGINT) AS read_sum FROM seen WHERE rd GROUP BY bid"""


def _gs_final(keep: str) -> str:
    return f"SELECT i.key, CAST(100 + coalesce(sum(o.d), 0) AS BIGINT) AS value FROM (SELECT unnest(range((SELECT n FROM nk))) AS key) i LEFT JOIN (SELECT * FROM gso WHERE NOT rd AND {keep}) o ON i.key = o.key GROUP BY i.key"


_TP = (
    _EV
    + """,
tpe AS (SELECT bid, user_id % 100 AS seg, 120 + cents % 331 AS speed, 1 + (bid - 1) % 100 AS vid FROM ev),
tpv AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY bid) AS r, row_number() OVER (PARTITION BY seg, vid ORDER BY bid) AS nth FROM tpe WHERE speed <= 400),
tpc AS (SELECT *, CAST(sum(CASE WHEN nth = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY seg ORDER BY bid) AS BIGINT) AS cnt FROM tpv),
sp(seg, r, v) AS (SELECT seg, r, CAST(speed AS DOUBLE) FROM tpc WHERE r = 1
  UNION ALL SELECT c.seg, c.r, CASE WHEN s.v = 0 THEN c.speed ELSE (s.v + c.speed) / 2 END FROM sp s JOIN tpc c ON c.seg = s.seg AND c.r = s.r + 1)"""
)

_OB = (
    _EV
    + """,
obe AS (SELECT bid, CASE t WHEN 'signup' THEN 'alert' WHEN 'error' THEN 'topping' ELSE 'buy' END AS kind, (bid - 1) % 10 = 0 AS flag, cents % 100 AS p, (bid - 1) % 20 AS q, user_id, k2 FROM ev),
obo AS (SELECT bid, 0 AS idx, kind, p, q, user_id AS key FROM obe WHERE NOT flag UNION ALL SELECT bid, 1, kind, p, q, k2 FROM obe WHERE NOT flag),
obr AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY bid, idx) AS r FROM obo),
fold(key, r, bid, price, qty, ok) AS (
  SELECT CAST(i AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(i * 37 % 100 AS BIGINT), CAST(100 AS BIGINT), true FROM (SELECT unnest(range((SELECT n FROM nk))) AS i)
  UNION ALL
  SELECT o.key, o.r, o.bid, CASE WHEN o.kind = 'alert' THEN o.p ELSE f.price END,
         CASE WHEN o.kind = 'topping' THEN f.qty + o.q WHEN o.kind = 'buy' AND o.p > f.price AND o.q < f.qty THEN f.qty - o.q ELSE f.qty END,
         o.kind <> 'buy' OR (o.p > f.price AND o.q < f.qty)
  FROM fold f JOIN obr o ON o.key = f.key AND o.r = f.r + 1)"""
)
_OB_RESULT = f"""WITH RECURSIVE {_OB},
done AS (SELECT e.bid, e.kind, CASE WHEN e.flag THEN 0.0::DOUBLE ELSE d.ok::DOUBLE END AS result
         FROM obe e LEFT JOIN (SELECT bid, min(ok::INT) AS ok FROM fold WHERE r > 0 GROUP BY bid) d ON d.bid = e.bid)"""

_SL = (
    _EV
    + """,
sle AS (SELECT bid, epoch, t = 'purchase' AS mv, user_id AS src, k2 AS tgt, CASE WHEN t = 'purchase' THEN cents % 10 WHEN t = 'error' THEN -1 ELSE 500 + cents % 1000 END AS x FROM ev),
slv AS (SELECT * FROM sle WHERE x > 0 OR (NOT mv AND x = 0)),
eps AS (SELECT epoch, row_number() OVER (ORDER BY epoch) - 1 AS ep FROM (SELECT DISTINCT epoch FROM sle)),
slo AS (SELECT v.*, e.ep FROM slv v JOIN eps e ON e.epoch = v.epoch),
st(ep, key, a, b) AS (
  SELECT CAST(0 AS BIGINT), CAST(k AS BIGINT), CAST(10000 AS BIGINT), CAST(10000 AS BIGINT) FROM (SELECT unnest(range((SELECT n FROM nk))) AS k)
  UNION ALL
  SELECT s.ep + 1, s.key,
    s.a + coalesce((SELECT sum(c.da) FROM (
        SELECT o.src AS key, CASE WHEN o.mv THEN -o.x ELSE o.x END AS da FROM slo o WHERE o.ep = s.ep
        UNION ALL SELECT o.tgt, CAST(trunc(o.x + z.a * 0.1) AS BIGINT) FROM slo o JOIN st z ON z.key = o.src WHERE o.mv AND o.ep = s.ep) c WHERE c.key = s.key), 0)::BIGINT,
    s.b + coalesce((SELECT sum(c.db) FROM (
        SELECT o.src AS key, CASE WHEN o.mv THEN -o.x ELSE o.x END AS db FROM slo o WHERE o.ep = s.ep
        UNION ALL SELECT o.tgt, CAST(trunc(o.x + z.b * 0.1) AS BIGINT) FROM slo o JOIN st z ON z.key = o.src WHERE o.mv AND o.ep = s.ep) c WHERE c.key = s.key), 0)::BIGINT
  FROM st s WHERE s.ep < (SELECT max(ep) + 1 FROM eps))"""
)

_ERR = "avg(abs(b.value - a.value) / abs(CASE WHEN a.value = 0 THEN a.value + 1 ELSE a.value END)::DOUBLE)"
_WORDS = """w AS (SELECT doc_id, u.pos - 1 AS pos, u.word FROM (
  SELECT doc_id, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS p FROM (SELECT doc_id, string_split(text, ' ') AS p FROM documents)),
  LATERAL (SELECT unnest(p) AS word, generate_subscripts(p, 1) AS pos) u)"""

ORACLE_SQL: dict[str, str] = {
    "gs_read_sum": _gs_reads("rd OR d >= 0"),
    "gs_read_sum_no_abort": _gs_reads("true"),
    "gs_write_result": f"WITH {_GS} SELECT bid, CASE WHEN d < 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS result FROM gse WHERE NOT rd",
    "gs_final_state": f"WITH {_GS} " + _gs_final("d >= 0"),
    "wc_count": f"WITH {_WORDS} SELECT word, count(*) AS cnt FROM w GROUP BY word",
    "wc_running": f"WITH {_WORDS} SELECT doc_id, CAST(pos AS INT) AS pos, word, row_number() OVER (PARTITION BY word ORDER BY doc_id, pos) AS cnt FROM w",
    "tp_toll": f"WITH RECURSIVE {_TP} SELECT c.bid, CASE WHEN c.cnt <= 50 THEN s.v * 50 ELSE s.v * 50 * (c.cnt - 50) * (c.cnt - 50) END AS toll FROM tpc c JOIN sp s USING (seg, r) UNION ALL SELECT bid, -1.0 FROM tpe WHERE speed > 400",
    "tp_conventional_toll": f"WITH RECURSIVE {_TP} SELECT c.bid, s.v / c.cnt AS toll FROM tpc c JOIN sp s USING (seg, r) UNION ALL SELECT bid, -1.0 FROM tpe WHERE speed > 400",
    "tp_late_abort_toll": f"WITH RECURSIVE {_TP.replace(' FROM tpe WHERE speed <= 400', ' FROM tpe')} SELECT c.bid, CASE WHEN s.v > 350 THEN -1.0 WHEN c.cnt <= 50 THEN s.v * 50 ELSE s.v * 50 * (c.cnt - 50) * (c.cnt - 50) END AS toll FROM tpc c JOIN sp s USING (seg, r)",
    "tp_segment_speed": f"WITH RECURSIVE {_TP} SELECT seg, arg_max(v, r) AS avg_speed FROM sp GROUP BY seg",
    "tp_segment_count": f"WITH RECURSIVE {_TP} SELECT seg, count(DISTINCT vid) AS cnt FROM tpv GROUP BY seg",
    "tp_running_count": f"WITH RECURSIVE {_TP} SELECT bid, seg, cnt FROM tpc",
    "ob_buy_result": _OB_RESULT + " SELECT bid, result FROM done WHERE kind = 'buy'",
    "ob_event_result": _OB_RESULT + " SELECT bid, kind, result FROM done",
    "ob_final_goods": f"WITH RECURSIVE {_OB} SELECT key AS item, arg_max(price, r) AS price, arg_max(qty, r) AS qty FROM fold GROUP BY key",
    "sl_deposit_result": f"WITH {_EV} SELECT bid, CASE WHEN t = 'error' THEN 0.0 ELSE 1.0 END::DOUBLE AS result FROM ev WHERE t <> 'purchase'",
    "sl_epoch_transfer_result": f"WITH RECURSIVE {_SL} SELECT o.bid, s.a AS v1, s.a AS v2 FROM slo o JOIN st s ON s.key = o.src AND s.ep = o.ep WHERE o.mv",
    "sl_epoch_balances": f"WITH RECURSIVE {_SL} SELECT e.epoch, s.key, s.a AS account, s.b AS asset FROM st s JOIN eps e ON e.ep = s.ep",
    "sl_final_balances": f"WITH RECURSIVE {_SL} SELECT key, a AS account, b AS asset FROM st WHERE ep = (SELECT max(ep) + 1 FROM eps)",
    "abort_counts": f"""WITH {_EV}, x AS (
  SELECT 'gs' AS app, t = 'error' AS ab FROM ev UNION ALL SELECT 'sl', CASE WHEN t = 'purchase' THEN cents % 10 <= 0 ELSE t = 'error' END FROM ev
  UNION ALL SELECT 'ob', (bid - 1) % 10 = 0 FROM ev UNION ALL SELECT 'tp', 120 + cents % 331 > 400 FROM ev)
SELECT app, count(*) FILTER (WHERE ab) AS aborted, count(*) FILTER (WHERE NOT ab) AS finished FROM x GROUP BY app""",
    "state_degradation_gs": f"WITH {_GS}, a AS ({_gs_final('d >= 0')}), b AS ({_gs_final('true')}) SELECT {_ERR} AS error, count(*) AS rows FROM a JOIN b USING (key)",
    "state_degradation_rollback": f"WITH {_GS}, a AS ({_gs_final('d >= 0')}), b AS ({_gs_final('d >= 0 AND NOT (key // ceil((SELECT n FROM nk) / 16.0)::BIGINT = 3 AND fk // ceil((SELECT n FROM nk) / 16.0)::BIGINT <> 3 AND bid <= 5000)')}) SELECT {_ERR} AS error, count(*) AS rows FROM a JOIN b USING (key)",
    "relative_error_tp": f"""WITH RECURSIVE {_TP},
odd AS (SELECT *, row_number() OVER (PARTITION BY seg, vid ORDER BY bid) AS nth2 FROM tpe WHERE speed <= 400 AND bid % 2 = 1),
b AS (SELECT bid, sum(CASE WHEN nth2 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY seg ORDER BY bid) AS value FROM odd),
a AS (SELECT bid, cnt AS value FROM tpc)
SELECT {_ERR} AS error, count(*) AS rows FROM a JOIN b USING (bid)""",
    "events_per_epoch": f"WITH {_EV} SELECT epoch, count(*) AS cnt, min(bid) AS first_bid, max(bid) AS last_bid FROM ev GROUP BY epoch",
    "throughput_per_day": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS cnt FROM events GROUP BY 1",
    "latency_percentiles": "SELECT p * 1.0::DOUBLE AS pct, round((SELECT quantile_cont(CAST(round(value * 100) AS BIGINT)::DOUBLE, [0.005, 0.2, 0.4, 0.6, 0.8, 0.99]) FROM events)[i], 6) AS value FROM (VALUES (0.5::DOUBLE, 1), (20, 2), (40, 3), (60, 4), (80, 5), (99, 6)) AS v(p, i)",
    "mean_latency_by_type": "SELECT event_type, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS total, count(*) AS cnt, round(avg(CAST(round(value * 100) AS BIGINT)), 6) AS mean FROM events GROUP BY event_type",
    "key_partition_histogram": f"WITH {_EV} SELECT user_id // ceil((SELECT n FROM nk) / 16.0)::BIGINT AS pid, count(*) AS cnt FROM ev GROUP BY 1",
    "partition_dependency_closure": f"""WITH RECURSIVE {_EV},
e AS (SELECT user_id // ceil((SELECT n FROM nk) / 16.0)::BIGINT AS a, k2 // ceil((SELECT n FROM nk) / 16.0)::BIGINT AS b FROM ev WHERE t = 'purchase' AND cents % 10 > 0),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c(lost, affected) AS (SELECT i, i FROM (SELECT unnest(range(16)) AS i) UNION SELECT c.lost, g.b FROM c JOIN g ON g.a = c.affected)
SELECT DISTINCT lost, affected FROM c""",
    "recovery_log_gs": f"WITH {_GS} " + _gs_final("d >= 0"),
    "recovery_dependency_gs": f"WITH {_GS} " + _gs_final("d >= 0"),
    "recovery_replay_ob": f"WITH RECURSIVE {_OB} SELECT key AS item, arg_max(price, r) AS price, arg_max(qty, r) AS qty FROM fold GROUP BY key",
    "recovery_determinants_sl": f"WITH RECURSIVE {_SL} SELECT key, a AS account, b AS asset FROM st WHERE ep = (SELECT max(ep) + 1 FROM eps)",
    "gs_stored_values": f"WITH {_GS}, f AS ({_gs_final('d >= 0')}) SELECT key, rpad(value::VARCHAR, greatest(32, length(value::VARCHAR))::INT, ' ') AS stored, value FROM f",
    "position_reports": f"""WITH {_EV} SELECT bid * 7 AS time, user_id::INT AS vid, (cents % 100)::INT AS speed, (user_id % 100)::SMALLINT AS seg, cents::INT AS pos,
  bid * 7 // 60 + 1 AS minute, bid % 5 = 4 AS on_exit_lane, cents % 100 < 40 AND user_id > 50 AS is_full FROM ev""",
    "event_text_types": f"""WITH {_EV}, x AS (
  SELECT bid, CASE WHEN t = 'purchase' THEN 'TransactionEvent' ELSE 'DepositEvent' END AS event_type, user_id AS key,
         CASE WHEN t = 'purchase' THEN cents % 10 WHEN t = 'error' THEN -1 ELSE 500 + cents % 1000 END AS amount FROM ev
  UNION ALL SELECT bid, CASE t WHEN 'signup' THEN 'AlertEvent' WHEN 'error' THEN 'ToppingEvent' ELSE 'BuyingEvent' END, k2,
         CASE WHEN (bid - 1) % 10 = 0 THEN -1 WHEN t = 'signup' THEN cents % 100 ELSE (bid - 1) % 20 END FROM ev
  UNION ALL SELECT bid, 'TollProcessEvent', user_id % 100, 120 + cents % 331 FROM ev)
SELECT bid, event_type, key, amount, bid + 1000 AS ts FROM x""",
    "sliding_window_counts": """WITH w AS (SELECT event_type, time_bucket(INTERVAL '2 hours', ts::TIMESTAMP, TIMESTAMP '1970-01-01') - INTERVAL '2 hours' * k AS s FROM events, range(3) r(k))
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS started, event_type, count(*) AS cnt FROM w GROUP BY 1, 2""",
    "event_text_roundtrip": f"WITH {_GS} SELECT bid, user_id::INT AS k1, k2::INT AS k2, d::INT AS v1, rd AS is_read, NOT rd AND d < 0 AS is_abort FROM gse",
    "result_text": f"SELECT bid || ';' || read_sum || ',' AS value FROM ({_gs_reads('rd OR d >= 0')})",
    "latest_version": f"WITH {_GS}, f AS (SELECT bid, rd, user_id AS key FROM gse WHERE rd OR d >= 0), s AS (SELECT *, max(CASE WHEN NOT rd THEN bid END) OVER (PARTITION BY key ORDER BY bid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS version FROM f) SELECT bid, key, version FROM s WHERE rd",
    "partition_load": f"WITH {_EV} SELECT user_id // ceil((SELECT n FROM nk) / 16.0)::BIGINT AS pid, sum(cents)::BIGINT AS total FROM ev GROUP BY 1",
    "zipf_pmf": "SELECT i AS rank, round(pow(i, -0.4) / (SELECT sum(pow(j, -0.4)) FROM range(1, 1001) r(j)), 12) AS p FROM range(1, 1001) t(i)",
    "spike_moving_average": "WITH m AS (SELECT event_id, user_id, CAST(round(value * 100) AS BIGINT) AS cents FROM events), a AS (SELECT *, avg(cents) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) AS ma FROM m) SELECT event_id, user_id, cents FROM a WHERE abs(cents - ma) > 0.3 * ma",
    "tumbling_window_counts": "SELECT strftime(time_bucket(INTERVAL '6 hours', ts::TIMESTAMP, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS started, event_type, count(*) AS cnt FROM events GROUP BY 1, 2",
    "session_windows": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS started, count(*) AS cnt FROM s GROUP BY user_id, sid""",
}
