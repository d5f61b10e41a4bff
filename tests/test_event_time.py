"""Streams by event time: late rows, silence, repeated messages, logs that stay small."""

import json
import random

import pytest
from pyspark.sql import functions as F

from calltide.operators.label import mark_redundant
from calltide.plans.ledger import Ledger
from calltide.streaming import live
from calltide.streaming.ordered import in_event_order, presence_changes
from calltide.streaming.state import label_stream, latest_updates, log_updates

START = 1_700_000_000
CALL = "trace_id string, syscall_id long, syscall_name string, ts timestamp"


def _calls(spark, ids):
    rows = [("cold" if i % 5 == 0 else "hot", i, "aaba"[i % 7 % 4], START + i) for i in ids]
    return spark.createDataFrame(rows, "trace_id string, syscall_id long, syscall_name string, at long").select(
        "trace_id", "syscall_id", "syscall_name", F.timestamp_seconds("at").alias("ts")
    )


def _clock(spark, at):
    return spark.createDataFrame([("clock", at, "tick", START + at)], "trace_id string, syscall_id long, syscall_name string, at long").select(
        "trace_id", "syscall_id", "syscall_name", F.timestamp_seconds("at").alias("ts")
    )


def _label(spark, batches, source, out, mark, **options):
    for rows in batches:
        rows.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(CALL).parquet(source)
        label_stream(stream, out, mark, "both", span=7, **options).awaitTermination()


def test_shuffled_batches_get_the_labels_of_the_batch(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    ids = list(range(300))
    # No call comes more than 50 seconds after a later one.
    random.Random(2).shuffle(ids)
    order = sorted(range(300), key=lambda i: i + 49 * random.Random(i).random())
    batches = [_calls(spark, order[a : a + 75]) for a in range(0, 300, 75)] + [_clock(spark, 10_000)]
    _label(spark, batches, source, out, mark, wait=50, keep=100)
    names = ["syscall_id", "is_redundant_trace", "is_redundant_generator"]
    got = spark.read.parquet(f"{out}/labels").filter("trace_id <> 'clock'").select(*names)
    want = mark_redundant(_calls(spark, range(300)), "both").select(*names)
    assert got.count() == 300 and got.exceptAll(want).count() == 0
    assert spark.read.parquet(f"{out}/late").count() == 0
    assert len(list((tmp_path / "out" / "memory").glob("batch=*"))) <= 2


def test_too_late_calls_and_idle_traces(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    batches = [_calls(spark, range(100, 200)), _clock(spark, 400), _calls(spark, [50, 51, 150]), _clock(spark, 5000), _clock(spark, 9000)]
    _label(spark, batches, source, out, mark, wait=10, keep=1000, forget=600)
    late = spark.read.parquet(f"{out}/late").select("syscall_id")
    assert sorted(r.syscall_id for r in late.collect()) == [50, 51, 150]
    got = spark.read.parquet(f"{out}/labels").filter("trace_id <> 'clock'")
    assert sorted(r.syscall_id for r in got.collect()) == list(range(100, 200))
    # The last clock is held: nothing else is, neither in the state nor in the memory.
    last = spark.readStream.schema(CALL).parquet(source)
    query = label_stream(last, out, mark, "both", span=7, wait=10, keep=1000, forget=600)
    query.awaitTermination()
    states = spark.read.format("statestore").load(mark)
    assert states.select("key.*").distinct().count() == 1
    newest = max((tmp_path / "out" / "memory").glob("batch=*"), key=lambda p: int(p.name[6:]))
    assert {r.trace_id for r in spark.read.parquet(str(newest)).collect()} <= {"clock"}


def test_rows_keep_their_values(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "trace_id string, syscall_id long, ts timestamp, x double, flag boolean, list array<long>, note string"
    rows = spark.sql(
        """SELECT * FROM VALUES
        ('a', 1L, timestamp_micros(1700000000123457), 0.1D, true, array(1L, null), 'q"\\n'),
        (null, 2L, timestamp_micros(1700000000000001), double('NaN'), null, null, null),
        ('a', 3L, null, 1.5D, false, array(), ''),
        ('clock', 4L, timestamp_micros(1900000000000000), 0D, null, null, null)
        AS t(trace_id, syscall_id, ts, x, flag, list, note)"""
    )
    rows.coalesce(1).write.parquet(source)
    stream = in_event_order(spark.readStream.schema(schema).parquet(source), wait=5, keep=5)
    log_updates(stream, out, mark, mode="append").awaitTermination()
    got = Ledger(spark, out).read_all()
    assert {(r.syscall_id, r.is_late) for r in got.collect()} == {(1, False), (2, False), (3, True)}
    plain = lambda df: sorted(map(str, df.filter("syscall_id < 4").select(*rows.columns).collect()))
    assert plain(got) == plain(rows)


def _presence(messages, silence):
    """The changes of one user's (second, is_goodbye) messages, by walking through them."""
    out, last = [], None
    for at, bye in sorted(set(messages)):
        if last is not None and at - last > silence:
            out.append(("offline", last + silence, "silence"))
            last = None
        if bye and last is not None:
            out.append(("offline", at, "goodbye"))
            last = None
        elif not bye:
            if last is None:
                out.append(("online", at, "message"))
            last = at
    return out + ([("offline", last + silence, "silence")] if last is not None else [])


def test_presence(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rnd = random.Random(7)
    users = {u: [(START + rnd.randrange(2000), rnd.random() < 0.2) for _ in range(n)] for u, n in ((1, 400), (2, 30), (3, 1))}
    users[4] = [(START + 5, True)]
    feed = sorted(((at + 30 * rnd.random(), u, at, bye) for u, sent in users.items() for at, bye in sent))
    feed += [(0, 0, START + 9000, False), (0, 0, START + 99000, False)]
    for a in range(0, len(feed), 120):
        rows = [(u, at, "agent_offline" if bye else "syscall") for _, u, at, bye in feed[a : a + 120]]
        spark.createDataFrame(rows, "user_id long, at long, type string").select(
            "user_id", F.timestamp_seconds("at").alias("ts"), "type"
        ).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("user_id long, ts timestamp, type string").parquet(source)
        log_updates(presence_changes(stream, 20, wait=40), out, mark, mode="append").awaitTermination()
    rows = Ledger(spark, out).read_all().filter("user_id > 0").select("user_id", "status", F.unix_seconds("since"), "reason").collect()
    want = [(u, *change) for u, sent in users.items() for change in _presence(sent, 20)]
    assert sorted(map(tuple, rows)) == sorted(want)
    # Users that are offline have left the state.
    states = spark.read.format("statestore").load(mark).select("key.user_id").collect()
    assert {r.user_id for r in states} <= {0}


def test_repeated_messages(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    at = lambda k: f"2024-01-01T00:{k // 60:02d}:{k % 60:02d}"
    call = lambda k: {"type": "syscall", "syscall": "read", "timestamp": at(k), "is_high_latency": k % 2 == 0}
    texts = [json.dumps(call(k)) for k in range(50)]
    texts.append(json.dumps({"type": "syscall_batch", "events": [call(60), call(61)]}))
    texts += ["{broken", "[1]", json.dumps({"type": "party"}), json.dumps({"type": "heartbeat"})]
    raw = spark.createDataFrame([(k % 2, t) for k, t in enumerate(texts)] + [(1, None)], "user_id long, value string")
    for again in range(3):
        raw.coalesce(1).write.mode("append").parquet(source)
        stream = live.once(live.read_messages(spark, source))
        events = live.unpack_events(live.parse_messages(stream))
        query = log_updates(live.live_counters(events), out, mark, keys=["user_id"], every=2)
        query.awaitTermination()
    want = live.live_counters(live.unpack_events(live.parse_messages(raw))).collect()
    assert sorted(latest_updates(spark, out, ["user_id"]).collect()) == sorted(want)
    static = live.once(raw.unionByName(raw))
    assert static.filter("value LIKE '%read%'").count() == 51
    refused = live.refused_messages(raw).collect()
    assert sorted(r.reason for r in refused) == ["empty", "not an object", "not json", "unknown type"]


def test_mistyped_fields_inside_batches(spark):
    batch = {"type": "syscall_batch", "events": [{"pid": "abc", "latency_us": "x"}, {"pid": 1}, {"is_redundant": "maybe"}]}
    snapshot = {"type": "process_snapshot", "processes": [{"pid": "1", "cpu": "much"}], "count": "one"}
    raw = spark.createDataFrame([(1, json.dumps(batch)), (2, json.dumps(snapshot))], "user_id long, value string")
    assert {r.user_id: r.mistyped for r in live.parse_messages(raw).collect()} == {1: 3, 2: 2}


def test_a_long_log_stays_small(spark, tmp_path):
    path = str(tmp_path / "log")
    ledger = Ledger(spark, path, ["k"], every=10)
    with pytest.raises(FileNotFoundError):
        ledger.read()
    most, held = 0, None
    for batch in range(100):
        rows = spark.range(5).select((F.col("id") + batch % 3).alias("k"), F.lit(batch).alias("v")).coalesce(1)
        if batch == 55:  # a reader that has looked at the manifest goes on through a folding
            held = ledger.read()
            ledger.fold()
        if batch == 58:
            held = {r.k: r.v for r in held.collect()}
        ledger.put(rows, batch)
        ledger.put(rows, batch)  # run again
        most = max(most, len(ledger.folders()))
    assert most <= 2 * 10 + 3
    newest = {k: max(b for b in range(100) if k - b % 3 in range(5)) for k in range(7)}
    assert {r.k: r.v for r in ledger.read().collect()} == newest
    assert held == {k: max(b for b in range(55) if k - b % 3 in range(5)) for k in range(7)}
    assert len(list((tmp_path / "log" / "_manifest").glob("0*"))) <= 12


def test_a_half_written_manifest_does_not_count(spark, tmp_path):
    path = str(tmp_path / "log")
    ledger = Ledger(spark, path, ["k"])
    ledger.put(spark.range(3).select(F.col("id").alias("k"), F.lit(1).alias("v")))
    (tmp_path / "log" / "_manifest" / "000000000002").write_text('{"number": 2, "snap')
    assert ledger.read().count() == 3
