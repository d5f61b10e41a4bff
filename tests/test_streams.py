"""Streams that stop and go on, and odd messages."""

import json

from pyspark.sql import functions as F

from calltide.operators.label import mark_redundant
from calltide.streaming.live import parse_messages, unpack_events
from calltide.streaming.state import label_stream, latest_updates, log_updates, ring_buffers


def test_messages(spark):
    event = {"syscall": "read", "latency_us": 3.5, "is_high_latency": False, "timestamp": "2024-01-01T00:00:00.5"}
    texts = [
        json.dumps(event),
        json.dumps({"type": "syscall", **event}),
        json.dumps({"type": "syscall_batch", "events": [event, event], "platform": "Linux"}),
        json.dumps({"type": "syscall_batch", "events": []}),
        json.dumps({"type": "heartbeat"}),
        json.dumps({"type": "agent_info", "platform": "Linux", "hostname": "h"}),
        "{broken",
        "",
    ]
    raw = spark.createDataFrame([(1, t) for t in texts] + [(2, None)], "user_id long, value string")
    messages = parse_messages(raw)
    kinds = sorted(r.type for r in messages.select("type").collect())
    assert kinds == ["agent_info", "syscall", "syscall", "syscall_batch", "syscall_batch"]
    events = unpack_events(messages).collect()
    assert len(events) == 4 and all(e.syscall == "read" and e.ts is not None for e in events)


def test_mistyped_fields(spark):
    texts = [
        json.dumps({"type": "syscall", "syscall": "read", "pid": 12, "latency_us": 1.5}),
        json.dumps({"type": "syscall", "syscall": "read", "pid": "12", "latency_us": "1.5"}),
        json.dumps({"type": "syscall", "syscall": "read", "pid": "x", "latency_us": 1.5, "is_redundant": "maybe"}),
        json.dumps({"type": "syscall_batch", "events": [{"syscall": "read", "pid": "12", "latency_us": [1]}]}),
        "[1]",
        '"text"',
    ]
    messages = parse_messages(spark.createDataFrame([(1, t) for t in texts], "user_id long, value string"))
    assert sorted(r.mistyped for r in messages.collect()) == [0, 0, 1, 2]
    events = sorted((r.pid or 0, r.latency_us or 0.0) for r in unpack_events(messages).collect())
    assert events == [(0, 1.5), (12, 0.0), (12, 1.5), (12, 1.5)]


def _calls(spark, first, last):
    return spark.range(first, last).select(
        F.when(F.col("id") % 5 == 0, "cold").otherwise("hot").alias("trace_id"),
        F.col("id").alias("syscall_id"),
        F.element_at(F.array(F.lit("a"), F.lit("a"), F.lit("b"), F.lit("a")), (F.col("id") % 7 % 4 + 1).cast("int")).alias(
            "syscall_name"
        ),
    )


def test_labels_go_on_after_a_stop(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for first, last in ((0, 50), (50, 52), (52, 300)):
        _calls(spark, first, last).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(_calls(spark, 0, 1).schema).parquet(source)
        label_stream(stream, out, mark, "both", span=7).awaitTermination()
    got = spark.read.parquet(f"{out}/labels").select("syscall_id", "is_redundant_trace", "is_redundant_generator")
    want = mark_redundant(_calls(spark, 0, 300), "both").select(*got.columns)
    assert got.count() == 300
    assert got.exceptAll(want).count() == 0


def test_late_calls_are_set_apart(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for first, last in ((20, 60), (60, 90), (0, 20)):
        _calls(spark, first, last).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(_calls(spark, 0, 1).schema).parquet(source)
        label_stream(stream, out, mark, "both", span=7).awaitTermination()
    assert sorted(r.syscall_id for r in spark.read.parquet(f"{out}/late").collect()) == list(range(20))
    got = spark.read.parquet(f"{out}/labels").select("syscall_id", "is_redundant_trace", "is_redundant_generator")
    want = mark_redundant(_calls(spark, 20, 90), "both").select(*got.columns)
    assert got.count() == 70 and got.exceptAll(want).count() == 0


def test_rings_go_on_after_a_stop(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows = lambda first, last: spark.range(first, last).select(
        F.when(F.col("id") % 10 == 0, 2).otherwise(1).cast("long").alias("user_id"),
        F.col("id").alias("event_id"),
        (F.col("id") * 0.5).alias("latency_us"),
    )
    for first, last in ((0, 30), (30, 2000), (2000, 2005)):
        rows(first, last).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows(0, 1).schema).parquet(source)
        log_updates(ring_buffers(stream), out, mark).awaitTermination()
    rings = {r.user_id: (r.event_id, r.latency_us) for r in latest_updates(spark, out, ["user_id"]).collect()}
    for user in (1, 2):
        ids = [i for i in range(2005) if (2 if i % 10 == 0 else 1) == user][-40:]
        assert rings[user] == (ids, [i * 0.5 for i in ids])


def test_trained_model_scores_a_stream(spark, small, tmp_path):
    from calltide.checks.inputs import labelled
    from calltide.operators.models import CallModel
    from calltide.streaming.state import score_stream

    calls = labelled(spark, small)
    model = CallModel.fit(calls, iterations=2, restarts=1, trees=5)
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    calls.write.parquet(source)
    stream = spark.readStream.schema(calls.schema).parquet(source)
    score_stream(stream, model, out, mark).awaitTermination()
    names = ["syscall_id", "pattern_cluster", "is_anomaly"]
    got, want = spark.read.parquet(out).select(*names), model.transform(calls).select(*names)
    assert got.count() == calls.count() and got.exceptAll(want).count() == 0


def test_posted_records(spark):
    from calltide.sources.records import calls_from_json

    bodies = [
        json.dumps({"syscalls": [{"syscall_name": "read", "latency_us": 2, "pid": 3}, {"syscall_name": "brk"}]}),
        "{not json",
        json.dumps({"other": 1}),
    ]
    rows = calls_from_json(spark.createDataFrame([(b,) for b in bodies], "body string"), "body")
    got = rows.select("syscall_name", "latency_us", "pid").orderBy("syscall_name").collect()
    assert [tuple(r) for r in got] == [("brk", None, None), ("read", 2.0, 3)]
