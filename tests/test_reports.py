"""Scripts of any size and histories that stay small."""

from pyspark.sql import functions as F

from calltide.plans import history as hist
from calltide.plans.ledger import Ledger
from calltide.plans.report import script_parts, write_scripts

SUMMARY = "trace_id string, total_syscalls long, high_latency_count long, optimization_candidates long, anomalies_detected long, avg_latency double"
ADVICE = "trace_id string, pid long, priority_score double, actions array<struct<type: string, value: double, reason: string>>"
RECOMMENDATION = "trace_id string, seq int, type string, syscall string, count long, avg_latency double, recommendation string"


def test_a_trace_of_many_processes(spark, tmp_path):
    summaries = spark.createDataFrame([("big", 10, 1, 1, 0, 2.0), ("none", 1, 0, 0, 0, 1.0)], SUMMARY)
    slow = [("big", 1, "high_latency", "read", 3, 9.5, "cache it"), ("big", 2, "redundancy", "brk", 2, None, "do it once")]
    boost = [("priority_boost", 1.0, "slow")]
    advice = [("big", pid, float(pid % 50), boost if pid % 3 == 0 else []) for pid in range(2500)]
    advice += [("big", 9999, None, None), ("gone", 1, 1.0, [])]
    parts = script_parts(
        summaries,
        spark.createDataFrame(slow, RECOMMENDATION),
        spark.createDataFrame(advice, ADVICE).repartition(5),
        "2024-01-01 00:00:00",
        per_part=100,
    )
    rows = parts.orderBy("trace_id", "section", "part").collect()
    assert {r.trace_id for r in rows} == {"big", "none"}
    assert [(r.section, r.part) for r in rows if r.trace_id == "none"] == [(0, 0), (5, 0)]
    third = [r for r in rows if r.section == 3]
    assert [r.part for r in third] == list(range(27))
    assert max(r.content.count("# PID") for r in third) == 100
    listed = [line.split()[2] for r in third for line in r.content.split("\n") if line.startswith("# PID")]
    want = sorted(range(2500), key=lambda pid: (-float(pid % 50), pid)) + [9999]
    assert listed == [str(pid) for pid in want]
    write_scripts(parts, str(tmp_path / "scripts"))
    for trace in ("big", "none"):
        files = list((tmp_path / "scripts" / f"trace_id={trace}").glob("*.txt"))
        assert len(files) == 1
        assert files[0].read_text() == "".join(r.content + "\n" for r in rows if r.trace_id == trace)


def test_history_stays_small(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = lambda k: spark.createDataFrame(
        [(u, f"t{k % 4}", f"title {k}") for u in (1, 2)], "user_id long, trace_id string, title string"
    ).withColumn("created_at", F.timestamp_seconds(F.lit(1_700_000_000 + k * 43_200)))
    for k in range(9):
        hist.append(rows(k), path)
        if k in (4, 7):
            before = sorted(map(str, hist.history(spark, path).collect()))
            hist.compact(spark, path)
            assert sorted(map(str, hist.history(spark, path).collect())) == before
    ledger = Ledger(spark, path)
    assert len(ledger.folders()) <= 6 and ledger.read_all().count() == 8 + 2
    got = {(r.user_id, r.trace_id): r.title for r in hist.history(spark, path).collect()}
    assert got == {(u, f"t{k % 4}"): f"title {k}" for u in (1, 2) for k in (5, 6, 7, 8)}
    late = hist.history(spark, path, user_id=1, since="2023-11-17")
    assert {r.title for r in late.collect()} == {"title 5", "title 6", "title 7", "title 8"}
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_date" in plan
