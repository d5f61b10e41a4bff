"""Parsing of trace text, on texts of our own."""

import gzip

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from calltide.plans.analysis import advise
from calltide.operators.parse import (
    calls_from_lines,
    match_lines,
    parse_calls,
    parse_lines,
    parse_stats,
    read_statuses,
    parse_summary,
    summary_traces,
)
from calltide.session import materialise
from calltide.sources.traces import read_lines, text_lines, with_places

TRACE = """
09:00:00.000100 openat(AT_FDCWD, "/srv/a.txt", O_RDONLY) = 3 <0.000020>
09:00:00.000200 read(3, "abc"..., 4096) = 512 <0.000001>
09:00:00.000300 read(3, "a) = 1 b", 10) = 8 <0.000030>

77 read(3, "", 4096) = 0 <0.000002>
77 09:00:00.000400 read(3, "", 4096) = 0 <0.000002>
--- SIGCHLD {si_signo=SIGCHLD} ---
09:00:00.000500 wait4(-1, <unfinished ...>
09:00:00.000600 <... read resumed> "", 10) = 0
09:00:00.000700 access("/nope", R_OK) = -1 ENOENT (No such file or directory) <0.000012>
09:00:00.000800 recvfrom(4, 0x1, 10) = -1 EAGAIN (Resource temporarily unavailable)
09:00:00.000900 brk(NULL) = 0x55a3c8e4f000 <0.000008>
read(3, "x", 1) = 1 <1.2.3>
this is not a call
+++ exited with 0 +++
09:00:00.001000 exit_group(0) = ?

"""

SUMMARY = """% time     seconds  usecs/call     calls    errors syscall
------ ----------- ----------- --------- --------- ----------------
 60.00    0.006000           2      3000           read
 30.00    0.003000         100        30         4 connect
 10.00    0.001000           7         0           brk
------ ----------- ----------- --------- --------- ----------------
100.00    0.010000                  3030         4 total
"""


def lines_of(spark, span=1 << 16, **texts):
    rows = spark.createDataFrame(list(texts.items()), "id string, text string")
    return text_lines(rows, F.col("id"), F.col("text"), span)


def test_fields(spark):
    rows = parse_calls(lines_of(spark, t=TRACE)).orderBy("line_seq").collect()
    assert [r.syscall_name for r in rows] == [
        "openat", "read", "read", "read", "read", "access", "recvfrom", "brk", "exit_group",
    ]
    assert [r.pid for r in rows] == [0, 0, 0, 77, 77, 0, 0, 0, 0]
    assert rows[3].ts_text is None and rows[4].ts_text == "09:00:00.000400"
    assert rows[2].args_summary == '3, "a) = 1 b", 10'
    assert (rows[5].errno, rows[5].errno_desc) == ("ENOENT", "No such file or directory")
    assert rows[5].return_value == -1 and rows[7].return_value == 0 and rows[8].return_value == 0
    assert rows[6].errno == "EAGAIN" and rows[6].latency_estimated
    assert rows[6].latency_us == 20.0 and rows[8].latency_us == 50.0
    assert rows[1].category == "io" and rows[0].base_latency_us == 0.8
    assert abs(rows[5].latency_us - 12.0) < 1e-9


def test_long_arguments_and_units(spark):
    text = "read(3, \"" + "x" * 300 + "\", 4) = 1 <25>"
    row = parse_calls(lines_of(spark, t=text), duration_unit="us").first()
    assert len(row.args_summary) == 100 and row.latency_us == 25.0


@pytest.mark.parametrize("span", [2, 3, 1 << 16])
def test_stats_and_labels(spark, span):
    lines = lines_of(spark, span, t=TRACE, s=SUMMARY, empty=" \n ")
    stats = {r.trace_id: r for r in parse_stats(lines).collect()}
    inner = TRACE.strip().split("\n")
    assert stats["t"].parsed_lines == 9
    assert stats["t"].skipped_lines == len(inner) - 9
    number = inner.index("read(3, \"x\", 1) = 1 <1.2.3>") + 1
    assert stats["t"].errors == [f"Line {number}: could not convert string to float: '1.2.3'"]
    assert stats["t"].total_errors == 1
    assert (stats["s"].parsed_lines, stats["s"].skipped_lines) == (3, 0)
    assert (stats["empty"].parsed_lines, stats["empty"].skipped_lines) == (0, 1)

    calls = calls_from_lines(lines).filter("trace_id = 't'").orderBy("syscall_id").collect()
    assert [c.syscall_id for c in calls] == list(range(9))
    assert [c.is_redundant for c in calls] == [False] * 4 + [True] + [False] * 4
    assert calls[1].is_high_latency is False and calls[2].is_high_latency is True
    assert calls[4].needs_optimization is True
    assert calls[0].cpu_usage is None and calls[0].source == "strace"


def test_summary(spark):
    lines = lines_of(spark, 2, s=SUMMARY, t=TRACE)
    assert [r.trace_id for r in summary_traces(lines).collect()] == ["s"]
    rows = parse_summary(lines.filter("trace_id = 's'")).orderBy("line_seq").collect()
    assert [(r.syscall_name, r.calls, r.errors) for r in rows] == [
        ("read", 3000, 0), ("connect", 30, 4), ("brk", 0, 0),
    ]
    calls = calls_from_lines(lines).filter("trace_id = 's'")
    got = calls.agg(
        F.count("*"), F.countDistinct("syscall_id"), F.max("syscall_id"),
        F.count_if(F.col("errno") == "ERROR"), F.count_if("is_high_latency"),
        F.count_if("needs_optimization"), F.count_if("is_redundant"),
    ).first()
    assert tuple(got) == (3030, 3030, 3029, 4, 3000, 3000, 0)
    errors = calls.filter("return_value = -1").select("syscall_id").orderBy("syscall_id").collect()
    assert [e.syscall_id for e in errors] == [3000, 3001, 3002, 3003]


def test_hostile_summary_rows(spark):
    hostile = SUMMARY.replace("connect\n", "connect\n  1.00    0.000001           1 99999999999999999999           futex\n")
    assert hostile != SUMMARY
    lines = lines_of(spark, 2, s=hostile)
    assert parse_summary(lines).count() == 3
    stats = parse_stats(lines).first()
    assert (stats.parsed_lines, stats.total_errors) == (3, 1)
    assert stats.errors == ["could not read summary row: 1.00 0.000001 1 99999999999999999999 futex"]
    calls = calls_from_lines(lines)
    assert calls.filter("pid <> 0 or pid is null or args_summary <> '' or args_summary is null").count() == 0
    advice = advise(calls).first()
    assert advice.recommended_cpu is None and advice.predicted_throughput is not None


def test_files_keep_order(spark, tmp_path):
    body = "".join(f"{i % 7} call_{i}(x) = {i} <0.000001>\n" for i in range(5000))
    (tmp_path / "a.trace").write_text(body)
    with gzip.open(tmp_path / "b.trace.gz", "wt") as out:
        out.write(body)
    (tmp_path / "c.trace").write_bytes(b"read(3, \"\xff\xfe\", 1) = 1 <0.000001>\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        calls = calls_from_lines(read_lines(spark, str(tmp_path), span=100)).cache()
        wrong = calls.filter("return_value <> syscall_id and trace_id not like '%c.trace'").count()
        counts = {r.trace_id.rsplit("/", 1)[1]: r["count"] for r in calls.groupBy("trace_id").count().collect()}
        odd = calls.filter("trace_id like '%c.trace'").first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert wrong == 0 and counts == {"a.trace": 5000, "b.trace.gz": 5000, "c.trace": 1}
    assert odd.args_summary == '3, "��", 1'
    with pytest.raises(AnalysisException):
        read_lines(spark, str(tmp_path / "missing"))


def test_one_pattern_run_and_no_python(spark):
    plan = match_lines(lines_of(spark, t=TRACE))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert plan.count("regexp_replace") == 1


def test_places_do_not_depend_on_splits(spark, tmp_path):
    rows = [
        b"7 read(3, \"\xff\xfe\", 1) = 1 <0.000001>\r",
        b"",
        "7 write(1, \"\u00e9\u4e2d\", 2) = 2 <0.000001>".encode(),
        b"lone \r return and no call",
    ]
    content = b"\n".join(rows[i % 4] for i in range(4000)) + b"\n9 close(1) = 0 <0.000002>"
    (tmp_path / "a.trace").write_bytes(content)
    with gzip.open(tmp_path / "b.trace.gz", "wb") as out:
        out.write(content)
    found = []
    for size in ("30011", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            lines = with_places(materialise(read_lines(spark, str(tmp_path), span=300)))
            calls = parse_lines(lines).calls()
            found.append({(r.trace_id[-6:], r.syscall_id, r.byte_at) for r in calls.collect()})
            numbers = lines.filter("trace_id LIKE '%a.trace'").agg(F.min("line_no"), F.max("line_no"), F.count("*")).first()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
        assert tuple(numbers) == (1, 4001, 4001)
    assert found[0] == found[1] and len(found[0]) == 2 * 2001
    for _, _, at in found[0]:
        line = content[at:].split(b"\n", 1)[0]
        assert content[at - 1 : at] in (b"", b"\n") and b"(" in line


def test_calls_and_statistics_read_one_parse(spark):
    lines = lines_of(spark, t=TRACE, s=SUMMARY)
    plan = read_statuses(lines)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("regexp_replace") == 1
    parsed = parse_lines(lines)
    for df in (parsed.calls(), parsed.stats()):
        assert "regexp_replace" not in df._jdf.queryExecution().executedPlan().toString()
    by_status = {r.status: r["count"] for r in parsed.lines.filter("trace_id = 't'").groupBy("status").count().collect()}
    assert by_status == {"blank": 4, "noise": 4, "call": 9, "bad": 1, "other": 1}
    direct = parse_lines(lines, stage=False)
    assert sorted(map(str, direct.calls().collect())) == sorted(map(str, parsed.calls().collect()))
    assert sorted(map(str, direct.stats().collect())) == sorted(map(str, parsed.stats().collect()))


@pytest.mark.parametrize("span", [1, 2, 100])
def test_clock_of_mixed_processes(spark, span):
    clocks = ["23:59:59.900000", "23:59:59.800000", "00:00:00.100000", "23:59:59.950000", "00:00:01.0", "09:00:00.5", "03:00:00.0"]
    text = "\n".join(f"{k % 3} {clock} read(3) = 1 <0.000001>" for k, clock in enumerate(clocks)) + "\nread(3) = 1"
    calls = calls_from_lines(lines_of(spark, span, t=text, s=SUMMARY), date="2024-02-28")
    rows = calls.filter("trace_id = 't'").orderBy("syscall_id").select(F.date_format("ts", "dd HH:mm:ss.S").alias("at")).collect()
    assert [r["at"] for r in rows] == [
        "28 23:59:59.9", "28 23:59:59.8", "29 00:00:00.1", "28 23:59:59.9", "29 00:00:01.0", "29 09:00:00.5", "29 03:00:00.0", None,
    ]
    assert calls.filter("trace_id = 's' AND ts IS NOT NULL").count() == 0
