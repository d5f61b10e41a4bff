"""Order-dependent rules: chunked equals plain, whatever the chunks."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from calltide.operators.chunks import rank_rows, split_by_id, with_index, with_running
from calltide.operators.clock import wall_times
from calltide.operators.label import mark_redundant


def brute(calls):
    """(trace, id) -> (trace rule, generator rule) by plain lists."""
    history, out = {}, {}
    for trace, number, name in sorted(calls):
        seen = history.setdefault(trace, [])
        last5, last10 = seen[-5:], seen[-10:]
        out[trace, number] = (last5.count(name) >= 3, last10.count(name) * 2 > len(last10))
        seen.append(name)
    return out


def random_calls(seed, n=400, gap=1):
    rng = random.Random(seed)
    number, calls = 0, []
    for _ in range(n):
        number += rng.randint(1, gap)
        trace = "hot" if rng.random() < 0.6 else f"t{rng.randint(0, 5)}"
        calls.append((trace, number, rng.choice("aaab" if rng.random() < 0.5 else "abcd")))
    return calls


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(seed=st.integers(0, 10**6), span=st.sampled_from([1, 3, 10, 11, 37, 999]), gap=st.sampled_from([1, 2, 50]))
def test_redundancy_equals_brute_force(spark, seed, span, gap):
    calls = random_calls(seed, gap=gap)
    df = spark.createDataFrame(calls, "trace_id string, syscall_id long, syscall_name string")
    got = {
        (r.trace_id, r.syscall_id): (r.is_redundant_trace, r.is_redundant_generator)
        for r in mark_redundant(df, "both", span=span).collect()
    }
    assert got == brute(calls)


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_index_and_sums(spark, span):
    df = spark.createDataFrame(random_calls(3, gap=9), "trace_id string, syscall_id long, syscall_name string")
    chunked, layout = split_by_id(df, "trace_id", "syscall_id", span)
    plain = Window.partitionBy("trace_id").orderBy("syscall_id")
    both = with_running(
        with_index(chunked, layout, "place"), layout, {"total": F.col("syscall_id")}
    ).withColumns({"place2": F.row_number().over(plain) - 1, "total2": F.sum("syscall_id").over(plain)})
    assert both.filter("place <> place2 or total <> total2").count() == 0
    assert both.count() == 400


def test_rank_rows(spark):
    df = spark.createDataFrame(random_calls(5, gap=3), "trace_id string, syscall_id long, syscall_name string")
    ranked = rank_rows(df, ("trace_id",), ("syscall_name", "syscall_id"), "place", partitions=5)
    plain = Window.partitionBy("trace_id").orderBy("syscall_name", "syscall_id")
    assert ranked.withColumn("p", F.row_number().over(plain) - 1).filter("p <> place").count() == 0


@pytest.mark.parametrize("span", [1, 4, 1000])
def test_wall_times_cross_midnight(spark, span):
    rng = random.Random(9)
    rows, clocks = [], {1: 0, 2: 50000}
    for number in range(300):
        pid = rng.choice([1, 1, 2])
        clocks[pid] += rng.randint(0, 60000)
        second = clocks[pid] % 86400
        text = f"{second // 3600:02d}:{second % 3600 // 60:02d}:{second % 60:02d}.{number:06d}"
        rows.append(("t", pid, number, text if number % 17 else None, clocks[pid]))
    df = spark.createDataFrame(rows, "trace_id string, pid long, syscall_id long, ts_text string, at long")
    chunked, layout = split_by_id(df, ("trace_id", "pid"), "syscall_id", span)
    got = wall_times(chunked, "2024-03-01", layout)
    start = 1709251200  # 2024-03-01 in seconds
    wrong = got.filter(F.col("ts").isNotNull() & (F.unix_seconds("ts") != F.col("at") + start))
    # Where a clock text is missing, a full day could pass unseen; none does here.
    known = got.filter(F.col("ts").isNotNull()).count()
    assert known == len([r for r in rows if r[3]])
    assert wrong.count() == 0
