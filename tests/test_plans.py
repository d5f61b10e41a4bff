"""The physical plans are the ones meant."""

import re

import pytest
from pyspark.sql import functions as F

from calltide.checks.inputs import labelled, scored
from calltide.operators.aggregate import by_category, call_cube
from calltide.operators.label import label
from calltide.operators.process import process_stats
from calltide.sources.tables import event_calls
from calltide.streaming.live import recent_events


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_label_plan(spark, small):
    text = plan(label(event_calls(spark, small)))
    assert "BroadcastHashJoin [syscall_name" in text
    assert "Python" not in text and "SinglePartition" not in text
    # Rows travel once, by (trace, chunk); the rest is the tails of chunks.
    wide = [line for line in text.split("\n") if "Exchange hashpartitioning" in line]
    assert sum("_chunk" in line for line in wide) == 3
    assert "WindowGroupLimit" in text


def test_scan_reads_only_what_is_needed(spark, small):
    text = plan(event_calls(spark, small).groupBy("syscall_name").count())
    read = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "value" not in read and "user_id" not in read


def test_cube_is_one_aggregation(spark, small):
    text = plan(by_category(call_cube(scored(spark, small))))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "SinglePartition" not in text


def test_process_stats_combine_before_the_shuffle(spark, small):
    text = plan(process_stats(labelled(spark, small)))
    assert "partial_" in text and "Python" not in text


def test_recent_events_limit_before_the_shuffle(spark, small):
    rows = event_calls(spark, small).select(F.col("pid").alias("user_id"), F.col("syscall_id").alias("event_id"))
    text = plan(recent_events(rows, 5))
    assert text.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", ["analysis_summary", "recommendations", "latency_profile", "redundant_calls"])
def test_no_pair_joins(spark, small, name):
    from calltide.checks import QUERIES

    text = plan(QUERIES[name](spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
