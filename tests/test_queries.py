"""Every checked query against its SQL, on the smallest tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry_point
from calltide.checks import ORACLE, QUERIES

# Trained models are covered by tests of their own.
SLOW = {
    "call_model_scores",
    "call_model_metrics",
    "slow_calls_found",
    "anomalies_by_score",
    "isolation_scores",
    "process_model_advice",
    "process_targets_met",
}


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, duck, small, name):
    assert compare(spark, duck, small, QUERIES[name], ORACLE.get(name)) is None


def test_goldens(spark):
    """Counts of the adapter view at sf0.01, per trace and per process."""
    from calltide.operators.label import mark_redundant
    from calltide.sources.tables import event_calls
    from pyspark.sql import functions as F

    calls = event_calls(spark, "/root/testdata/sf0.01")
    for key, want in (("trace_id", (253, 20)), ("pid", (188, 42))):
        row = mark_redundant(calls, "both", key=key).agg(
            F.count_if("is_redundant_trace"), F.count_if("is_redundant_generator")
        ).first()
        assert tuple(row) == want


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
