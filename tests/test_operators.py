"""Operators against brute force on small data."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from calltide.catalog import agent_rows, catalog_rows
from calltide.checks.inputs import labelled
from calltide.operators.isolation import IsolationForest
from calltide.operators.metrics import attach_metrics
from calltide.plans.analysis import advise
from calltide.operators.models import CallModel
from calltide.operators.quantiles import quantiles
from calltide.operators.tree import child_counts, depths

PROBS = {"q0": 0.0, "q5": 0.05, "q50": 0.5, "q95": 0.95, "q99": 0.99, "q100": 1.0}


def test_catalog():
    rows = {r[0]: r for r in catalog_rows()}
    assert len(rows) == 158 and sum(r[4] for r in rows.values()) == 47
    assert rows["ioctl"][1:4] == ("device", 3.0, 3)
    assert rows["pwrite64"][1:4] == ("io", 1.0, 1) and rows["accept4"][1:4] == ("network", 10.0, 3)
    assert dict(agent_rows())["futex"] == "scheduling"


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles(spark, seed):
    rng = np.random.default_rng(seed)
    groups = {
        "one": [4.25],
        "two": [-1.5, 3.0],
        "same": [7.0] * 50,
        "mixed": [*rng.normal(0, 5, 300), *([1.0] * 150), 0.0, 0.0, -0.0, 1e-300, -1e12, 1e300],
        "narrow": list(100 + rng.random(500) * 1e-6),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("two", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: r for r in quantiles(df, "v", PROBS, ("g",)).collect()}
    for g, values in groups.items():
        for name, p in PROBS.items():
            assert got[g][name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12), (g, name)
    everything = quantiles(df, "v", PROBS).first()
    allv = [v for values in groups.values() for v in values]
    assert everything["q95"] == pytest.approx(np.quantile(allv, 0.95))


def test_quantiles_of_close_values(spark):
    values = [1.0 + k * 1e-13 for k in range(5000)] + [7.0] * 3000
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    got = quantiles(df, "v", {"a": 0.1, "b": 0.4, "c": 0.9}).first()
    for name, p in (("a", 0.1), ("b", 0.4), ("c", 0.9)):
        assert got[name] == pytest.approx(np.quantile(values, p), rel=1e-15)
    plan = quantiles(df, "v", {"a": 0.1})._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan


def test_advice_without_metrics(spark):
    rows = [("a", 1, 0, 5.0, True), ("a", 1, 1, 1.0, False), ("b", 1, 0, None, False), ("b", None, 1, 2.0, False)]
    kinds = "trace_id string, pid long, syscall_id long, latency_us double, is_high_latency boolean"
    calls = spark.createDataFrame(rows, kinds).withColumns(
        {c: F.lit(None).cast("double") for c in ("cpu_usage", "memory_usage", "context_switches")}
    ).withColumns({"is_redundant": F.lit(False), "risk_level": F.lit(1)})
    got = {(r.trace_id, r.pid): r for r in advise(calls).collect()}
    assert set(got) == {("a", 1), ("b", 1)}
    one = got["a", 1]
    assert one.current_cpu is None and one.recommended_cpu is None and one.recommended_memory is None
    assert one.priority_score == pytest.approx(20.0) and one.progress == 100.0
    assert [a["type"] for a in one.actions] == ["priority_boost"]
    nothing = got["b", 1]
    assert nothing.priority_score is None and nothing.progress is None and nothing.actions == []


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_as_of(spark, partitions):
    rng = random.Random(4)
    at = lambda: pd.Timestamp("2024-01-01") + pd.Timedelta(milliseconds=rng.randint(0, 100_000))
    calls = [(1 if rng.random() < 0.7 else rng.randint(2, 5), at(), i) for i in range(500)]
    samples = sorted({(rng.choice([1, 1, 2, 3]), at()) for _ in range(80)})
    samples = [(pid, ts, float(i)) for i, (pid, ts) in enumerate(samples)]
    c = pd.DataFrame(calls, columns=["pid", "ts", "id"])
    s = pd.DataFrame(samples, columns=["pid", "ts", "cpu"])
    want = pd.merge_asof(c.sort_values("ts"), s.sort_values("ts"), on="ts", by="pid").set_index("id")["cpu"]
    got = attach_metrics(spark.createDataFrame(c), spark.createDataFrame(s), partitions=partitions).toPandas()
    got = got.set_index("id")["cpu"].reindex(want.index)
    assert len(got) == 500 and got.isna().equals(want.isna())
    assert (got.dropna() == want.dropna()).all()


def test_tree(spark):
    rows = [("h", 0, 0), ("h", 1, 0), ("h", 2, 1), ("h", 3, 2), ("h", 9, 77), ("h", 4, 5), ("h", 5, 4), ("h", 6, 4)]
    rows += [("chain", i, i - 1) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "hostname string, pid long, ppid long")
    got = {(r.hostname, r.pid): r.depth for r in depths(df).collect()}
    assert [got["h", p] for p in (0, 1, 2, 3, 9)] == [0, 1, 2, 3, 0]
    assert got["h", 4] is None and got["h", 5] is None and got["h", 6] is None
    assert all(got["chain", i] == i - 1 for i in range(1, 200))
    kids = {(r.hostname, r.pid): r.children for r in child_counts(df).collect()}
    assert kids["h", 0] == 1 and kids["h", 4] == 2 and kids["h", 3] == 0


def test_isolation_forest(spark, small, tmp_path):
    rng = np.random.default_rng(0)
    data = pd.DataFrame(rng.normal(0, 1, (3000, 3)), columns=["a", "b", "c"])
    data.loc[:19, ["a", "b", "c"]] = 9.0 + rng.random((20, 3))
    data["id"] = range(len(data))
    df = spark.createDataFrame(data)
    forest = IsolationForest.fit(df, ("a", "b", "c"), "id", n_trees=50)
    scores = df.select("id", forest.score().alias("s")).toPandas().set_index("id")["s"]
    assert abs((scores < 0).mean() - 0.05) < 0.01
    assert (scores.loc[:19] < 0).all()
    again = IsolationForest.fit(df.repartition(13), ("a", "b", "c"), "id", n_trees=50)
    assert again.offset == pytest.approx(forest.offset) and again.trees.equals(forest.trees)
    forest.save(spark, str(tmp_path / "f"))
    loaded = IsolationForest.load(spark, str(tmp_path / "f"))
    assert loaded.trees.equals(forest.trees) and loaded.offset == forest.offset


def test_call_model(spark):
    calls = labelled(spark, "/root/testdata/sf0.01")
    model = CallModel.fit(calls, iterations=10, restarts=2, trees=10)
    assert model.metrics["latency_model"]["auc_roc"] >= 0.95
    assert 0.7 < model.metrics["samples_trained"] / 10000 < 0.9
    scored = model.transform(calls)
    share = scored.agg(F.avg(F.col("is_anomaly").cast("double"))).first()[0]
    assert 0.03 < share < 0.07
    assert scored.filter("optimization_priority is null or pattern_cluster not between 0 and 4").count() == 0
    # Traces without a process type and with unknown names score as well.
    odd = calls.drop("process_type").withColumn("syscall_name", F.lit("never_seen")).limit(5)
    assert model.transform(odd).filter("high_latency_probability is not null").count() == 5
