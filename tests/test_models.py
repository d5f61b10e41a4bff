"""Models and their parts against plain versions."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from calltide.checks.inputs import labelled
from calltide.operators import process as proc
from calltide.operators import sketches
from calltide.operators.clusters import Clusters
from calltide.operators.models import CallModel, ProcessModel
from calltide.operators.quantiles import quantiles
from calltide.operators.ranking import exact_auc
from calltide.operators.scaling import PopulationScaler


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 10, (5, 3))
    rows = np.concatenate([centres[i % 5] + rng.normal(0, 1, 3) for i in range(1500)]).reshape(-1, 3)
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], "a double, b double, c double").repartition(4), rows


def test_restarts_together(spark, points, tmp_path):
    df, rows = points
    found = Clusters.fit(df, ("a", "b", "c"), restarts=6)
    vectors = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    single = min(KMeans(k=5, seed=i).fit(vectors).summary.trainingCost for i in range(3))
    assert found.cost <= single * 1.001 and found.cost == min(found.costs) and len(found.costs) == 6
    far = ((rows[:, None, :] - found.centres[None]) ** 2).sum(axis=2)
    assert found.cost == pytest.approx(far.min(axis=1).sum(), rel=1e-9)
    got = df.select("a", "b", "c", found.nearest().alias("n")).toPandas()
    near = ((got[["a", "b", "c"]].to_numpy()[:, None, :] - found.centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (got["n"].to_numpy() == near).all()
    again = Clusters.fit(df.repartition(9), ("a", "b", "c"), restarts=6)
    assert np.allclose(again.centres, found.centres)
    found.save(spark, str(tmp_path / "c"))
    loaded = Clusters.load(spark, str(tmp_path / "c"))
    assert np.array_equal(loaded.centres, found.centres) and loaded.costs == found.costs


def test_few_rows_make_clusters(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (5.0,)], "a double")
    assert Clusters.fit(df, ("a",), k=3, restarts=2).cost == 0.0
    with pytest.raises(ValueError):
        Clusters.fit(df.limit(0), ("a",))


def test_population_scaler(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, 2.0), (8.0, 5.0, 4.0)], "a double, b double, c double")
    scaler = PopulationScaler(inputCols=["a", "b", "c"])
    pipeline = Pipeline(stages=[scaler]).fit(df)
    path = str(tmp_path / "p")
    pipeline.write().overwrite().save(path)
    for model in (pipeline, PipelineModel.load(path)):
        rows = model.transform(df).orderBy("a").collect()
        assert [r.scaled_a for r in rows] == pytest.approx((np.array([1, 3, 8]) - 4) / np.std([1, 3, 8]))
        assert [r.scaled_b for r in rows] == [0.0, 0.0, 0.0]
        assert [r.scaled_c for r in rows] == [None, -1.0, 1.0]
    assert scaler.outputs() == ["scaled_a", "scaled_b", "scaled_c"]


@pytest.mark.parametrize("partitions", [1, 7])
def test_exact_auc(spark, partitions):
    rng = np.random.default_rng(partitions)
    rows = [(k, float(rng.integers(0, 9) / 4), int(rng.random() < 0.3)) for k in (1, 2) for _ in range(150)]
    rows += [(3, 0.5, 1), (3, 0.7, 1), (1, None, 1), (2, 0.5, None)]
    df = spark.createDataFrame(rows, "k long, s double, y int")

    def plain(chosen):
        pos = np.array([s for _, s, y in chosen if y == 1 and s is not None])
        neg = np.array([s for _, s, y in chosen if y == 0 and s is not None])
        if not len(pos) or not len(neg):
            return None
        return ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))

    got = {r.k: r.auc for r in exact_auc(df, "s", "y", ("k",), partitions).collect()}
    assert got[3] is None
    for k in (1, 2):
        assert got[k] == pytest.approx(plain([r for r in rows if r[0] == k]), abs=1e-12)
    assert exact_auc(df, "s", "y", partitions=partitions).first().auc == pytest.approx(plain(rows), abs=1e-12)


@pytest.mark.parametrize("limit", [1, 50, 1 << 16])
def test_quantiles_cut_until_parts_are_small(spark, limit):
    rng = np.random.default_rng(1)
    values = np.concatenate([1 + rng.random(800) * 1e-9, rng.lognormal(size=300), np.full(500, 7.0), -rng.random(50)])
    df = spark.createDataFrame([(i % 2, float(v)) for i, v in enumerate(values)], "k int, v double").repartition(3)
    probs = {"a": 0.0, "b": 0.3, "c": 0.5, "d": 0.95, "e": 1.0}
    for r in quantiles(df, "v", probs, ("k",), limit=limit).collect():
        want = np.quantile(values[np.arange(len(values)) % 2 == r.k], list(probs.values()))
        assert list(r)[1:] == pytest.approx(list(want), rel=1e-15)


def test_sketches_merge(spark):
    df = spark.range(30_000).select(
        (F.col("id") % 3).alias("day"), (F.col("id") % 5).alias("kind"), F.col("id").cast("double").alias("v"), (F.col("id") % 900).alias("pid")
    )
    cube = sketches.sketch_cube(df, ("day", "kind"), ("v",), ("pid",))
    whole = sketches.read_out(sketches.roll_up(cube), {"p50": 0.5, "p99": 0.99}).first()
    assert whole.n == 30_000
    assert abs(whole.v_p50 - 15_000) < 300 and abs(whole.v_p99 - 29_700) < 300
    assert abs(whole.pid_distinct - 900) < 45
    days = sketches.read_out(sketches.roll_up(cube, ("day",)), {"p50": 0.5}).collect()
    assert len(days) == 3 and all(abs(r.v_p50 - 15_000) < 300 and abs(r.pid_distinct - 300) < 15 for r in days)
    near = quantiles(df, "v", {"x": 0.5}, approx=True).first()
    assert abs(near.x - 15_000) < 300


def test_models_are_the_same_after_loading(spark, small, tmp_path):
    calls = labelled(spark, small)
    model = CallModel.fit(calls, iterations=2, restarts=2, trees=5)
    model.save(spark, str(tmp_path / "calls"))
    loaded = CallModel.load(spark, str(tmp_path / "calls"))
    assert loaded.metrics == model.metrics
    names = ["syscall_id", "high_latency_probability", "anomaly_score", "pattern_cluster"]
    assert model.transform(calls).select(*names).exceptAll(loaded.transform(calls).select(*names)).count() == 0

    stats = proc.with_ratios(proc.process_stats(calls, ("trace_id", "pid")))
    advisor = ProcessModel.fit(stats, iterations=5, noise_seed=None)
    advisor.save(spark, str(tmp_path / "processes"))
    again = ProcessModel.load(spark, str(tmp_path / "processes"))
    names = ["trace_id", "pid", "predicted_throughput", "recommended_cpu", "recommended_memory"]
    assert advisor.transform(stats).select(*names).exceptAll(again.transform(stats).select(*names)).count() == 0
    assert advisor.metrics["resource_optimizer"]["cpu_r2"] > 0.3


def test_process_model_reads_its_statistics_once(spark):
    met = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        met.add(1)
        return x

    calls = spark.range(600).select(
        (F.col("id") % 60).alias("pid"), F.lit("t").alias("trace_id"), F.col("id").alias("syscall_id"),
        (F.col("id") % 7 + 1.0).alias("latency_us"), (F.col("id") % 50 + 10.0).alias("cpu_usage"), F.lit(20.0).alias("memory_usage"),
        F.lit(1).alias("context_switches"), (F.col("id") % 3 == 0).alias("is_high_latency"), (F.col("id") % 4 == 0).alias("is_redundant"),
        F.lit(1).alias("risk_level"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("process_type"),
    )
    stats = proc.with_ratios(proc.process_stats(calls)).withColumn("process_type", counted("process_type"))
    ProcessModel.fit(stats, iterations=1)
    assert met.value == 60
