"""Trained scoring of calls and processes with Spark ML."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.functions.scalar import call_priority
from calltide.operators.features import (
    CALL_FEATURES,
    CALL_LABELS,
    PROCESS_FEATURES,
    call_features,
    hash_split,
    process_features,
)
from calltide.operators.clusters import Clusters
from calltide.operators.ensembles import Blocks, TreeEnsemble, boost, grow_forest
from calltide.operators.isolation import IsolationForest
from calltide.operators.process import process_keys, with_targets
from calltide.operators.ranking import exact_auc
from calltide.operators.scaling import PopulationScaler
from calltide.session import materialise

SEED = 42


def encoder(labels: tuple[str, ...]) -> StringIndexer:
    """Alphabetical codes; null and unseen labels share the code after the last."""
    return StringIndexer(
        inputCols=list(labels),
        outputCols=[f"{c}_encoded" for c in labels],
        stringOrderType="alphabetAsc",
        handleInvalid="keep",
    )


SCALED = [f"scaled_{c}" for c in CALL_FEATURES]


def call_inputs() -> Pipeline:
    """Encoding, standardising (population deviation) and assembly of the 13 call features."""
    return Pipeline(
        stages=[
            encoder(CALL_LABELS),
            PopulationScaler(inputCols=list(CALL_FEATURES)),
            VectorAssembler(inputCols=SCALED, outputCol="features"),
        ]
    )


def class_report(predicted: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, from one grouped count."""
    pairs = predicted.groupBy(
        F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("guess")
    ).agg(F.count(F.lit(1)).alias("n"))
    hit = F.sum(F.when(F.col("label") == F.col("guess"), F.col("n")).otherwise(0))
    actual = pairs.groupBy("label").agg(F.sum("n").alias("support"), hit.alias("hits"))
    guessed = pairs.groupBy(F.col("guess").alias("label")).agg(F.sum("n").alias("guessed"))
    joined = actual.join(guessed, "label", "left")
    precision = F.coalesce(F.try_divide("hits", "guessed"), F.lit(0.0))
    recall = F.col("hits") / F.col("support")
    return joined.select(
        "label",
        precision.alias("precision"),
        recall.alias("recall"),
        F.coalesce(F.try_divide(precision * recall * 2, precision + recall), F.lit(0.0)).alias("f1"),
        "support",
    )


# Training rows of a task: boosting runs hundreds of small jobs over the same rows.
_TASK_ROWS = 20_000


def _train_and_test(split: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """Both sides of a split, in no more tasks than their rows are worth, and their sizes."""
    counts = {r["part"]: r["count"] for r in split.groupBy("part").count().collect()}
    sides = []
    for part in ("train", "test"):
        sides.append(split.filter(F.col("part") == part).coalesce(-(-counts.get(part, 0) // _TASK_ROWS) or 1))
    return *sides, counts.get("train", 0), counts.get("test", 0)


# Training rows up to which fits run side by side: small jobs leave cores idle, large ones
# fill them alone and would push each other's cached rows out of memory.
_SIDE_BY_SIDE_ROWS = 1_000_000


def _at_once(spark: SparkSession, rows: int, *fits):
    """The results of several fits over ``rows`` training rows."""
    with ThreadPoolExecutor(len(fits) if rows <= _SIDE_BY_SIDE_ROWS else 1) as pool:
        return [done.result() for done in [pool.submit(inheritable_thread_target(spark)(fit)) for fit in fits]]


@dataclass
class CallModel:
    """Slow-call and optimisation classifiers, anomaly detector and clusters."""

    inputs: PipelineModel
    latency: TreeEnsemble
    optimization: TreeEnsemble
    anomaly: IsolationForest
    clusters: Clusters
    metrics: dict

    @classmethod
    def fit(
        cls,
        calls: DataFrame,
        key: tuple[str, ...] = ("trace_id", "syscall_id"),
        iterations: int = 100,
        restarts: int = 10,
        trees: int = 100,
    ) -> "CallModel":
        """Trains on labelled calls; the split is a hash of ``key``.

        The prepared rows are written once, and once more as blocks of bytes for the
        trees, which read them many times and must not parse and label again.
        """
        plain = [c for c in CALL_FEATURES if not c.endswith("_encoded")]
        rows = call_features(calls).select(
            *key,
            *CALL_LABELS,
            *plain,
            F.col("is_high_latency").cast("double").alias("y_high"),
            F.col("needs_optimization").cast("double").alias("y_opt"),
        )
        rows = materialise(hash_split(rows, *key), "features")
        fitted = call_inputs().fit(rows)
        prepared = fitted.transform(rows).select(*key, *CALL_FEATURES, "y_high", "y_opt", "part")
        # Standardised columns are cheaper to compute than to read.
        prepared = fitted.stages[1].transform(materialise(prepared, "training"))
        train, test, trained, tested = _train_and_test(prepared)

        # One hash of the key for the draws of both forests.
        keyed = train.withColumn("_key", F.xxhash64(*key))
        blocks = Blocks.of(keyed, tuple(SCALED), ("y_high", "y_opt"), "_key", trained)
        blocks = blocks.written(lambda df: materialise(df, "blocks"))
        latency, optimization, anomaly, clusters = _at_once(
            calls.sparkSession,
            trained,
            lambda: boost(blocks, "y_high", rounds=iterations, depth=6, step=0.1),
            lambda: grow_forest(blocks, "y_opt", n_trees=trees, depth=8, seed=SEED),
            lambda: IsolationForest.fit(keyed, tuple(CALL_FEATURES), "_key", n_trees=trees, seed=SEED),
            lambda: Clusters.fit(train, tuple(SCALED), k=5, restarts=restarts, seed=SEED),
        )

        # Both models score the test rows once, for all figures.
        scored = {"latency_model": (latency, "y_high"), "optimization_model": (optimization, "y_opt")}
        both = [model.probability().alias(f"p_{label}") for model, label in scored.values()]
        predicted = materialise(test.select("y_high", "y_opt", *both), "predicted")
        metrics = {"samples_trained": trained, "samples_tested": tested}
        for name, (_, label) in scored.items():
            right = (F.col(f"p_{label}") > 0.5).cast("double") == F.col(label)
            metrics[name] = {
                "auc_roc": exact_auc(predicted, f"p_{label}", label).first()["auc"],
                "accuracy": predicted.agg(F.avg(right.cast("double"))).first()[0],
            }
        metrics["feature_importance"] = dict(zip(CALL_FEATURES, latency.importance))
        return cls(fitted, latency, optimization, anomaly, clusters, metrics)

    def transform(self, calls: DataFrame) -> DataFrame:
        """Adds the six score columns."""
        rows = self.inputs.transform(call_features(calls))
        kept = calls.columns
        scored = (
            rows.withColumn("high_latency_probability", self.latency.probability())
            .withColumn("optimization_probability", self.optimization.probability())
            .withColumn("pattern_cluster", self.clusters.nearest())
            .withColumn("anomaly_score", self.anomaly.score())
            .withColumn("is_anomaly", F.col("anomaly_score") < 0)
            .withColumn(
                "optimization_priority",
                call_priority(
                    F.col("high_latency_probability"), F.col("optimization_probability"), F.col("anomaly_score")
                ),
            )
        )
        return scored.select(
            *kept,
            "high_latency_probability",
            "optimization_probability",
            "anomaly_score",
            "pattern_cluster",
            "is_anomaly",
            "optimization_priority",
        )

    def save(self, spark: SparkSession, path: str) -> None:
        self.inputs.write().overwrite().save(f"{path}/inputs")
        self.latency.save(spark, f"{path}/latency")
        self.optimization.save(spark, f"{path}/optimization")
        self.anomaly.save(spark, f"{path}/anomaly")
        self.clusters.save(spark, f"{path}/clusters")
        _save_config(spark, f"{path}/config", {"feature_columns": CALL_FEATURES, "training_metrics": self.metrics})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "CallModel":
        return cls(
            PipelineModel.load(f"{path}/inputs"),
            TreeEnsemble.load(spark, f"{path}/latency"),
            TreeEnsemble.load(spark, f"{path}/optimization"),
            IsolationForest.load(spark, f"{path}/anomaly"),
            Clusters.load(spark, f"{path}/clusters"),
            _load_config(spark, f"{path}/config")["training_metrics"],
        )


def _save_config(spark: SparkSession, path: str, config: dict) -> None:
    spark.createDataFrame([(json.dumps(config),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _load_config(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def metrics_table(spark: SparkSession, metrics: dict) -> DataFrame:
    """Training metrics as (metric, value) rows."""
    flat = []
    for name, value in metrics.items():
        for inner, number in value.items() if isinstance(value, dict) else [(None, value)]:
            flat.append((name if inner is None else f"{name}.{inner}", float(number)))
    return spark.createDataFrame(flat, "metric string, value double")


@dataclass
class ProcessModel:
    """Throughput, CPU and memory regressors of processes."""

    inputs: PipelineModel
    throughput: GBTRegressionModel
    cpu: GBTRegressionModel
    memory: GBTRegressionModel
    metrics: dict

    @classmethod
    def fit(
        cls,
        stats: DataFrame,
        key: tuple[str, ...] | None = None,
        iterations: int = 100,
        noise_seed: str | None = "42",
    ) -> "ProcessModel":
        """Trains on process statistics with ratios; targets are the rule's.

        The split and the noise are hashes of ``key``, by default (trace_id, pid) as far as
        the statistics have them.
        The statistics are written once: calls are not labelled
        again for the encoding, nor for the training rows.
        """
        keys = key or process_keys(stats)
        rows = materialise(process_features(with_targets(stats, noise_seed, *keys)), "processes")
        inputs = Pipeline(
            stages=[
                encoder(("process_type",)),
                VectorAssembler(inputCols=PROCESS_FEATURES, outputCol="features"),
            ]
        ).fit(rows)
        prepared = inputs.transform(rows).select(
            *keys, "features", "target_throughput", "target_cpu", "target_memory"
        )
        train, test, trained, _ = _train_and_test(materialise(hash_split(prepared, *keys), "training"))

        depths = {"target_throughput": 5, "target_cpu": 4, "target_memory": 4}
        boosters = [
            GBTRegressor(labelCol=label, maxIter=iterations, maxDepth=depth, stepSize=0.1, seed=SEED)
            for label, depth in depths.items()
        ]
        models = _at_once(stats.sparkSession, trained, *[lambda one=one: one.fit(train) for one in boosters])
        fitted = dict(zip(depths, models))

        def measure(label, name):
            return RegressionEvaluator(labelCol=label, metricName=name).evaluate(fitted[label].transform(test))

        metrics = {
            "samples_trained": trained,
            "throughput_model": {
                "r2_score": measure("target_throughput", "r2"), "mae": measure("target_throughput", "mae"),
            },
            "resource_optimizer": {
                "cpu_r2": measure("target_cpu", "r2"), "memory_r2": measure("target_memory", "r2"),
            },
        }
        return cls(inputs, *fitted.values(), metrics)

    def transform(self, stats: DataFrame) -> DataFrame:
        """Adds predicted throughput and recommended CPU and memory."""
        rows = self.inputs.transform(process_features(stats))
        for model, name in (
            (self.throughput, "predicted_throughput"),
            (self.cpu, "recommended_cpu"),
            (self.memory, "recommended_memory"),
        ):
            rows = model.transform(rows).withColumnRenamed("prediction", name)
        return rows.drop("features", "process_type_encoded")

    def save(self, spark: SparkSession, path: str) -> None:
        parts = {"inputs": self.inputs, "throughput": self.throughput, "cpu": self.cpu, "memory": self.memory}
        for name, part in parts.items():
            part.write().overwrite().save(f"{path}/{name}")
        _save_config(spark, f"{path}/config", {"feature_columns": PROCESS_FEATURES, "training_metrics": self.metrics})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ProcessModel":
        return cls(
            PipelineModel.load(f"{path}/inputs"),
            *[GBTRegressionModel.load(f"{path}/{name}") for name in ("throughput", "cpu", "memory")],
            _load_config(spark, f"{path}/config")["training_metrics"],
        )
