"""Checks of features and trained models."""

from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F

from calltide.checks.base import check, views
from calltide.checks.inputs import labelled, r6, scored
from calltide.operators import process as proc
from calltide.operators import sketches
from calltide.operators.aggregate import side_by_side
from calltide.operators.clusters import Clusters
from calltide.operators.features import CALL_FEATURES, PROCESS_FEATURES, call_features, process_features
from calltide.operators.isolation import IsolationForest
from calltide.operators.models import CallModel, ProcessModel, call_inputs, class_report, encoder, metrics_table
from calltide.operators.ranking import exact_auc
from calltide.plans.analysis import advise
from calltide.session import materialise, scratch_path
from calltide.sources.tables import event_calls


@check(
    "label_encoding",
    views("calls")
    + """SELECT syscall_id, CAST(dense_rank() OVER (ORDER BY syscall_name) - 1 AS DOUBLE) AS syscall_name_encoded,
                CAST(dense_rank() OVER (ORDER BY category) - 1 AS DOUBLE) AS category_encoded,
                CAST(dense_rank() OVER (ORDER BY process_type) - 1 AS DOUBLE) AS process_type_encoded FROM calls""",
)
def label_encoding(spark, folder):
    calls = event_calls(spark, folder)
    labels = ("syscall_name", "category", "process_type")
    return encoder(labels).fit(calls).transform(calls).select("syscall_id", *[f"{c}_encoded" for c in labels])


@check(
    "unseen_labels",
    views("calls")
    + """, known AS (SELECT syscall_name, row_number() OVER (ORDER BY syscall_name) - 1 AS code
                     FROM (SELECT DISTINCT syscall_name FROM calls WHERE category <> 'network') d)
         SELECT c.syscall_name, CAST(coalesce(any_value(k.code), (SELECT count(*) FROM known)) AS DOUBLE) AS code,
                count(*) AS calls
         FROM calls c LEFT JOIN known k ON k.syscall_name = c.syscall_name GROUP BY 1""",
)
def unseen_labels(spark, folder):
    calls = event_calls(spark, folder)
    fitted = encoder(("syscall_name",)).fit(calls.filter("category <> 'network'"))
    coded = fitted.transform(calls)
    return coded.groupBy("syscall_name", F.col("syscall_name_encoded").alias("code")).agg(
        F.count(F.lit(1)).alias("calls")
    )


@check(
    "call_feature_vector",
    views("labelled")
    + """SELECT syscall_id, round(latency_us, 6) AS latency_us, base_latency_us, latency_ratio,
                round(ln(1 + latency_us), 6) AS latency_log, cpu_usage, memory_usage,
                round(cpu_usage / (memory_usage + 0.1e0), 6) AS cpu_memory_ratio,
                CAST(context_switches AS DOUBLE) AS context_switches, CAST(risk_level AS DOUBLE) AS risk_level,
                round(base_latency_us / (latency_us + 0.1e0), 6) AS efficiency_score FROM labelled""",
)
def call_feature_vector(spark, folder):
    rows = call_features(labelled(spark, folder))
    rounded = {"latency_us", "latency_log", "cpu_memory_ratio", "efficiency_score"}
    plain = [c for c in CALL_FEATURES if not c.endswith("_encoded")]
    return rows.select("syscall_id", *[r6(c) if c in rounded else c for c in plain])


# Columns of the process vector and, in SQL, what they are of a process's calls.
_PROCESS_SQL = {
    "lat_mean": "avg(latency_us)",
    "lat_std": "coalesce(stddev_samp(latency_us), 0)",
    "lat_max": "max(latency_us)",
    "syscall_count": "count(*)",
    "cpu_mean": "avg(cpu_usage)",
    "cpu_max": "max(cpu_usage)",
    "mem_mean": "avg(memory_usage)",
    "mem_max": "max(memory_usage)",
    "ctx_sum": "sum(context_switches)",
    "high_lat_count": "count(*) FILTER (WHERE is_high_latency)",
    "redundant_count": "count(*) FILTER (WHERE is_redundant)",
    "risk_mean": "avg(risk_level)",
    "efficiency": "count(*) / (sum(latency_us) + 1)",
    "high_lat_ratio": "count(*) FILTER (WHERE is_high_latency) / count(*)",
    "redundancy_ratio": "count(*) FILTER (WHERE is_redundant) / count(*)",
    "latency_cv": "coalesce(stddev_samp(latency_us), 0) / (avg(latency_us) + 0.01e0)",
}


@check(
    "process_feature_vector",
    views("labelled")
    + """, types AS (SELECT pid, arg_min(process_type, syscall_id) AS process_type FROM labelled GROUP BY pid),
         codes AS (SELECT pid, CAST(dense_rank() OVER (ORDER BY process_type) - 1 AS DOUBLE) AS process_type_encoded FROM types)
         SELECT pid, any_value(process_type_encoded) AS process_type_encoded, """
    + ", ".join(f"round(CAST({sql} AS DOUBLE), 6) AS {name}" for name, sql in _PROCESS_SQL.items())
    + " FROM labelled JOIN codes USING (pid) GROUP BY pid",
)
def process_feature_vector(spark, folder):
    """All 17 columns, as the regressors get them."""
    rows = process_features(proc.with_ratios(proc.process_stats(labelled(spark, folder))))
    coded = encoder(("process_type",)).fit(rows).transform(rows)
    assert [c for c in PROCESS_FEATURES if c not in (*_PROCESS_SQL, "process_type_encoded")] == []
    return coded.select("pid", "process_type_encoded", *[r6(c) for c in _PROCESS_SQL])


_SCALED = ("latency_us", "base_latency_us", "latency_ratio", "cpu_usage", "memory_usage", "context_switches", "risk_level")


@check(
    "standardised_features",
    views("labelled")
    + ", m AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _SCALED)
    + " FROM labelled) SELECT syscall_id, "
    + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in _SCALED)
    + " FROM labelled, m",
)
def standardised_features(spark, folder):
    """The columns that the models learn from, by the pipeline that they use."""
    rows = call_features(labelled(spark, folder))
    scaled = call_inputs().fit(rows).transform(rows)
    return scaled.select("syscall_id", *[r6(c, f"scaled_{c}") for c in _SCALED])


@check(
    "class_report",
    views("scored")
    + """, p AS (SELECT CAST(needs_optimization AS INT) AS label, CAST(p_high AS INT) AS guess FROM scored),
         n AS (SELECT label, count(*) AS support, count(*) FILTER (WHERE label = guess) AS hits FROM p GROUP BY 1),
         g AS (SELECT guess, count(*) AS guessed FROM p GROUP BY 1)
         SELECT label, round(hits / guessed, 6) AS precision, round(hits / support, 6) AS recall,
                round(2 * (hits / guessed) * (hits / support) / (hits / guessed + hits / support), 6) AS f1, support
         FROM n JOIN g ON g.guess = n.label""",
)
def class_report_query(spark, folder):
    rows = scored(spark, folder)
    out = class_report(rows, "needs_optimization", "high_latency_probability")
    return out.select("label", r6("precision"), r6("recall"), r6("f1"), "support")


@check(
    "exact_auc",
    views("labelled")
    + """, r AS (SELECT trace_id, latency_ratio AS score, needs_optimization AS hit,
                      rank() OVER (PARTITION BY trace_id ORDER BY latency_ratio) AS low,
                      count(*) OVER (PARTITION BY trace_id, latency_ratio) AS ties FROM labelled)
         SELECT trace_id, round((sum(low + (ties - 1) / 2) FILTER (WHERE hit)
                  - (count(*) FILTER (WHERE hit)) * (count(*) FILTER (WHERE hit) + 1) / 2)
                / ((count(*) FILTER (WHERE hit)) * (count(*) FILTER (WHERE NOT hit))), 9) AS auc,
                count(*) FILTER (WHERE hit) AS positives, count(*) FILTER (WHERE NOT hit) AS negatives
         FROM r GROUP BY 1""",
)
def exact_auc_query(spark, folder):
    out = exact_auc(labelled(spark, folder), "latency_ratio", "needs_optimization", ("trace_id",))
    return out.select("trace_id", F.round("auc", 9).alias("auc"), "positives", "negatives")


_CENTRES = ((1.0, 20.0), (2.0, 40.0), (5.0, 60.0), (20.0, 80.0), (60.0, 10.0))


@check(
    "nearest_centres",
    views("labelled")
    + ", c(number, a, b) AS (VALUES "
    + ", ".join(f"({i}, {a}e0, {b}e0)" for i, (a, b) in enumerate(_CENTRES))
    + """), d AS (SELECT syscall_id, number, (latency_us - a) ** 2 + (cpu_usage - b) ** 2 AS far FROM labelled, c)
         SELECT syscall_id, CAST(arg_min(number, {'far': far, 'number': number}) AS INT) AS pattern_cluster FROM d GROUP BY 1""",
)
def nearest_centres(spark, folder):
    """Every call's nearest of five given centres, as fitted models tell it."""
    clusters = Clusters(("latency_us", "cpu_usage"), np.array(_CENTRES), 0.0, ())
    return labelled(spark, folder).select("syscall_id", clusters.nearest().alias("pattern_cluster"))


@check(
    "distinct_processes",
    views("labelled")
    + """, g AS (SELECT 'all' AS grain, '' AS name, count(DISTINCT pid) AS n FROM labelled
                 UNION ALL SELECT 'trace', trace_id, count(DISTINCT pid) FROM labelled GROUP BY trace_id
                 UNION ALL SELECT 'category', category, count(DISTINCT pid) FROM labelled GROUP BY category)
         SELECT grain, name, n AS processes, true AS sketch_is_near FROM g""",
)
def distinct_processes(spark, folder):
    """Distinct processes per category, trace and in all: counted, and from one cube of sketches."""
    calls = event_calls(spark, folder)
    cube = materialise(sketches.sketch_cube(calls, ("trace_id", "category"), ("latency_us",), ("pid",)), "sketches")
    out = None
    for grain, keys in (("all", ()), ("trace", ("trace_id",)), ("category", ("category",))):
        near = sketches.read_out(sketches.roll_up(cube, keys))
        counted = calls.groupBy(*keys).agg(F.count_distinct("pid").alias("processes"))
        both = near.join(counted, list(keys)) if keys else side_by_side(near, counted)
        # Six standard errors.
        is_near = F.abs(F.col("pid_distinct") - F.col("processes")) <= F.greatest(F.col("processes") * 0.05, F.lit(0.5))
        name = F.col(keys[0]) if keys else F.lit("")
        rows = both.select(F.lit(grain).alias("grain"), name.alias("name"), "processes", is_near.alias("sketch_is_near"))
        out = rows if out is None else out.unionByName(rows)
    return out


_SHARES = {"p50": 0.5, "p95": 0.95}


@check(
    "sketched_percentiles",
    views("labelled") + "SELECT trace_id, count(*) AS calls, true AS p50_is_near, true AS p95_is_near FROM labelled GROUP BY 1",
)
def sketched_percentiles(spark, folder):
    """Percentiles of the month from the sketches of its days: within 1 % of the wanted rank."""
    calls = event_calls(spark, folder).withColumn("day", F.to_date("ts"))
    days = materialise(sketches.sketch_cube(calls, ("trace_id", "day"), distinct=()), "sketches")
    months = sketches.read_out(sketches.roll_up(days, ("trace_id",)), _SHARES)
    held = calls.join(months, "trace_id").groupBy("trace_id", "n")
    below = lambda name: F.avg((F.col("latency_us") < F.col(f"latency_us_{name}")).cast("double"))
    upto = lambda name: F.avg((F.col("latency_us") <= F.col(f"latency_us_{name}")).cast("double"))
    near = [
        ((below(name) <= share + 0.01) & (upto(name) >= share - 0.01)).alias(f"{name}_is_near")
        for name, share in _SHARES.items()
    ]
    return held.agg(*near).select("trace_id", F.col("n").alias("calls"), *[f"{name}_is_near" for name in _SHARES])


@lru_cache(maxsize=1)
def _call_model(application: str, spark, folder) -> CallModel:
    """A model of the full sizes, trained once for the checks that look at it."""
    return CallModel.fit(labelled(spark, folder))


@lru_cache(maxsize=1)
def _process_stats(application: str, spark, folder):
    """Statistics of the processes, written once for the model and the checks that look at them."""
    return materialise(proc.with_ratios(proc.process_stats(labelled(spark, folder))), "stats")


@lru_cache(maxsize=1)
def _process_model(application: str, spark, folder) -> ProcessModel:
    return ProcessModel.fit(_process_stats(application, spark, folder))


@check("call_model_scores")
def call_model_scores(spark, folder):
    """Scores by models that have been saved and loaded again."""
    model = _call_model(spark.sparkContext.applicationId, spark, folder)
    path = scratch_path(spark, "model")
    model.save(spark, path)
    return CallModel.load(spark, path).transform(labelled(spark, folder)).select(
        "syscall_id", "high_latency_probability", "optimization_probability", "anomaly_score",
        "pattern_cluster", "is_anomaly", "optimization_priority",
    )


@check("call_model_metrics")
def call_model_metrics(spark, folder):
    return metrics_table(spark, _call_model(spark.sparkContext.applicationId, spark, folder).metrics)


@check(
    "slow_calls_found",
    views("labelled") + "SELECT is_high_latency, count(*) AS calls, true AS agrees FROM labelled GROUP BY 1",
)
def slow_calls_found(spark, folder):
    """The trained classifier against the labels: of either kind at most one call in two hundred is wrong."""
    model = _call_model(spark.sparkContext.applicationId, spark, folder)
    rows = model.transform(labelled(spark, folder))
    right = (F.col("high_latency_probability") > 0.5) == F.col("is_high_latency")
    return rows.groupBy("is_high_latency").agg(
        F.count(F.lit(1)).alias("calls"), (F.avg(right.cast("double")) >= 0.995).alias("agrees")
    )


@check(
    "anomalies_by_score",
    views("labelled") + "SELECT count(*) AS calls, true AS share_is_near FROM labelled",
)
def anomalies_by_score(spark, folder):
    """The share of anomalies is near the contamination that the forest is told (5 %)."""
    model = _call_model(spark.sparkContext.applicationId, spark, folder)
    share = F.avg(F.col("is_anomaly").cast("double"))
    return model.transform(labelled(spark, folder)).agg(
        F.count(F.lit(1)).alias("calls"), share.between(0.04, 0.06).alias("share_is_near")
    )


@check(
    "process_targets_met",
    views("labelled") + "SELECT count(DISTINCT pid) AS processes, true AS cpu_is_near, true AS memory_is_near FROM labelled",
)
def process_targets_met(spark, folder):
    """Recommended shares of the trained model lie near the rule's: R squared over 0.62 and 0.51."""
    application = spark.sparkContext.applicationId
    stats, model = _process_stats(application, spark, folder), _process_model(application, spark, folder)
    rows = model.transform(proc.with_targets(stats))
    fit = lambda guess, truth: 1 - F.try_divide(
        F.sum((F.col(truth) - F.col(guess)) ** 2), F.var_pop(truth) * F.count(F.lit(1))
    )
    return rows.agg(
        F.count(F.lit(1)).alias("processes"),
        (fit("recommended_cpu", "target_cpu") > 0.62).alias("cpu_is_near"),
        (fit("recommended_memory", "target_memory") > 0.51).alias("memory_is_near"),
    )


@check("isolation_scores")
def isolation_scores(spark, folder):
    features = ("latency_us", "latency_ratio", "cpu_usage", "memory_usage", "risk_level")
    rows = materialise(call_features(labelled(spark, folder)).select("syscall_id", *features), "features")
    forest = IsolationForest.fit(rows, features, "syscall_id")
    score = rows.select("syscall_id", forest.score().alias("anomaly_score"))
    return score.withColumn("is_anomaly", F.col("anomaly_score") < 0)


@check("process_model_advice")
def process_model_advice(spark, folder):
    calls = labelled(spark, folder)
    model = _process_model(spark.sparkContext.applicationId, spark, folder)
    path = scratch_path(spark, "model")
    model.save(spark, path)
    return advise(calls, ProcessModel.load(spark, path))
