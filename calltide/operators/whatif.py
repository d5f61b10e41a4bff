"""What-if projection of the recommendations and before/after comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltide.functions.scalar import uniform
from calltide.operators.quantiles import quantiles

_PROFILE = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def what_if(calls: DataFrame, seed: str = "42", key: tuple[str, ...] = ("syscall_id",)) -> DataFrame:
    """Adds ``latency_after``: slow calls at 30-60 % of their latency, redundant
    ones at 10 %, all at 90-95 %. The factors are hashes of the call's key."""
    slow = F.when(F.col("is_high_latency"), uniform(f"{seed}-slow", *key) * 0.3 + 0.3).otherwise(1.0)
    repeated = F.when(F.col("is_redundant"), 0.1).otherwise(1.0)
    general = uniform(f"{seed}-all", *key) * 0.05 + 0.9
    return calls.withColumn("latency_after", F.col("latency_us") * slow * repeated * general)


def _gain(before: Column, after: Column) -> Column:
    return F.try_divide(before - after, before) * 100


def latency_profile(projected: DataFrame, by: str = "iteration") -> DataFrame:
    """Mean, percentiles and maximum before and after, per iteration."""
    phases = projected.select(
        by,
        F.explode(
            F.array(
                F.struct(F.lit("before").alias("phase"), F.col("latency_us").alias("latency")),
                F.struct(F.lit("after").alias("phase"), F.col("latency_after").alias("latency")),
            )
        ).alias("p"),
    ).select(by, "p.phase", "p.latency")
    plain = phases.groupBy(by, "phase").agg(F.avg("latency").alias("avg"), F.max("latency").alias("max"))
    ranked = quantiles(phases, "latency", _PROFILE, (by, "phase"))
    both = plain.join(ranked, [by, "phase"])
    measures = ("avg", "p50", "p95", "p99", "max")
    wide = both.groupBy(by).agg(
        *[
            F.max(F.when(F.col("phase") == phase, F.col(m))).alias(f"{phase}_{m}")
            for phase in ("before", "after")
            for m in measures
        ]
    )
    return wide.withColumn("improvement", _gain(F.col("before_avg"), F.col("after_avg")))


def compare(before: DataFrame, after: DataFrame, by: tuple[str, ...] = ("trace_id",)) -> DataFrame:
    """Two measured traces side by side, per key: calls, latency profile, CPU and
    calls per second of latency, and the changes in percent.

    Nothing is projected: both sides are calls that were traced. A key that only one
    side has keeps nulls on the other; a change from zero or to an unknown is null.
    """
    sides = []
    for name, calls in (("before", before), ("after", after)):
        plain = calls.groupBy(*by).agg(
            F.count(F.lit(1)).alias(f"{name}_calls"),
            F.avg("latency_us").alias(f"{name}_avg"),
            F.max("latency_us").alias(f"{name}_max"),
            F.avg("cpu_usage").alias(f"{name}_cpu"),
            F.try_divide(F.count("latency_us"), F.sum("latency_us") / 1e6).alias(f"{name}_throughput"),
        )
        ranked = quantiles(calls, "latency_us", {f"{name}_{p}": q for p, q in _PROFILE.items()}, by)
        sides.append(plain.join(ranked, list(by), "left"))
    both = sides[0].join(sides[1], list(by), "full")
    change = lambda m: F.try_divide(F.col(f"after_{m}") - F.col(f"before_{m}"), F.col(f"before_{m}")) * 100
    return both.withColumns(
        {
            "latency_reduction": _gain(F.col("before_avg"), F.col("after_avg")),
            "cpu_savings": _gain(F.col("before_cpu"), F.col("after_cpu")),
            "throughput_increase": change("throughput"),
        }
    )


def compared_roll_up(compared: DataFrame) -> DataFrame:
    """Over all compared keys that have both sides: how many, mean and population spread of every change."""
    changes = ("latency_reduction", "cpu_savings", "throughput_increase")
    both = compared.filter(F.col("before_calls").isNotNull() & F.col("after_calls").isNotNull())
    return both.agg(
        F.count(F.lit(1)).alias("compared"),
        *[F.avg(c).alias(f"avg_{c}") for c in changes],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in changes],
    )


def cpu_saving(scored: DataFrame, by: str = "iteration") -> DataFrame:
    """CPU share left when the candidates are handled."""
    per = scored.groupBy(by).agg(
        F.avg("cpu_usage").alias("before_cpu"),
        (F.count_if(F.col("optimization_probability") > 0.5) / F.count(F.lit(1))).alias("_share"),
    )
    return (
        per.withColumn("after_cpu", F.col("before_cpu") * (1 - F.col("_share") * 0.3))
        .withColumn("improvement", _gain(F.col("before_cpu"), F.col("after_cpu")))
        .drop("_share")
    )


def throughput_gain(projected: DataFrame, by: str = "iteration") -> DataFrame:
    """Calls per second before and after."""
    per = projected.groupBy(by).agg(
        F.try_divide(F.count(F.lit(1)), F.sum("latency_us") / 1e6).alias("before_throughput"),
        F.try_divide(F.count(F.lit(1)), F.sum("latency_after") / 1e6).alias("after_throughput"),
    )
    change = F.col("after_throughput") - F.col("before_throughput")
    return per.withColumn("improvement", F.try_divide(change, F.col("before_throughput")) * 100)


def roll_up(per_iteration: DataFrame, measures: list[str]) -> DataFrame:
    """Means over the iterations and the population spread of the improvement."""
    return per_iteration.agg(
        F.count(F.lit(1)).alias("iterations"),
        *[F.avg(m).alias(f"avg_{m}") for m in measures],
        F.avg("improvement").alias("avg_improvement"),
        F.stddev_pop("improvement").alias("std_improvement"),
    )


def quick_benchmark(scored: DataFrame, by: str = "iteration") -> DataFrame:
    """Before/after figures of one iteration from its flags alone."""
    plain = scored.groupBy(by).agg(
        F.avg("latency_us").alias("before_avg_latency"),
        F.count_if("is_high_latency").alias("before_high_latency_count"),
        F.count_if("is_redundant").alias("before_redundant_count"),
        F.avg("cpu_usage").alias("before_cpu_usage"),
        F.avg("memory_usage").alias("before_memory_usage"),
        (
            F.lit(1.0)
            - F.count_if(F.col("high_latency_probability") > 0.5) / F.count(F.lit(1)) * 0.3
        ).alias("_factor"),
    )
    tails = quantiles(scored, "latency_us", {"before_p95_latency": 0.95}, (by,))
    rows = plain.join(tails, by)
    factor = F.col("_factor")
    return (
        rows.withColumn("after_avg_latency", F.col("before_avg_latency") * factor)
        .withColumn("after_p95_latency", F.col("before_p95_latency") * factor)
        .withColumn(
            "after_high_latency_count", F.floor(F.col("before_high_latency_count") * 0.3).cast("long")
        )
        .withColumn("after_redundant_count", F.floor(F.col("before_redundant_count") * 0.4).cast("long"))
        .withColumn("after_cpu_usage", F.col("before_cpu_usage") * 0.85)
        .withColumn("after_memory_usage", F.col("before_memory_usage") * 0.9)
        .withColumn("latency_reduction", (1 - factor) * 100)
        .withColumn("cpu_savings", _gain(F.col("before_cpu_usage"), F.col("after_cpu_usage")))
        .withColumn("memory_savings", _gain(F.col("before_memory_usage"), F.col("after_memory_usage")))
        .withColumn("throughput_increase", (F.lit(1.0) / factor - 1) * 100)
        .drop("_factor")
    )


def quick_average(per_iteration: DataFrame) -> DataFrame:
    names = ("latency_reduction", "cpu_savings", "memory_savings", "throughput_increase")
    return per_iteration.agg(*[F.avg(n).alias(n) for n in names])
