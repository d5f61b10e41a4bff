"""Per-process statistics and scheduling advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltide.functions.scalar import clip, process_priority, progress, uniform


def process_keys(df: DataFrame) -> tuple[str, ...]:
    """What tells processes apart: the pid within its trace, where traces are known."""
    return tuple(k for k in ("trace_id", "pid") if k in df.columns)


def process_stats(calls: DataFrame, keys: tuple[str, ...] = ("pid",)) -> DataFrame:
    """One row per process. All measures combine map-side, so a process with a
    third of all calls costs one partial row per task.

    Calls without a key belong to no process. A trace has no process types and
    no ratios of its own: such a process is of type ``unknown``. The first known
    type is that of the smallest call number, over traces that of the first trace.
    """
    if "process_type" not in calls.columns:
        calls = calls.withColumn("process_type", F.lit(None).cast("string"))
    for key in keys:
        calls = calls.filter(F.col(key).isNotNull())
    place = F.struct(*[F.col(k) for k in ("trace_id", "syscall_id") if k in calls.columns])
    return calls.groupBy(*keys).agg(
        F.avg("latency_us").alias("lat_mean"),
        F.coalesce(F.stddev_samp("latency_us"), F.lit(0.0)).alias("lat_std"),
        F.sum("latency_us").alias("lat_sum"),
        F.max("latency_us").alias("lat_max"),
        F.min("latency_us").alias("lat_min"),
        F.count("latency_us").alias("syscall_count"),
        F.avg("cpu_usage").alias("cpu_mean"),
        F.max("cpu_usage").alias("cpu_max"),
        F.avg("memory_usage").alias("mem_mean"),
        F.max("memory_usage").alias("mem_max"),
        F.sum("context_switches").alias("ctx_sum"),
        F.avg("context_switches").alias("ctx_mean"),
        F.count_if("is_high_latency").alias("high_lat_count"),
        F.count_if("is_redundant").alias("redundant_count"),
        F.avg("risk_level").alias("risk_mean"),
        F.coalesce(
            F.min_by("process_type", F.when(F.col("process_type").isNotNull(), place)),
            F.lit("unknown"),
        ).alias("process_type"),
    )


def with_ratios(stats: DataFrame) -> DataFrame:
    n = F.col("syscall_count")
    return (
        stats.withColumn("efficiency", n / (F.col("lat_sum") + 1))
        .withColumn("high_lat_ratio", F.try_divide("high_lat_count", n))
        .withColumn("redundancy_ratio", F.try_divide("redundant_count", n))
        .withColumn("latency_cv", F.col("lat_std") / (F.col("lat_mean") + 0.01))
    )


def throughput_target(noise: Column | None = None) -> Column:
    """Calls per millisecond at mean latency, less the slow share."""
    target = F.lit(1000.0) / (F.col("lat_mean") + 1) * (1 - F.col("high_lat_ratio"))
    return target if noise is None else target * noise


def with_targets(stats: DataFrame, noise_seed: str | None = None, *key: str) -> DataFrame:
    """What a process should get; the noise is a hash of its key (the pid, unless named), or off."""
    noise = None if noise_seed is None else F.lit(0.8) + uniform(noise_seed, *(key or ("pid",))) * 0.4
    return (
        stats.withColumn("target_throughput", throughput_target(noise))
        .withColumn(
            "target_cpu", clip(F.col("cpu_mean") * (F.col("high_lat_ratio") + 1), 10, 100)
        )
        .withColumn(
            "target_memory",
            clip(F.col("mem_mean") * (F.col("redundancy_ratio") * 0.5 + 1), 10, 100),
        )
    )


def score_rule(stats: DataFrame, noise_seed: str | None = None) -> DataFrame:
    """Recommended shares by rule: the targets themselves."""
    return (
        with_targets(stats, noise_seed)
        .withColumnRenamed("target_throughput", "predicted_throughput")
        .withColumnRenamed("target_cpu", "recommended_cpu")
        .withColumnRenamed("target_memory", "recommended_memory")
    )


def with_adjustments(scored: DataFrame) -> DataFrame:
    return (
        scored.withColumn("cpu_adjustment", F.col("recommended_cpu") - F.col("cpu_mean"))
        .withColumn("memory_adjustment", F.col("recommended_memory") - F.col("mem_mean"))
        .withColumn(
            "priority_score",
            process_priority(
                F.col("cpu_adjustment"), F.col("memory_adjustment"), F.col("high_lat_ratio")
            ),
        )
        .withColumn("progress", progress(F.col("priority_score")))
    )


# Action types with their reasons.
REASONS = {
    "increase_cpu": "Process is CPU-constrained with high latency calls",
    "decrease_cpu": "Process is over-allocated on CPU resources",
    "increase_memory": "Process has high redundancy, may benefit from caching",
    "decrease_memory": "Process is over-allocated on memory resources",
    "priority_boost": "High latency ratio suggests process may benefit from higher priority",
    "code_optimization": "High redundancy suggests code-level optimization opportunities",
}


def _action(kind: str, when: Column, value: Column | None = None) -> Column:
    value = F.lit(None) if value is None else value
    return F.when(
        when,
        F.struct(
            F.lit(kind).alias("type"),
            value.cast("double").alias("value"),
            F.lit(REASONS[kind]).alias("reason"),
        ),
    )


def with_actions(adjusted: DataFrame, step: float = 10) -> DataFrame:
    cpu, memory = F.col("cpu_adjustment"), F.col("memory_adjustment")
    return adjusted.withColumn(
        "actions",
        F.array_compact(
            F.array(
                _action("increase_cpu", cpu > step, cpu),
                _action("decrease_cpu", cpu < -step, F.abs(cpu)),
                _action("increase_memory", memory > step, memory),
                _action("decrease_memory", memory < -step, F.abs(memory)),
                _action("priority_boost", F.col("high_lat_ratio") > 0.2),
                _action("code_optimization", F.col("redundancy_ratio") > 0.3),
            )
        ),
    )


def schedule(scored_processes: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """Scheduling advice per process, most urgent first, those of unknown urgency last.

    What is not known of a process, as CPU and memory of a bare trace, stays null:
    no share is recommended and no action derived from it.
    """
    keys = process_keys(scored_processes) if keys is None else keys
    advised = with_actions(with_adjustments(scored_processes))
    return advised.select(
        *keys,
        F.col("cpu_mean").alias("current_cpu"),
        F.col("mem_mean").alias("current_memory"),
        "recommended_cpu",
        "recommended_memory",
        "predicted_throughput",
        "priority_score",
        "progress",
        "actions",
    ).orderBy(F.desc("priority_score"), *keys)
