"""Summaries of scored calls.

One pass folds the calls to a cube of (keys, call name, category, cluster);
every report grain is a roll-up of that cube. Its size is bounded by names x
clusters per key, so the 100 TB table is shuffled only as partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltide.operators.quantiles import quantiles

CUBE_GRAIN = ("syscall_name", "category", "pattern_cluster")
LIKELY = 0.5
RECOMMEND = 0.7


def _sum_if(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value))


def call_cube(scored: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    p_high, p_opt = F.col("high_latency_probability"), F.col("optimization_probability")
    slow = p_high > RECOMMEND
    return scored.groupBy(*keys, *CUBE_GRAIN).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("latency_us").alias("latency_sum"),
        F.sum("optimization_priority").alias("priority_sum"),
        F.sum(p_high).alias("p_high_sum"),
        F.sum(p_opt).alias("p_opt_sum"),
        F.count_if(p_high > LIKELY).alias("n_likely_high"),
        F.count_if(p_opt > LIKELY).alias("n_likely_opt"),
        F.count_if("is_anomaly").alias("n_anomaly"),
        F.sum("cpu_usage").alias("cpu_sum"),
        F.count("cpu_usage").alias("cpu_n"),
        F.sum("memory_usage").alias("memory_sum"),
        F.count("memory_usage").alias("memory_n"),
        F.count_if(slow).alias("n_slow"),
        _sum_if(slow, F.col("latency_us")).alias("slow_latency_sum"),
        F.min(F.when(slow, F.col("syscall_id"))).alias("slow_first"),
        F.count_if("is_redundant").alias("n_redundant"),
        F.min(F.when(F.col("is_redundant"), F.col("syscall_id"))).alias("redundant_first"),
        F.count_if("is_high_latency").alias("n_flag_high"),
        F.count_if("needs_optimization").alias("n_flag_opt"),
    )


def _mean(total: str, count: str) -> Column:
    return F.try_divide(F.sum(total), F.sum(count))


def summary(
    scored: DataFrame,
    cube: DataFrame,
    keys: tuple[str, ...] = (),
    approx: bool = False,
    latencies: DataFrame | None = None,
) -> DataFrame:
    """Counts, means and latency percentiles.

    The percentiles read the latencies of all calls once more: of ``latencies``, calls before
    labelling and scoring, if it is given, so that no label is worked out again for them.
    """
    totals = cube.groupBy(*keys).agg(
        F.sum("n").alias("total_syscalls"),
        F.sum("n_likely_high").alias("high_latency_count"),
        F.sum("n_likely_opt").alias("optimization_candidates"),
        F.sum("n_anomaly").alias("anomalies_detected"),
        _mean("latency_sum", "n").alias("avg_latency"),
        _mean("cpu_sum", "cpu_n").alias("cpu_avg"),
        _mean("memory_sum", "memory_n").alias("memory_avg"),
    )
    bare = scored if latencies is None else latencies
    tails = quantiles(bare, "latency_us", {"p95_latency": 0.95, "p99_latency": 0.99}, keys, approx)
    if keys:
        return totals.join(tails, list(keys), "left")
    return side_by_side(totals, tails)


def side_by_side(*rows: DataFrame) -> DataFrame:
    """The columns of several one-row tables in one row, without a join."""
    stacked = rows[0]
    for row in rows[1:]:
        stacked = stacked.unionByName(row, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def by_syscall(cube: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return cube.groupBy(*keys, "syscall_name").agg(
        _mean("priority_sum", "n").alias("optimization_priority"),
        _mean("latency_sum", "n").alias("latency_us"),
        F.sum("n").alias("count"),
    )


def by_category(cube: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return cube.groupBy(*keys, "category").agg(
        _mean("latency_sum", "n").alias("avg_latency"),
        F.sum("latency_sum").alias("total_latency"),
        F.sum("n").alias("count"),
        _mean("p_high_sum", "n").alias("high_lat_prob"),
        _mean("p_opt_sum", "n").alias("opt_prob"),
    )


def by_cluster(cube: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per cluster: its commonest call (the smaller name on ties) and means."""
    names = cube.groupBy(*keys, "pattern_cluster", "syscall_name").agg(
        F.sum("n").alias("n"),
        F.sum("latency_sum").alias("latency_sum"),
        F.sum("priority_sum").alias("priority_sum"),
    )
    return names.groupBy(*keys, "pattern_cluster").agg(
        F.min_by("syscall_name", F.struct(-F.col("n"), F.col("syscall_name"))).alias("dominant_syscall"),
        _mean("latency_sum", "n").alias("latency_us"),
        _mean("priority_sum", "n").alias("optimization_priority"),
        F.sum("n").alias("count"),
    )


def top(df: DataFrame, k: int, by: str, tie: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The k largest rows per key; ties go to the smaller ``tie``."""
    if not keys:
        return df.orderBy(F.desc(by), tie).limit(k)
    order = Window.partitionBy(*keys).orderBy(F.desc(by), tie)
    return df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k).drop("_rank")


def value_counts(calls: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    known = calls.filter(F.col(column).isNotNull())
    return known.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("count"))


def flag_counts(calls: DataFrame, flag: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per call name: how many carry the flag, their mean latency, first one seen."""
    marked = F.col(flag)
    return (
        calls.groupBy(*keys, "syscall_name")
        .agg(
            F.count_if(marked).alias("count"),
            F.avg(F.when(marked, F.col("latency_us"))).alias("avg_latency"),
            F.min(F.when(marked, F.col("syscall_id"))).alias("first_id"),
        )
        .filter(F.col("count") > 0)
    )


def first_offenders(calls: DataFrame, flag: str, k: int = 5) -> DataFrame:
    """The first k distinct names that carry the flag, in the order first seen."""
    return flag_counts(calls, flag).orderBy("first_id", "syscall_name").limit(k)


def dataset_summary(calls: DataFrame, approx: bool = False) -> DataFrame:
    distinct = (
        F.approx_count_distinct("syscall_name") if approx else F.count_distinct("syscall_name")
    )
    flags = ("is_high_latency", "is_redundant", "needs_optimization")
    return calls.agg(
        F.count(F.lit(1)).alias("total_syscalls"),
        distinct.alias("unique_syscalls"),
        *[F.count_if(f).alias(f"{f}_count") for f in flags],
        *[F.avg(F.col(f).cast("double")).alias(f"{f}_rate") for f in flags],
        F.avg("latency_us").alias("avg_latency"),
    )


def dashboard_kpis(summary_rows: DataFrame) -> DataFrame:
    """Headline figures; ``throughput`` counts calls per second at mean latency."""
    safe = lambda c: F.when(F.coalesce(F.col(c), F.lit(0.0)) == 0, 1.0).otherwise(F.col(c))
    return summary_rows.select(
        *[c for c in summary_rows.columns if c in ("trace_id", "pid")],
        F.round("avg_latency", 2).alias("avg_latency"),
        F.round("cpu_avg", 1).alias("cpu_usage"),
        F.floor(F.lit(1000000.0) / safe("avg_latency") + 0.5).alias("throughput"),
        F.col("optimization_candidates"),
        F.round((1 - F.col("avg_latency") / safe("p95_latency")) * 100, 1).alias("below_p95_pct"),
        F.round(100 - F.col("cpu_avg"), 1).alias("cpu_available_pct"),
    )


def category_chart(categories: DataFrame) -> DataFrame:
    return categories.select(
        *[c for c in categories.columns if c in ("trace_id", "pid")],
        "category",
        F.coalesce("avg_latency", F.lit(0.0)).alias("avg_latency"),
        (F.coalesce("opt_prob", F.lit(0.0)) * 100).alias("optimization_potential"),
    )
