"""End-to-end plans: labelled calls to analyses, one row or table per grain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltide.operators import aggregate as agg
from calltide.operators.process import process_keys, process_stats, schedule, score_rule, with_ratios
from calltide.operators.recommend import recommend
from calltide.operators.score import RuleModel
from calltide.session import materialise


def _cube(scored: DataFrame, keys, stage: bool) -> DataFrame:
    """The cube, written out so that its many readers do not scan the calls again."""
    cube = agg.call_cube(scored, keys)
    return materialise(cube, "cube") if stage else cube


def analyze(
    calls: DataFrame,
    model=None,
    keys: tuple[str, ...] = (),
    stage: bool = True,
    latencies: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Scores labelled calls and returns the tables of an analysis.

    Every table but the percentiles is a roll-up of the small staged cube, so
    the calls are read twice: for the cube and for the percentiles.
    """
    model = RuleModel.fit(calls) if model is None else model
    scored = model.transform(calls)
    cube = _cube(scored, keys, stage)
    return {
        "scored": scored,
        "cube": cube,
        "summary": agg.summary(scored, cube, keys, latencies=latencies),
        "by_syscall": agg.by_syscall(cube, keys),
        "by_category": agg.by_category(cube, keys),
        "by_cluster": agg.by_cluster(cube, keys),
        "recommendations": recommend(cube, keys),
    }


def advise(calls: DataFrame, model=None, keys: tuple[str, ...] | None = None) -> DataFrame:
    """Scheduling advice per process; without a model by rule. Processes are told
    apart by (trace_id, pid) unless ``keys`` says otherwise."""
    stats = with_ratios(process_stats(calls, process_keys(calls) if keys is None else keys))
    return schedule(score_rule(stats) if model is None else model.transform(stats))


def _as_map(df: DataFrame, keys, name: str, fields: list[str], alias: str) -> DataFrame:
    entry = F.struct(F.col(name).cast("string"), F.struct(*fields))
    entries = F.array_sort(F.collect_list(entry))
    return df.groupBy(*keys).agg(F.map_from_entries(entries).alias(alias))


def trace_analyses(
    scored: DataFrame,
    keys: tuple[str, ...] = ("trace_id",),
    stats: DataFrame | None = None,
    stage: bool = True,
) -> DataFrame:
    """One row per key: the summary with its breakdowns as maps and the
    recommendations as an array. All collected groups are bounded (categories,
    clusters, ten call names, eleven recommendations)."""
    keys_list = list(keys)
    cube = _cube(scored, keys, stage)
    top10 = agg.top(agg.by_syscall(cube, keys), 10, "optimization_priority", "syscall_name", keys)
    names = cube.groupBy(*keys, "syscall_name").agg(F.sum("n").alias("count"))
    top15 = agg.top(names, 15, "count", "syscall_name", keys)
    histogram = F.map_from_entries(F.array_sort(F.collect_list(F.struct("syscall_name", "count"))))
    recs = (
        recommend(cube, keys)
        .groupBy(*keys)
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("seq", "type", "syscall", "severity", "count", "avg_latency", "recommendation")
                )
            ).alias("recommendations")
        )
    )
    targets = _as_map(
        top10, keys, "syscall_name", ["optimization_priority", "latency_us", "count"], "top_optimization_targets"
    )
    clusters = _as_map(
        agg.by_cluster(cube, keys),
        keys,
        "pattern_cluster",
        ["dominant_syscall", "latency_us", "optimization_priority", "count"],
        "pattern_clusters",
    )
    categories = _as_map(
        agg.by_category(cube, keys),
        keys,
        "category",
        ["avg_latency", "total_latency", "count", "high_lat_prob", "opt_prob"],
        "category_breakdown",
    )
    out = (
        agg.summary(scored, cube, keys)
        .join(targets, keys_list, "left")
        .join(clusters, keys_list, "left")
        .join(categories, keys_list, "left")
        .join(top15.groupBy(*keys).agg(histogram.alias("syscall_summary")), keys_list, "left")
        .join(recs, keys_list, "left")
    )
    return out if stats is None else out.join(stats, keys_list, "left")
