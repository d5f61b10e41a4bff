"""Checks of recommendations, process advice and what-if comparisons."""

import re

from pyspark.sql import functions as F

from calltide.checks.base import check, hash01, views
from calltide.checks.inputs import cube, labelled, r6, scored
from calltide.functions.scalar import fixed
from calltide.operators import process as proc
from calltide.operators import recommend as rec
from calltide.operators import whatif
from calltide.plans import report
from calltide.sources.tables import event_calls

_SLOW_SQL = """slow AS (SELECT *, row_number() OVER ({part}ORDER BY first_id, syscall_name) AS place FROM (
    SELECT {key}syscall_name, count(*) AS count, avg(latency_us) AS avg_latency, min(syscall_id) AS first_id
    FROM scored WHERE p_high > 0.7 GROUP BY {key}syscall_name) s)"""
_REDUNDANT_SQL = """repeated AS (SELECT *, row_number() OVER ({part}ORDER BY first_id, syscall_name) AS place FROM (
    SELECT {key}syscall_name, count(*) AS count, min(syscall_id) AS first_id
    FROM scored WHERE is_redundant GROUP BY {key}syscall_name) s)"""
_COLUMNS = ("seq", "type", "syscall", "severity", "count")


def _recs_sql(key: str) -> str:
    k = f"{key}, " if key else ""
    part = f"PARTITION BY {key} " if key else ""
    group = f"GROUP BY {key}" if key else "HAVING count(*) > 0"
    return (
        views("scored", _SLOW_SQL.format(key=k, part=part), _REDUNDANT_SQL.format(key=k, part=part))
        + f""", recs AS (
        SELECT {k}CAST(place AS INT) AS seq, 'high_latency' AS type, syscall_name AS syscall, 'high' AS severity,
               count, round(avg_latency, 6) AS avg_latency,
               printf('Consider batching or caching %s calls. Average latency: %.2fμs', syscall_name, avg_latency)
                 AS recommendation FROM slow WHERE place <= 5
        UNION ALL
        SELECT {k}CAST(100 + place AS INT), 'redundancy', syscall_name, 'medium', count, NULL,
               printf('Eliminate redundant %s calls. Detected %d potentially redundant calls.', syscall_name, count)
        FROM repeated WHERE place <= 5
        UNION ALL
        SELECT {k}200, 'anomaly', NULL, 'high', count(*), NULL,
               printf('Investigate %d anomalous syscall patterns. These may indicate performance issues or bugs.',
                      count(*)) FROM scored WHERE is_anomaly {group})
        """
    )


def _shown(recs, *keys):
    return recs.select(*keys, *_COLUMNS, r6("avg_latency"), "recommendation")


@check("recommendations", _recs_sql("") + "SELECT * FROM recs")
def recommendations(spark, folder):
    return _shown(rec.recommend(cube(spark, folder)))


@check("recommendations_by_trace", _recs_sql("trace_id") + "SELECT * FROM recs")
def recommendations_by_trace(spark, folder):
    keys = ("trace_id",)
    return _shown(rec.recommend(cube(spark, folder, keys), keys), *keys)


@check("slow_recommendations", _recs_sql("") + "SELECT * FROM recs WHERE type = 'high_latency'")
def slow_recommendations(spark, folder):
    return _shown(rec.slow_recommendations(cube(spark, folder)))


@check("redundancy_recommendations", _recs_sql("") + "SELECT * FROM recs WHERE type = 'redundancy'")
def redundancy_recommendations(spark, folder):
    return _shown(rec.redundancy_recommendations(cube(spark, folder)))


@check("anomaly_recommendation", _recs_sql("") + "SELECT * FROM recs WHERE type = 'anomaly'")
def anomaly_recommendation(spark, folder):
    return _shown(rec.anomaly_recommendations(cube(spark, folder)))


@check(
    "recommendation_counts",
    _recs_sql("trace_id")
    + """SELECT severity, type, count(*) AS n, CAST(sum(count) AS BIGINT) AS affected_calls,
                CASE type WHEN 'high_latency' THEN 'High Latency Detected' WHEN 'redundancy' THEN 'Redundant Calls'
                          ELSE 'Anomalous Pattern' END AS label
         FROM recs GROUP BY 1, 2""",
)
def recommendation_counts(spark, folder):
    keys = ("trace_id",)
    return rec.recommendation_counts(rec.recommend(cube(spark, folder, keys), keys))


_STATS_SQL = """stats AS (
  SELECT pid, avg(latency_us) AS lat_mean, coalesce(stddev_samp(latency_us), 0) AS lat_std,
         sum(latency_us) AS lat_sum, max(latency_us) AS lat_max, min(latency_us) AS lat_min,
         count(*) AS syscall_count, avg(cpu_usage) AS cpu_mean, max(cpu_usage) AS cpu_max,
         avg(memory_usage) AS mem_mean, max(memory_usage) AS mem_max,
         CAST(sum(context_switches) AS BIGINT) AS ctx_sum, avg(context_switches) AS ctx_mean,
         count(*) FILTER (WHERE is_high_latency) AS high_lat_count,
         count(*) FILTER (WHERE is_redundant) AS redundant_count, avg(risk_level) AS risk_mean,
         arg_min(process_type, syscall_id) AS process_type
  FROM labelled GROUP BY pid)"""
_RATIOS_SQL = """ratios AS (
  SELECT *, syscall_count / (lat_sum + 1) AS efficiency, high_lat_count / syscall_count AS high_lat_ratio,
         redundant_count / syscall_count AS redundancy_ratio, lat_std / (lat_mean + 0.01e0) AS latency_cv FROM stats)"""
_TARGETS_SQL = f"""targets AS (
  SELECT *, 1000 / (lat_mean + 1) * (1 - high_lat_ratio) * (0.8e0 + {hash01('42', 'pid')} * 0.4e0) AS target_throughput,
         least(greatest(cpu_mean * (high_lat_ratio + 1), 10), 100) AS target_cpu,
         least(greatest(mem_mean * (redundancy_ratio * 0.5e0 + 1), 10), 100) AS target_memory FROM ratios)"""
_ADVICE_SQL = """advice AS (
  SELECT *, abs(cpu_adjustment) * 0.3e0 + abs(memory_adjustment) * 0.3e0 + high_lat_ratio * 100 * 0.4e0 AS priority_score
  FROM (SELECT *, target_cpu - cpu_mean AS cpu_adjustment, target_memory - mem_mean AS memory_adjustment
        FROM targets) t)"""
_STATS_CHAIN = views("labelled", _STATS_SQL, _RATIOS_SQL, _TARGETS_SQL, _ADVICE_SQL)


def process_scores(spark, folder):
    stats = proc.with_ratios(proc.process_stats(labelled(spark, folder)))
    return proc.score_rule(stats, noise_seed="42")


@check(
    "process_stats",
    _STATS_CHAIN
    + """SELECT pid, round(lat_mean, 6) AS lat_mean, round(lat_std, 6) AS lat_std, round(lat_sum, 6) AS lat_sum,
                round(lat_max, 6) AS lat_max, round(lat_min, 6) AS lat_min, syscall_count,
                round(cpu_mean, 6) AS cpu_mean, cpu_max, round(mem_mean, 6) AS mem_mean, mem_max, ctx_sum,
                round(ctx_mean, 6) AS ctx_mean, high_lat_count, redundant_count,
                round(risk_mean, 6) AS risk_mean, process_type FROM stats""",
)
def process_stats(spark, folder):
    out = proc.process_stats(labelled(spark, folder))
    rounded = {"lat_mean", "lat_std", "lat_sum", "lat_max", "lat_min", "cpu_mean", "mem_mean", "ctx_mean", "risk_mean"}
    return out.select(*[r6(c) if c in rounded else c for c in out.columns])


@check(
    "process_ratios",
    _STATS_CHAIN
    + """SELECT pid, round(efficiency, 6) AS efficiency, round(high_lat_ratio, 6) AS high_lat_ratio,
                round(redundancy_ratio, 6) AS redundancy_ratio, round(latency_cv, 6) AS latency_cv FROM ratios""",
)
def process_ratios(spark, folder):
    out = proc.with_ratios(proc.process_stats(labelled(spark, folder)))
    return out.select("pid", *[r6(c) for c in ("efficiency", "high_lat_ratio", "redundancy_ratio", "latency_cv")])


@check(
    "process_targets",
    _STATS_CHAIN
    + """SELECT pid, round(target_throughput, 6) AS target_throughput, round(target_cpu, 6) AS target_cpu,
                round(target_memory, 6) AS target_memory FROM targets""",
)
def process_targets(spark, folder):
    stats = proc.with_ratios(proc.process_stats(labelled(spark, folder)))
    out = proc.with_targets(stats, noise_seed="42")
    return out.select("pid", r6("target_throughput"), r6("target_cpu"), r6("target_memory"))


@check(
    "process_adjustments",
    _STATS_CHAIN
    + """SELECT pid, round(cpu_adjustment, 6) AS cpu_adjustment, round(memory_adjustment, 6) AS memory_adjustment,
                round(priority_score, 6) AS priority_score, round(least(priority_score * 10, 100), 6) AS progress
         FROM advice""",
)
def process_adjustments(spark, folder):
    out = proc.with_adjustments(process_scores(spark, folder))
    return out.select("pid", *[r6(c) for c in ("cpu_adjustment", "memory_adjustment", "priority_score", "progress")])


_ACTIONS_SQL = """concat_ws(';',
  CASE WHEN cpu_adjustment > {s} THEN printf('increase_cpu:%.4f', cpu_adjustment)
       WHEN cpu_adjustment < -{s} THEN printf('decrease_cpu:%.4f', abs(cpu_adjustment)) END,
  CASE WHEN memory_adjustment > {s} THEN printf('increase_memory:%.4f', memory_adjustment)
       WHEN memory_adjustment < -{s} THEN printf('decrease_memory:%.4f', abs(memory_adjustment)) END,
  CASE WHEN high_lat_ratio > 0.2 THEN 'priority_boost:' END,
  CASE WHEN redundancy_ratio > 0.3 THEN 'code_optimization:' END)"""


def _action_text(actions):
    value = lambda a: F.when(a["value"].isNull(), "").otherwise(fixed(a["value"], 4))
    return F.concat_ws(";", F.transform(actions, lambda a: F.concat(a["type"], F.lit(":"), value(a))))


@check(
    "scheduling_actions",
    _STATS_CHAIN
    + f"""SELECT pid, {_ACTIONS_SQL.format(s=1)} AS actions FROM advice""",
)
def scheduling_actions(spark, folder):
    advised = proc.with_actions(proc.with_adjustments(process_scores(spark, folder)), step=1)
    return advised.select("pid", _action_text("actions").alias("actions"))


@check(
    "scheduling_recommendations",
    _STATS_CHAIN
    + """SELECT pid, round(cpu_mean, 6) AS current_cpu, round(mem_mean, 6) AS current_memory,
                round(target_cpu, 6) AS recommended_cpu, round(target_memory, 6) AS recommended_memory,
                round(target_throughput, 6) AS predicted_throughput, round(priority_score, 6) AS priority_score,
                round(least(priority_score * 10, 100), 6) AS progress, """
    + _ACTIONS_SQL.format(s=10)
    + """ AS actions
         FROM advice""",
)
def scheduling_recommendations(spark, folder):
    advice = proc.schedule(process_scores(spark, folder))
    rounded = [c for c in advice.columns if c not in ("pid", "actions")]
    return advice.select("pid", *[r6(c) for c in rounded], _action_text("actions").alias("actions"))


@check(
    "first_two_actions",
    _STATS_CHAIN
    + f""", a AS (SELECT pid, string_split({_ACTIONS_SQL.format(s=0.5)}, ';') AS parts FROM advice)
         SELECT pid, array_to_string(list_slice(parts, 1, 2), ';') AS actions FROM a""",
)
def first_two_actions(spark, folder):
    advised = proc.with_actions(proc.with_adjustments(process_scores(spark, folder)), step=0.5)
    return advised.select("pid", _action_text(F.slice("actions", 1, 2)).alias("actions"))


_SIDE_SQL = """{side} AS (
  SELECT trace_id, count(*) AS {side}_calls, avg(latency_us) AS {side}_avg, max(latency_us) AS {side}_max,
         avg(cpu_usage) AS {side}_cpu, count(*) / (sum(latency_us) / 1e6) AS {side}_throughput,
         quantile_cont(latency_us, 0.5) AS {side}_p50, quantile_cont(latency_us, 0.95) AS {side}_p95,
         quantile_cont(latency_us, 0.99) AS {side}_p99
  FROM calls WHERE ts {when} TIMESTAMP '2024-01-16' GROUP BY trace_id)"""
_MEASURES = [f"{s}_{m}" for s in ("before", "after") for m in ("avg", "p50", "p95", "p99", "max", "cpu", "throughput")]


@check(
    "measured_comparison",
    views("calls", _SIDE_SQL.format(side="before", when="<"), _SIDE_SQL.format(side="after", when=">="))
    + "SELECT trace_id, before_calls, after_calls, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in _MEASURES)
    + """, round((before_avg - after_avg) / before_avg * 100, 6) AS latency_reduction,
         round((before_cpu - after_cpu) / before_cpu * 100, 6) AS cpu_savings,
         round((after_throughput - before_throughput) / before_throughput * 100, 6) AS throughput_increase
         FROM before FULL JOIN after USING (trace_id)""",
)
def measured_comparison(spark, folder):
    calls = event_calls(spark, folder)
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    out = whatif.compare(calls.filter(early), calls.filter(~early))
    changes = ("latency_reduction", "cpu_savings", "throughput_increase")
    return out.select("trace_id", "before_calls", "after_calls", *[r6(c) for c in (*_MEASURES, *changes)])


_CHANGES = ("latency_reduction", "cpu_savings", "throughput_increase")
_COMPARED_SQL = """compared AS (
  SELECT *, (before_avg - after_avg) / before_avg * 100 AS latency_reduction,
         (before_cpu - after_cpu) / before_cpu * 100 AS cpu_savings,
         (after_throughput - before_throughput) / before_throughput * 100 AS throughput_increase
  FROM before FULL JOIN after USING (trace_id))"""


def _compared(spark, folder):
    calls = event_calls(spark, folder)
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    return whatif.compare(calls.filter(early), calls.filter(~early))


@check(
    "measured_roll_up",
    views("calls", _SIDE_SQL.format(side="before", when="<"), _SIDE_SQL.format(side="after", when=">="), _COMPARED_SQL)
    + "SELECT count(*) AS compared, "
    + ", ".join(f"round(avg({c}), 6) AS avg_{c}, round(stddev_pop({c}), 6) AS std_{c}" for c in _CHANGES)
    + " FROM compared",
)
def measured_roll_up(spark, folder):
    """Changes between the halves of a month of measured calls, over all hosts."""
    out = whatif.compared_roll_up(_compared(spark, folder))
    return out.select("compared", *[r6(f"{part}_{c}") for c in _CHANGES for part in ("avg", "std")])


def _shown_sql(column: str, digits: int = 2) -> str:
    return f"printf('%.{digits}f', {column})"


@check(
    "measured_report",
    views("calls", _SIDE_SQL.format(side="before", when="<"), _SIDE_SQL.format(side="after", when=">="), _COMPARED_SQL)
    + "SELECT trace_id, "
    + "printf('"
    + re.sub(
        r"%\d+\$s", "%s", report.COMPARISON_FORMAT.replace("{title}", report.TITLE).replace("{generated}", "2024-02-01 00:00:00")
    )
    + "', trace_id, CAST(before_calls AS VARCHAR), CAST(after_calls AS VARCHAR), "
    + ", ".join(
        [_shown_sql("before_avg"), _shown_sql("after_avg"), _shown_sql("latency_reduction")]
        + [_shown_sql(f"{side}_{m}") for m in ("p50", "p95", "p99", "max") for side in ("before", "after")]
        + [_shown_sql("before_cpu", 1), _shown_sql("after_cpu", 1), _shown_sql("cpu_savings")]
        + [_shown_sql("before_throughput", 0), _shown_sql("after_throughput", 0), _shown_sql("throughput_increase")]
    )
    + ") AS content FROM compared",
)
def measured_report(spark, folder):
    return report.comparison_report(_compared(spark, folder), "2024-02-01 00:00:00")


_PROJECTED_SQL = f"""projected AS (
  SELECT *, latency_us * CASE WHEN is_high_latency THEN {hash01('42-slow', 'syscall_id')} * 0.3e0 + 0.3e0 ELSE 1.0e0 END
            * CASE WHEN is_redundant THEN 0.1e0 ELSE 1.0e0 END
            * ({hash01('42-all', 'syscall_id')} * 0.05e0 + 0.9e0) AS latency_after FROM scored)"""


def _projected(spark, folder):
    return whatif.what_if(scored(spark, folder))


@check(
    "what_if_projection",
    views("scored", _PROJECTED_SQL)
    + "SELECT syscall_id, round(latency_us, 6) AS latency_us, round(latency_after, 6) AS latency_after FROM projected",
)
def what_if_projection(spark, folder):
    return _projected(spark, folder).select("syscall_id", r6("latency_us"), r6("latency_after"))


_PROFILE_COLUMNS = ", ".join(
    f"{expr.format(c=column)} AS {phase}_{name}"
    for phase, column in (("before", "latency_us"), ("after", "latency_after"))
    for name, expr in (
        ("avg", "avg({c})"),
        ("p50", "quantile_cont({c}, 0.5)"),
        ("p95", "quantile_cont({c}, 0.95)"),
        ("p99", "quantile_cont({c}, 0.99)"),
        ("max", "max({c})"),
    )
)
_PROFILE_SQL = f"""profile AS (
  SELECT *, (before_avg - after_avg) / before_avg * 100 AS improvement
  FROM (SELECT iteration, {_PROFILE_COLUMNS} FROM projected GROUP BY iteration) p)"""
_PROFILE_NAMES = [f"{p}_{m}" for p in ("before", "after") for m in ("avg", "p50", "p95", "p99", "max")]


@check(
    "latency_profile",
    views("scored", _PROJECTED_SQL, _PROFILE_SQL)
    + "SELECT iteration, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in [*_PROFILE_NAMES, "improvement"])
    + " FROM profile",
)
def latency_profile(spark, folder):
    out = whatif.latency_profile(_projected(spark, folder))
    return out.select("iteration", *[r6(c) for c in [*_PROFILE_NAMES, "improvement"]])


@check(
    "latency_benchmark",
    views("scored", _PROJECTED_SQL, _PROFILE_SQL)
    + "SELECT count(*) AS iterations, "
    + ", ".join(f"round(avg({c}), 6) AS avg_{c}" for c in _PROFILE_NAMES)
    + """, round(avg(improvement), 6) AS avg_improvement,
         round(stddev_pop(improvement), 6) AS std_improvement FROM profile""",
)
def latency_benchmark(spark, folder):
    out = whatif.roll_up(whatif.latency_profile(_projected(spark, folder)), _PROFILE_NAMES)
    return out.select("iterations", *[r6(c) for c in out.columns if c != "iterations"])


_CPU_SQL = """cpu AS (
  SELECT *, (before_cpu - after_cpu) / before_cpu * 100 AS improvement
  FROM (SELECT iteration, avg(cpu_usage) AS before_cpu,
               avg(cpu_usage) * (1 - count(*) FILTER (WHERE p_opt > 0.5) / count(*) * 0.3e0) AS after_cpu
        FROM scored GROUP BY iteration) c)"""


@check(
    "cpu_saving",
    views("scored", _CPU_SQL)
    + """SELECT iteration, round(before_cpu, 6) AS before_cpu, round(after_cpu, 6) AS after_cpu,
                round(improvement, 6) AS improvement FROM cpu""",
)
def cpu_saving(spark, folder):
    out = whatif.cpu_saving(scored(spark, folder))
    return out.select("iteration", r6("before_cpu"), r6("after_cpu"), r6("improvement"))


@check(
    "cpu_benchmark",
    views("scored", _CPU_SQL)
    + """SELECT count(*) AS iterations, round(avg(before_cpu), 6) AS avg_before_cpu,
                round(avg(after_cpu), 6) AS avg_after_cpu, round(avg(improvement), 6) AS avg_improvement,
                round(stddev_pop(improvement), 6) AS std_improvement FROM cpu""",
)
def cpu_benchmark(spark, folder):
    out = whatif.roll_up(whatif.cpu_saving(scored(spark, folder)), ["before_cpu", "after_cpu"])
    return out.select("iterations", *[r6(c) for c in out.columns if c != "iterations"])


@check(
    "throughput_gain",
    views("scored", _PROJECTED_SQL)
    + """SELECT iteration, round(before, 6) AS before_throughput, round(after, 6) AS after_throughput,
                round((after - before) / before * 100, 6) AS improvement
         FROM (SELECT iteration, count(*) / (sum(latency_us) / 1e6) AS before,
                      count(*) / (sum(latency_after) / 1e6) AS after FROM projected GROUP BY 1) t""",
)
def throughput_gain(spark, folder):
    out = whatif.throughput_gain(_projected(spark, folder))
    return out.select("iteration", r6("before_throughput"), r6("after_throughput"), r6("improvement"))


_QUICK_SQL = """quick AS (
  SELECT iteration, before_avg_latency, before_p95_latency, before_high_latency_count, before_redundant_count,
         before_cpu_usage, before_memory_usage, before_avg_latency * f AS after_avg_latency,
         before_p95_latency * f AS after_p95_latency,
         CAST(floor(before_high_latency_count * 0.3e0) AS BIGINT) AS after_high_latency_count,
         CAST(floor(before_redundant_count * 0.4e0) AS BIGINT) AS after_redundant_count,
         before_cpu_usage * 0.85e0 AS after_cpu_usage, before_memory_usage * 0.9e0 AS after_memory_usage,
         (1 - f) * 100 AS latency_reduction,
         (before_cpu_usage - before_cpu_usage * 0.85e0) / before_cpu_usage * 100 AS cpu_savings,
         (before_memory_usage - before_memory_usage * 0.9e0) / before_memory_usage * 100 AS memory_savings,
         (1 / f - 1) * 100 AS throughput_increase
  FROM (SELECT iteration, avg(latency_us) AS before_avg_latency,
               quantile_cont(latency_us, 0.95) AS before_p95_latency,
               count(*) FILTER (WHERE is_high_latency) AS before_high_latency_count,
               count(*) FILTER (WHERE is_redundant) AS before_redundant_count,
               avg(cpu_usage) AS before_cpu_usage, avg(memory_usage) AS before_memory_usage,
               1 - count(*) FILTER (WHERE p_high > 0.5) / count(*) * 0.3e0 AS f
        FROM scored GROUP BY iteration) q)"""
_QUICK_NAMES = (
    "before_avg_latency before_p95_latency before_high_latency_count before_redundant_count before_cpu_usage "
    "before_memory_usage after_avg_latency after_p95_latency after_high_latency_count after_redundant_count "
    "after_cpu_usage after_memory_usage latency_reduction cpu_savings memory_savings throughput_increase"
).split()


@check(
    "quick_benchmark",
    views("scored", _QUICK_SQL)
    + "SELECT iteration, "
    + ", ".join(c if c.endswith("count") else f"round({c}, 6) AS {c}" for c in _QUICK_NAMES)
    + " FROM quick",
)
def quick_benchmark(spark, folder):
    out = whatif.quick_benchmark(scored(spark, folder))
    return out.select("iteration", *[c if c.endswith("count") else r6(c) for c in _QUICK_NAMES])


@check(
    "quick_benchmark_average",
    views("scored", _QUICK_SQL)
    + "SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _QUICK_NAMES[-4:]) + " FROM quick",
)
def quick_benchmark_average(spark, folder):
    out = whatif.quick_average(whatif.quick_benchmark(scored(spark, folder)))
    return out.select(*[r6(c) for c in out.columns])
