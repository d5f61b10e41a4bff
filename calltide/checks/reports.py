"""Checks of metric joins, the process tree, reports and history."""

from pyspark.sql import functions as F

from calltide.checks.advice import _CPU_SQL, _PROFILE_SQL, _PROJECTED_SQL, _projected, _recs_sql, process_scores
from calltide.checks.advice import _ADVICE_SQL, _PROFILE_NAMES, _RATIOS_SQL, _STATS_SQL, _TARGETS_SQL
from calltide.checks.base import check, views
from calltide.checks.inputs import cube, labelled, r6, scored
from calltide.operators import process as proc
from calltide.operators import whatif
from calltide.operators.aggregate import call_cube, summary
from calltide.operators.metrics import attach_metrics
from calltide.operators.recommend import recommend
from calltide.operators.tree import child_counts, depths
from calltide.plans import history as hist
from calltide.plans import report
from calltide.plans.analysis import trace_analyses
from calltide.plans.sinks import read_csv, read_json, write_csv, write_json
from calltide.session import materialise, scratch_path
from calltide.sources.tables import event_calls, table

GENERATED = "2024-02-01 00:00:00"


@check(
    "host_metrics_as_of",
    """WITH c AS (SELECT event_id, user_id AS pid, ts FROM events WHERE event_type <> 'view'),
            s AS (SELECT user_id AS pid, ts, value AS cpu, event_id AS sample_id FROM events WHERE event_type = 'view')
       SELECT c.event_id, s.cpu, s.sample_id
       FROM c ASOF LEFT JOIN s ON c.pid = s.pid AND c.ts >= s.ts""",
)
def host_metrics_as_of(spark, folder):
    events = table(spark, folder, "events").withColumnRenamed("user_id", "pid")
    calls = events.filter("event_type <> 'view'").select("event_id", "pid", "ts")
    samples = events.filter("event_type = 'view'").select(
        "pid", "ts", F.col("value").alias("cpu"), F.col("event_id").alias("sample_id")
    )
    return attach_metrics(calls, samples).select("event_id", "cpu", "sample_id")


_TREE_SQL = """p AS (SELECT c_custkey AS pid, CASE WHEN c_custkey % 50 = 7 THEN 0 ELSE c_custkey // 3 END AS ppid,
                            'host-1' AS hostname FROM customer)"""


def _processes(spark, folder):
    pid = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        pid.alias("pid"),
        F.when(pid % 50 == 7, 0).otherwise(F.expr("c_custkey div 3")).cast("long").alias("ppid"),
        F.lit("host-1").alias("hostname"),
    )


@check(
    "process_children",
    f"""WITH {_TREE_SQL}
        SELECT p.pid, p.ppid, count(c.pid) AS children FROM p
        LEFT JOIN p c ON c.ppid = p.pid AND c.pid <> c.ppid GROUP BY 1, 2""",
)
def process_children(spark, folder):
    return child_counts(_processes(spark, folder)).select("pid", "ppid", "children")


@check(
    "process_depth",
    f"""WITH RECURSIVE {_TREE_SQL},
        d AS (SELECT pid, 0 AS depth FROM p
              WHERE pid = ppid OR NOT EXISTS (SELECT 1 FROM p q WHERE q.pid = p.ppid)
              UNION ALL
              SELECT p.pid, d.depth + 1 FROM p JOIN d ON p.ppid = d.pid WHERE p.pid <> p.ppid)
        SELECT pid, depth FROM d""",
)
def process_depth(spark, folder):
    return depths(_processes(spark, folder)).select("pid", "depth")


_FAMILY_VALUES = ", ".join(
    f"('{n}', '{family}')" for family, (names, _) in report.FAMILIES.items() for n in names.split()
)


@check(
    "remediation_families",
    _recs_sql("trace_id")
    + f""", fam(syscall, family) AS (VALUES {_FAMILY_VALUES})
          SELECT r.trace_id, r.seq, r.syscall, coalesce(f.family, 'manual_review') AS family
          FROM recs r LEFT JOIN fam f ON f.syscall = r.syscall""",
)
def remediation_families(spark, folder):
    keys = ("trace_id",)
    return report.with_remediation(recommend(cube(spark, folder, keys), keys)).select(
        "trace_id", "seq", "syscall", "family"
    )


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_RULE_VALUES = ", ".join(
    f"({_q(n)}, {_q(commands)})" for names, commands in report.FAMILIES.values() for n in names.split()
)
_SUMMARY_SQL = """SELECT trace_id, count(*) AS total_syscalls, count(*) FILTER (WHERE p_high > 0.5) AS high_latency_count,
    count(*) FILTER (WHERE p_opt > 0.5) AS optimization_candidates, count(*) FILTER (WHERE is_anomaly) AS anomalies_detected,
    avg(latency_us) AS avg_latency, quantile_cont(latency_us, 0.95) AS p95_latency
  FROM scored GROUP BY trace_id"""


def _section_sql(number: int) -> str:
    body = f"string_agg(piece, chr(10) ORDER BY seq) FILTER (WHERE section = {number})"
    return f"{_q(report.section_head(number))} || chr(10) || {body}"


_SECTIONS_SQL = (
    f""", rules(syscall, commands) AS (VALUES {_RULE_VALUES}),
      s AS ({_SUMMARY_SQL}),
      pieces AS (
        SELECT r.trace_id, r.seq,
               CASE type WHEN 'high_latency' THEN 1 WHEN 'redundancy' THEN 2 ELSE 4 END AS section,
               CASE type
                 WHEN 'high_latency' THEN printf({_q(report.SLOW_FORMAT)}, r.syscall, r.count, printf('%.2f', avg_latency), recommendation,
                   replace(coalesce(u.commands, {_q(report.MANUAL_REVIEW)}), '{{syscall}}', r.syscall))
                 WHEN 'redundancy' THEN printf('# %s: %d redundant calls detected' || chr(10) || '# %s' || chr(10)
                   || 'echo "  ℹ %s: %d redundant calls to optimize in application code"' || chr(10),
                   r.syscall, r.count, recommendation, r.syscall, r.count)
                 ELSE printf('# %s' || chr(10)
                   || 'echo "  ⚠ %d anomalous patterns detected - manual investigation recommended"' || chr(10),
                   recommendation, r.count) END AS piece
        FROM recs r LEFT JOIN rules u ON u.syscall = r.syscall),
      sections AS (SELECT trace_id, {_section_sql(1)} AS s1, {_section_sql(2)} AS s2, {_section_sql(4)} AS s4
                   FROM pieces GROUP BY trace_id)"""
)


@check(
    "tuning_script",
    _recs_sql("trace_id")
    + _SECTIONS_SQL
    + f"""
      SELECT s.trace_id, concat_ws(chr(10), {_q(report.SCRIPT_HEAD.format(title=report.TITLE, generated=GENERATED))},
               printf({_q(report.SUMMARY_FORMAT)}, total_syscalls, high_latency_count, optimization_candidates,
                      anomalies_detected, printf('%.2f', avg_latency)), s1, s2, s4, {_q(report.SCRIPT_TAIL)}) AS content
      FROM s LEFT JOIN sections x ON x.trace_id = s.trace_id""",
)
def tuning_script(spark, folder):
    rows, keys = scored(spark, folder), ("trace_id",)
    calls_cube = call_cube(rows, keys)
    return report.script(summary(rows, calls_cube, keys), recommend(calls_cube, keys), GENERATED)


_LINES_SQL = (
    f""", lines AS (
        SELECT pid, priority_score, concat_ws(chr(10), printf('# PID %d (Priority: %.2f)', pid, priority_score),
          CASE WHEN cpu_adjustment > 10 THEN concat_ws(chr(10), {_q('# Reason: ' + proc.REASONS['increase_cpu'])},
                 printf('# Consider: taskset or cpuset to pin PID %d to more cores', pid),
                 printf('echo "  ℹ PID %d: Consider CPU affinity adjustment"', pid))
               WHEN cpu_adjustment < -10 THEN concat_ws(chr(10), {_q('# Reason: ' + proc.REASONS['decrease_cpu'])},
                 printf('# Consider: cgroups to limit CPU for PID %d', pid),
                 printf('echo "  ℹ PID %d: Consider CPU limit via cgroups"', pid)) END,
          CASE WHEN high_lat_ratio > 0.2 THEN concat_ws(chr(10), {_q('# Reason: ' + proc.REASONS['priority_boost'])},
                 printf('# sudo renice -5 -p %d', pid),
                 printf('echo "  ℹ PID %d: Consider priority boost (renice)"', pid)) END,
          CASE WHEN redundancy_ratio > 0.3 THEN concat_ws(chr(10), {_q('# Reason: ' + proc.REASONS['code_optimization'])},
                 printf('echo "  ℹ PID %d: Code-level optimization recommended"', pid)) END, '') AS piece
        FROM advice)"""
)


@check(
    "resource_script",
    views("labelled", _STATS_SQL, _RATIOS_SQL, _TARGETS_SQL, _ADVICE_SQL)
    + _LINES_SQL
    + f"""
      SELECT pid // 50 AS part, {_q(report.section_head(3))} || chr(10)
             || string_agg(piece, chr(10) ORDER BY priority_score DESC, pid) AS content
      FROM lines GROUP BY 1""",
)
def resource_script(spark, folder):
    advised = proc.with_actions(proc.with_adjustments(process_scores(spark, folder)))
    return report.resource_script(advised, pids_per_part=50)


@check(
    "whole_scripts",
    _recs_sql("trace_id")
    + ",\n"
    + ",\n".join([_STATS_SQL, _RATIOS_SQL, _TARGETS_SQL, _ADVICE_SQL])
    + _SECTIONS_SQL
    + _LINES_SQL
    + f""", ranked AS (
        SELECT concat('host-', pid % 8) AS trace_id, piece,
               row_number() OVER (PARTITION BY pid % 8 ORDER BY priority_score DESC, pid) - 1 AS place FROM lines),
      parts AS (
        SELECT trace_id, 0 AS section, 0 AS part,
               concat_ws(chr(10), {_q(report.SCRIPT_HEAD.format(title=report.TITLE, generated=GENERATED))},
                 printf({_q(report.SUMMARY_FORMAT)}, total_syscalls, high_latency_count, optimization_candidates,
                        anomalies_detected, printf('%.2f', avg_latency))) AS content FROM s
        UNION ALL SELECT trace_id, 1, 0, s1 FROM sections
        UNION ALL SELECT trace_id, 2, 0, s2 FROM sections
        UNION ALL SELECT trace_id, 3, 0, {_q(report.section_head(3))} FROM s
        UNION ALL SELECT trace_id, 3, place // 7 + 1, string_agg(piece, chr(10) ORDER BY place) FROM ranked GROUP BY 1, 2, 3
        UNION ALL SELECT trace_id, 4, 0, s4 FROM sections
        UNION ALL SELECT trace_id, 5, 0, {_q(report.SCRIPT_TAIL)} FROM s)
      SELECT trace_id, section, CAST(part AS BIGINT) AS part, content FROM parts WHERE content IS NOT NULL""",
)
def whole_scripts(spark, folder):
    """Every line of every trace's script, the resources of its processes included."""
    rows, keys = scored(spark, folder), ("trace_id",)
    calls_cube = call_cube(rows, keys)
    stats = proc.with_ratios(proc.process_stats(labelled(spark, folder), ("trace_id", "pid")))
    advised = proc.with_actions(proc.with_adjustments(proc.score_rule(stats, noise_seed="42")))
    totals = summary(rows, calls_cube, keys, latencies=event_calls(spark, folder))
    return report.script_parts(totals, recommend(calls_cube, keys), advised, GENERATED, keys, per_part=7)


def _analyses(spark, folder):
    return trace_analyses(scored(spark, folder))


@check(
    "json_report",
    _recs_sql("trace_id")
    + f""", s AS ({_SUMMARY_SQL}),
      r AS (SELECT trace_id, count(*) AS n_recs, min(seq) AS first_seq, max(seq) AS last_seq,
                   arg_min(recommendation, seq) AS first_text FROM recs GROUP BY 1),
      c AS (SELECT trace_id, count(*) AS categories, sum(n) AS category_calls FROM (
              SELECT trace_id, category, count(*) AS n FROM scored GROUP BY 1, 2) k GROUP BY 1)
      SELECT s.trace_id, total_syscalls, high_latency_count, round(avg_latency, 6) AS avg_latency,
             round(p95_latency, 6) AS p95_latency, n_recs, first_text, categories,
             CAST(category_calls AS BIGINT) AS category_calls
      FROM s JOIN r ON r.trace_id = s.trace_id JOIN c ON c.trace_id = s.trace_id""",
)
def json_report(spark, folder):
    documents = report.json_report(_analyses(spark, folder), GENERATED)
    parsed = F.from_json(
        "content",
        """metadata struct<generated_at string>,
           analysis struct<total_syscalls bigint, high_latency_count bigint, avg_latency double, p95_latency double,
                           category_breakdown map<string, struct<count bigint>>>,
           recommendations array<struct<recommendation string>>""",
    )
    d = documents.select("trace_id", parsed.alias("d"))
    calls = F.transform(F.map_values("d.analysis.category_breakdown"), lambda v: v["count"])
    return d.select(
        "trace_id",
        "d.analysis.total_syscalls",
        "d.analysis.high_latency_count",
        r6("avg_latency", "d.analysis.avg_latency"),
        r6("p95_latency", "d.analysis.p95_latency"),
        F.size("d.recommendations").alias("n_recs"),
        F.col("d.recommendations")[0]["recommendation"].alias("first_text"),
        F.size("d.analysis.category_breakdown").alias("categories"),
        F.aggregate(calls, F.lit(0).cast("long"), lambda a, v: a + v).alias("category_calls"),
    )


@check(
    "markdown_report",
    _recs_sql("trace_id")
    + f""", s AS ({_SUMMARY_SQL}),
      items AS (
        SELECT trace_id, seq, concat_ws(chr(10),
                 printf('### %d. %s %s' || chr(10), row_number() OVER (PARTITION BY trace_id ORDER BY seq),
                   CASE severity WHEN 'high' THEN '🔴' WHEN 'medium' THEN '🟡' ELSE '🟢' END,
                   CASE type WHEN 'high_latency' THEN 'High Latency' WHEN 'redundancy' THEN 'Redundancy' ELSE 'Anomaly' END),
                 printf('- **Severity:** %s', severity),
                 CASE WHEN syscall IS NOT NULL THEN printf('- **Syscall:** `%s`', syscall) END,
                 printf('- **Affected Calls:** %d', count),
                 CASE WHEN avg_latency IS NOT NULL THEN printf('- **Avg Latency:** %.2f μs', avg_latency) END,
                 printf('- **Action:** %s' || chr(10), recommendation)) AS item FROM recs),
      b AS (SELECT trace_id, string_agg(item, chr(10) ORDER BY seq) AS body FROM items GROUP BY 1)
      SELECT s.trace_id, concat_ws(chr(10),
               {_q(f'# {report.TITLE} Report' + chr(10) + chr(10) + f'**Generated:** {GENERATED}' + chr(10))},
               printf({_q(report._SUMMARY_TABLE)}, total_syscalls, high_latency_count, optimization_candidates,
                      anomalies_detected, printf('%.2f', avg_latency), printf('%.2f', p95_latency)),
               CASE WHEN body IS NOT NULL THEN {_q('## Recommendations' + chr(10))} END, coalesce(body, '')) AS content
      FROM s LEFT JOIN b ON b.trace_id = s.trace_id""",
)
def markdown_report(spark, folder):
    return report.markdown_report(_analyses(spark, folder), GENERATED)


@check(
    "benchmark_report",
    views("scored", _PROJECTED_SQL, _PROFILE_SQL, _CPU_SQL)
    + """, thr AS (SELECT *, (after - before) / before * 100 AS improvement FROM (
             SELECT iteration, count(*) / (sum(latency_us) / 1e6) AS before,
                    count(*) / (sum(latency_after) / 1e6) AS after FROM projected GROUP BY 1) t)
         SELECT (SELECT count(*) FROM profile) AS iterations,
                (SELECT round(avg(improvement), 6) FROM profile) AS latency,
                (SELECT round(avg(improvement), 6) FROM cpu) AS cpu,
                (SELECT round(avg(improvement), 6) FROM thr) AS throughput,
                printf('| Latency Reduction | %.2f%% |', (SELECT avg(improvement) FROM profile)) AS line""",
)
def benchmark_report(spark, folder):
    projected = _projected(spark, folder)
    out = report.benchmark_report(
        whatif.roll_up(whatif.latency_profile(projected), _PROFILE_NAMES),
        whatif.roll_up(whatif.cpu_saving(projected), ["before_cpu", "after_cpu"]),
        whatif.roll_up(whatif.throughput_gain(projected), ["before_throughput", "after_throughput"]),
        2000,
        GENERATED,
    )
    parsed = F.from_json(
        "json",
        """configuration struct<iterations bigint>, summary struct<avg_latency_improvement double,
           avg_cpu_savings double, avg_throughput_increase double>""",
    )
    return out.select(parsed.alias("d"), "markdown").select(
        "d.configuration.iterations",
        r6("latency", "d.summary.avg_latency_improvement"),
        r6("cpu", "d.summary.avg_cpu_savings"),
        r6("throughput", "d.summary.avg_throughput_increase"),
        F.regexp_extract("markdown", r"(?m)^(\| Latency Reduction .*)$", 1).alias("line"),
    )


_DAYS_SQL = """daily AS (
  SELECT pid AS user_id, concat('day-', strftime(ts, '%Y%m%d')) AS trace_id,
         CASE WHEN pid % 2 = 0 THEN 'file' ELSE 'live' END AS source_type, count(*) AS total_syscalls,
         count(*) FILTER (WHERE p_high > 0.5) AS high_latency, max(ts) AS created_at
  FROM scored GROUP BY ALL)"""


def _daily_history(spark, folder, writes: int = 2) -> str:
    """History of one analysis per user and day, appended twice to a new table."""
    rows = scored(spark, folder).withColumnRenamed("pid", "user_id").withColumn(
        "trace_id", F.concat(F.lit("day-"), F.date_format("ts", "yyyyMMdd"))
    )
    # Read for the cube, twice for the percentiles and for the times: labelled once.
    rows = materialise(rows, "scored")
    keys = ("user_id", "trace_id")
    analyses = materialise(
        trace_analyses(rows, keys).join(rows.groupBy(*keys).agg(F.max("ts").alias("_at")), list(keys)),
        "analyses",
    )
    path = scratch_path(spark, "history")
    made = F.col("_at")
    even = analyses.filter("user_id % 2 = 0")
    odd = analyses.filter("user_id % 2 <> 0")
    hist.append(hist.analysis_rows(even, "file", made), path)
    hist.append(hist.analysis_rows(odd, "live", made), path)
    if writes > 1:
        hist.append(hist.analysis_rows(odd, "live", made), path)
    return path


@check(
    "history_table",
    views("scored", _DAYS_SQL)
    + """SELECT user_id, trace_id, strftime(created_at, '%b %d, %Y %H:%M') AS date,
                concat(CASE source_type WHEN 'file' THEN 'FileUpload_' ELSE 'LiveTrace_' END, trace_id) AS title,
                CASE source_type WHEN 'file' THEN 'File' ELSE 'Live' END AS type,
                total_syscalls AS syscalls, high_latency FROM daily""",
)
def history_table(spark, folder):
    return hist.history_table(hist.history(spark, _daily_history(spark, folder)))


@check(
    "history_search",
    views("scored", _DAYS_SQL)
    + """SELECT user_id, trace_id, total_syscalls AS syscalls FROM daily
         WHERE source_type = 'file' AND created_at >= TIMESTAMP '2024-01-15' AND contains(trace_id, '0124')""",
)
def history_search(spark, folder):
    rows = hist.history(spark, _daily_history(spark, folder, 1), since="2024-01-15")
    return hist.history_table(rows, source_type="file", search="FILEupload_day-20240124").select(
        "user_id", "trace_id", "syscalls"
    )


@check(
    "latest_analyses",
    views("scored", _DAYS_SQL)
    + """SELECT user_id, trace_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC) AS INT) AS place
         FROM daily QUALIFY place <= 10""",
)
def latest_analyses(spark, folder):
    rows = hist.history(spark, _daily_history(spark, folder, 1))
    return hist.latest_per_user(rows, 10).select("user_id", "trace_id", "place")


@check(
    "history_counts",
    views("scored", _DAYS_SQL) + "SELECT user_id, source_type, count(*) AS analyses FROM daily GROUP BY 1, 2",
)
def history_counts(spark, folder):
    return hist.history_counts(hist.history(spark, _daily_history(spark, folder)), by_source=True)


@check(
    "export_history",
    views("scored")
    + f""", s AS ({_SUMMARY_SQL})
         SELECT 7 AS user_id, trace_id, export_format, filename, total_syscalls
         FROM s, (VALUES ('json', 'report_20240201_000000.json'), ('markdown', 'report_20240201_000000.md'))
                 f(export_format, filename)""",
)
def export_history(spark, folder):
    analyses = _analyses(spark, folder)
    made = F.to_timestamp(F.lit(GENERATED))
    path = scratch_path(spark, "exports")
    texts = {
        "json": report.json_report(analyses, GENERATED),
        "markdown": report.markdown_report(analyses, GENERATED),
    }
    for kind, text in texts.items():
        hist.append(hist.export_rows(text.withColumn("user_id", F.lit(7)), kind, made), path)
    number = F.coalesce(
        F.get_json_object("content", "$.analysis.total_syscalls"),
        F.regexp_extract("content", r"\| Total Syscalls \| (\d+) \|", 1),
    )
    latest = hist.latest_per_user(hist.exports(spark, path), 100, "filename")
    return latest.select("user_id", "trace_id", "export_format", "filename", number.cast("long").alias("total_syscalls"))


# The columns that a sink has to give back, whole rows of them.
_SUNK = (
    "trace_id", "syscall_id", "pid", "syscall_name", "category", "base_latency_us", "latency_ratio", "cpu_usage",
    "memory_usage", "context_switches", "return_value", "risk_level", "is_redundant", "is_high_latency", "needs_optimization",
)
_SUNK_SQL = views("labelled") + f"SELECT {', '.join(_SUNK)}, round(latency_us, 6) AS latency_us FROM labelled"


@check("csv_sink", _SUNK_SQL)
def csv_sink(spark, folder):
    path = scratch_path(spark, "csv")
    write_csv(labelled(spark, folder), path)
    return read_csv(spark, path).select(*_SUNK, r6("latency_us"))


@check("json_sink", _SUNK_SQL)
def json_sink(spark, folder):
    path = scratch_path(spark, "json")
    write_json(labelled(spark, folder), path)
    return read_json(spark, path).select(*_SUNK, r6("latency_us"))
