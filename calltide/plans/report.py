"""Reports as text: tuning script, JSON and Markdown, one row per trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.functions.scalar import fixed, severity_icon, type_title
from calltide.operators.aggregate import side_by_side
from calltide.operators.chunks import rank_rows

TITLE = "System Call Optimization"

# Call families with tuning commands. {syscall} stands for the call.
FAMILIES = {
    "io": (
        "read write pread64 pwrite64",
        """# Tune I/O scheduler for better {syscall} performance
if [ -f /sys/block/sda/queue/scheduler ]; then
    echo "deadline" | sudo tee /sys/block/sda/queue/scheduler
    echo "  ✓ I/O scheduler set to deadline"
fi

# Increase read-ahead buffer
if [ -f /sys/block/sda/queue/read_ahead_kb ]; then
    echo 256 | sudo tee /sys/block/sda/queue/read_ahead_kb
    echo "  ✓ Read-ahead buffer increased to 256KB"
fi
""",
    ),
    "memory": (
        "mmap munmap mprotect brk",
        """# Tune memory management for better performance
sudo sysctl -w vm.swappiness=10
echo "  ✓ Swappiness reduced to 10"

# Enable transparent huge pages for large allocations
if [ -f /sys/kernel/mm/transparent_hugepage/enabled ]; then
    echo "madvise" | sudo tee /sys/kernel/mm/transparent_hugepage/enabled
    echo "  ✓ Transparent huge pages set to madvise"
fi
""",
    ),
    "network": (
        "connect accept socket bind",
        """# Tune network stack for better performance
sudo sysctl -w net.core.somaxconn=65535
sudo sysctl -w net.ipv4.tcp_max_syn_backlog=65535
sudo sysctl -w net.core.netdev_max_backlog=65535
echo "  ✓ Network backlog buffers increased"

# Enable TCP Fast Open
sudo sysctl -w net.ipv4.tcp_fastopen=3
echo "  ✓ TCP Fast Open enabled"
""",
    ),
    "sync": (
        "epoll_wait poll select futex",
        """# Tune synchronization primitives
sudo sysctl -w kernel.sched_min_granularity_ns=1000000
sudo sysctl -w kernel.sched_wakeup_granularity_ns=1500000
echo "  ✓ Scheduler granularity tuned"
""",
    ),
    "process": (
        "fork clone execve vfork",
        """# Tune process creation performance
sudo sysctl -w kernel.pid_max=4194304
sudo sysctl -w kernel.threads-max=256000
echo "  ✓ Process limits increased"
""",
    ),
}
MANUAL_REVIEW = """echo "  ⚠ Manual review needed for {syscall} optimization"
"""

# Frame of the script.
RULE = "# ============================================="
SCRIPT_HEAD = """#!/bin/bash
#
# {title} Script
# Generated: {generated}
# WARNING: Review all commands before executing!
#
# Usage: chmod +x optimize.sh && sudo ./optimize.sh
#

set -euo pipefail

echo "=========================================="
echo "  {title} Script"
echo "=========================================="
echo ""
"""
# Fixed value: lines of the script.
SUMMARY_FORMAT = """# === Analysis Summary ===
# Total syscalls analyzed: %d
# High latency calls: %d
# Optimization candidates: %d
# Anomalies detected: %d
# Average latency: %s μs
"""
SECTION_HEADS = {
    1: ("1. HIGH LATENCY SYSCALL OPTIMIZATIONS", "[1/4] Applying high-latency optimizations..."),
    2: ("2. REDUNDANCY REDUCTION", "[2/4] Addressing redundant syscall patterns..."),
    3: ("3. RESOURCE ALLOCATION RECOMMENDATIONS", "[3/4] Applying resource allocation changes..."),
    4: ("4. ANOMALY INVESTIGATION", "[4/4] Investigating anomalous patterns..."),
}
SCRIPT_TAIL = f"""{RULE}
# SYSTEM-WIDE OPTIMIZATIONS
{RULE}

echo ""
echo "Applying system-wide optimizations..."

# Increase file descriptor limits
ulimit -n 65535 2>/dev/null || echo "  ⚠ Could not increase file descriptor limit"

# Enable TCP keepalive tuning
sudo sysctl -w net.ipv4.tcp_keepalive_time=60 2>/dev/null
sudo sysctl -w net.ipv4.tcp_keepalive_intvl=10 2>/dev/null
sudo sysctl -w net.ipv4.tcp_keepalive_probes=6 2>/dev/null
echo "  ✓ TCP keepalive tuned"

# Optimize virtual memory
sudo sysctl -w vm.dirty_ratio=10 2>/dev/null
sudo sysctl -w vm.dirty_background_ratio=5 2>/dev/null
echo "  ✓ Virtual memory settings optimized"

echo ""
echo "=========================================="
echo "  Optimization Complete!"
echo "=========================================="
echo "  Re-run strace analysis to measure improvement."
"""
# Fixed value: lines of the script.
SLOW_FORMAT = """# Syscall: %s
# Issue: %d calls with avg latency %s μs
# Recommendation: %s
%s"""
# Fixed value: lines of the script.
REDUNDANT_FORMAT = """# %1$s: %2$d redundant calls detected
# %3$s
echo "  ℹ %1$s: %2$d redundant calls to optimize in application code"
"""
# Fixed value: lines of the script.
ANOMALY_FORMAT = """# %1$s
echo "  ⚠ %2$d anomalous patterns detected - manual investigation recommended"
"""
# Script lines of a process action; memory actions have none.
ACTION_FORMATS = {
    "increase_cpu": """# Reason: %2$s
# Consider: taskset or cpuset to pin PID %1$d to more cores
echo "  ℹ PID %1$d: Consider CPU affinity adjustment\"""",
    "decrease_cpu": """# Reason: %2$s
# Consider: cgroups to limit CPU for PID %1$d
echo "  ℹ PID %1$d: Consider CPU limit via cgroups\"""",
    "priority_boost": """# Reason: %2$s
# sudo renice -5 -p %1$d
echo "  ℹ PID %1$d: Consider priority boost (renice)\"""",
    "code_optimization": """# Reason: %2$s
echo "  ℹ PID %1$d: Code-level optimization recommended\"""",
}


def _two(column: str) -> Column:
    return fixed(F.col(column), 2)


def _whole(column: str) -> Column:
    return F.bround(column, 0).cast("long").cast("string")


def remediation_rules(spark: SparkSession) -> DataFrame:
    """(syscall, family, commands): 20 rows."""
    rows = [
        (name, family, commands)
        for family, (names, commands) in FAMILIES.items()
        for name in names.split()
    ]
    values = ", ".join("(" + ", ".join("'" + v.replace("'", "\\'") + "'" for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(syscall, family, commands)")


def with_remediation(recommendations: DataFrame) -> DataFrame:
    """Adds the tuning family and its commands; calls outside the families are for review."""
    rules = remediation_rules(recommendations.sparkSession)
    joined = recommendations.join(F.broadcast(rules), "syscall", "left")
    commands = F.coalesce("commands", F.lit(MANUAL_REVIEW))
    return joined.withColumn("family", F.coalesce("family", F.lit("manual_review"))).withColumn(
        "commands", F.replace(commands, F.lit("{syscall}"), F.coalesce("syscall", F.lit("unknown")))
    )


def section_head(section: int) -> str:
    title, note = SECTION_HEADS[section]
    return f'{RULE}\n# {title}\n{RULE}\n\necho "{note}"\n'


def _piece(kind: Column) -> Column:
    return (
        F.when(
            kind == "high_latency",
            F.format_string(SLOW_FORMAT, "syscall", "count", _two("avg_latency"), "recommendation", "commands"),
        )
        .when(kind == "redundancy", F.format_string(REDUNDANT_FORMAT, "syscall", "count", "recommendation"))
        .otherwise(F.format_string(ANOMALY_FORMAT, "recommendation", "count"))
    )


def _blocks(
    summaries: DataFrame, recommendations: DataFrame, generated: str, keys: tuple[str, ...]
) -> DataFrame:
    """Per trace the parts of the script that have a bounded size, by section; null where a section is empty."""
    kind = F.col("type")
    section = F.when(kind == "high_latency", 1).when(kind == "redundancy", 2).otherwise(4)
    pieces = (
        with_remediation(recommendations)
        .groupBy(*keys)
        .agg(
            F.array_sort(
                F.collect_list(F.struct("seq", section.alias("section"), _piece(kind).alias("text")))
            ).alias("_pieces")
        )
    )
    numbers = ("total_syscalls", "high_latency_count", "optimization_candidates", "anomalies_detected")

    def block(number: int) -> Column:
        mine = F.filter("_pieces", lambda p: p["section"] == number)
        body = F.concat_ws("\n", F.transform(mine, lambda p: p["text"]))
        return F.when(F.size(mine) > 0, F.concat_ws("\n", F.lit(section_head(number)), body))

    head = F.concat_ws(
        "\n",
        F.lit(SCRIPT_HEAD.format(title=TITLE, generated=generated)),
        F.format_string(SUMMARY_FORMAT, *numbers, _two("avg_latency")),
    )
    blocks = {0: head, 1: block(1), 2: block(2), 4: block(4), 5: F.lit(SCRIPT_TAIL)}
    joined = summaries.join(pieces, list(keys), "left")
    return joined.select(*keys, *[text.alias(f"_section{number}") for number, text in blocks.items()])


def script(
    summaries: DataFrame, recommendations: DataFrame, generated: str, keys: tuple[str, ...] = ("trace_id",)
) -> DataFrame:
    """One tuning script per trace from its summary and (at most eleven) recommendations.

    The section of processes grows with the trace: :func:`script_parts` has it too.
    """
    blocks = _blocks(summaries, recommendations, generated, keys)
    content = F.concat_ws("\n", *[c for c in blocks.columns if c not in keys])
    return blocks.select(*keys, content.alias("content"))


def script_parts(
    summaries: DataFrame,
    recommendations: DataFrame,
    advice: DataFrame,
    generated: str,
    keys: tuple[str, ...] = ("trace_id",),
    per_part: int = 1000,
) -> DataFrame:
    """The whole script of every trace, the resources of its processes included, as ordered parts:
    keys, section, part, content.

    Section 3 lists the processes of a trace, most urgent first, ``per_part`` in a part: a place
    among a trace's processes comes from range partitions (``rank_rows``), so neither a task nor a
    text holds more than a part, however many processes a trace has. Traces without advice have no section 3.
    """
    blocks = _blocks(summaries, recommendations, generated, keys)
    numbers = [c for c in blocks.columns if c not in keys]
    entry = F.explode(
        F.array(*[F.struct(F.lit(int(c[-1])).alias("section"), F.col(c).alias("content")) for c in numbers])
    )
    fixed_parts = blocks.select(*keys, entry.alias("_e")).select(
        *keys, "_e.section", F.lit(0).cast("long").alias("part"), "_e.content"
    )
    # Processes without a priority come last.
    urgency = F.coalesce(-F.col("priority_score"), F.lit(float("inf")))
    listed = advice.select(*keys, "pid", urgency.alias("_urgency"), _process_text().alias("_text"))
    placed = rank_rows(listed, keys, ("_urgency", "pid"), "_place")
    parts = (
        placed.withColumn("part", F.expr(f"_place div {int(per_part)} + 1"))
        .groupBy(*keys, "part")
        .agg(F.array_sort(F.collect_list(F.struct("_place", "_text"))).alias("_pieces"))
        .select(*keys, "part", F.concat_ws("\n", F.transform("_pieces", lambda p: p["_text"])).alias("content"))
    )
    # Only traces that have a summary have a script.
    parts = parts.join(summaries.select(*keys), list(keys), "left_semi")
    heads = parts.filter("part = 1").select(*keys, F.lit(0).cast("long").alias("part"), F.lit(section_head(3)).alias("content"))
    resources = heads.unionByName(parts).withColumn("section", F.lit(3))
    return fixed_parts.filter(F.col("content").isNotNull()).unionByName(resources)


def write_scripts(parts: DataFrame, path: str, key: str = "trace_id", mode: str = "errorifexists") -> None:
    """One text file per trace, in a folder of its own: the parts in their order.

    A task writes the parts of its traces one after the other and holds one at a time.
    """
    ordered = parts.repartition(key).sortWithinPartitions(key, "section", "part")
    ordered.select(key, "content").write.mode(mode).partitionBy(key).text(path)


def _process_text() -> Column:
    """The lines of a process: its priority and what its actions suggest."""
    lines = lambda a: F.coalesce(
        *[
            F.when(a["type"] == kind, F.format_string(text, F.col("pid"), a["reason"]))
            for kind, text in ACTION_FORMATS.items()
        ]
    )
    head = F.format_string("# PID %d (Priority: %s)", "pid", _two("priority_score"))
    text = F.concat_ws("\n", head, F.concat_ws("\n", F.transform("actions", lines)), F.lit(""))
    has_lines = F.exists("actions", lambda a: a["type"].isin(*ACTION_FORMATS))
    return F.when(has_lines, text).otherwise(F.concat_ws("\n", head, F.lit("")))


def resource_script(advice: DataFrame, pids_per_part: int = 1000) -> DataFrame:
    """Section 3 of the script: the lines of every process, most urgent first.

    The section grows with the processes, so it comes in parts, one per range of
    ``pids_per_part`` process ids: no text gathers more processes than that. Processes of
    different traces are in parts of their own.
    """
    traces = [k for k in ("trace_id",) if k in advice.columns]
    piece = F.struct((-F.col("priority_score")).alias("rank"), "pid", _process_text().alias("text"))
    parts = advice.groupBy(*traces, F.expr(f"pid div {int(pids_per_part)}").alias("part")).agg(
        F.array_sort(F.collect_list(piece)).alias("_pieces")
    )
    body = F.concat_ws("\n", F.transform("_pieces", lambda p: p["text"]))
    return parts.select(*traces, "part", F.concat_ws("\n", F.lit(section_head(3)), body).alias("content"))


_ANALYSIS_FIELDS = (
    "total_syscalls high_latency_count optimization_candidates anomalies_detected avg_latency "
    "p95_latency p99_latency cpu_avg memory_avg top_optimization_targets pattern_clusters category_breakdown"
).split()


def json_report(analyses: DataFrame, generated: str, keys: tuple[str, ...] = ("trace_id",)) -> DataFrame:
    """One JSON document per trace; missing values stay as nulls."""
    fields = [c for c in _ANALYSIS_FIELDS if c in analyses.columns]
    stats = (
        F.struct("parsed_lines", "skipped_lines", "errors", "total_errors")
        if "parsed_lines" in analyses.columns
        else F.struct(F.lit(None).cast("long").alias("parsed_lines"))
    )
    document = F.struct(
        F.struct(
            F.lit(generated).alias("generated_at"),
            F.lit("calltide").alias("generator"),
            F.lit("1.0").alias("version"),
        ).alias("metadata"),
        F.struct(*fields).alias("analysis"),
        F.coalesce("recommendations", F.array()).alias("recommendations"),
        stats.alias("parse_stats"),
    )
    return analyses.select(*keys, F.to_json(document, {"ignoreNullFields": "false"}).alias("content"))


# Formats of the Markdown report.
_TABLE_HEAD = "| Metric | Value |\n|--------|-------|"
_PARSE_FORMAT = (
    "## Parse Statistics\n\n" + _TABLE_HEAD
    + "\n| Parsed Lines | %d |\n| Skipped Lines | %d |\n| Parse Errors | %d |\n"
)
_SUMMARY_TABLE = (
    "## Analysis Summary\n\n" + _TABLE_HEAD
    + "\n| Total Syscalls | %d |\n| High Latency Calls | %d |\n| Optimization Candidates | %d |"
    + "\n| Anomalies Detected | %d |\n| Avg Latency | %s μs |\n| P95 Latency | %s μs |\n"
)


def markdown_report(analyses: DataFrame, generated: str, keys: tuple[str, ...] = ("trace_id",)) -> DataFrame:
    """One Markdown document per trace."""

    def item(rec: Column, index: Column) -> Column:
        return F.concat_ws(
            "\n",
            F.format_string("### %d. %s %s\n", index + 1, severity_icon(rec["severity"]), type_title(rec["type"])),
            F.format_string("- **Severity:** %s", rec["severity"]),
            F.when(rec["syscall"].isNotNull(), F.format_string("- **Syscall:** `%s`", rec["syscall"])),
            F.format_string("- **Affected Calls:** %d", rec["count"]),
            F.when(rec["avg_latency"].isNotNull(), F.format_string("- **Avg Latency:** %s μs", fixed(rec["avg_latency"], 2))),
            F.format_string("- **Action:** %s\n", rec["recommendation"]),
        )

    parsed = (
        F.when(
            F.col("parsed_lines").isNotNull(),
            F.format_string(_PARSE_FORMAT, "parsed_lines", "skipped_lines", "total_errors"),
        )
        if "parsed_lines" in analyses.columns
        else F.lit(None).cast("string")
    )
    content = F.concat_ws(
        "\n",
        F.lit(f"# {TITLE} Report\n\n**Generated:** {generated}\n"),
        parsed,
        F.format_string(
            _SUMMARY_TABLE, "total_syscalls", "high_latency_count", "optimization_candidates",
            "anomalies_detected", _two("avg_latency"), _two("p95_latency"),
        ),
        F.when(F.size("recommendations") > 0, F.lit("## Recommendations\n")),
        F.concat_ws("\n", F.transform("recommendations", item)),
    )
    return analyses.select(*keys, content.alias("content"))


# The benchmark report.
_BENCHMARK_FORMAT = """# {title} Benchmark Report

**Generated:** {generated}

## Configuration
- Iterations: %1$d
- Syscalls per iteration: %2$d

## Results Summary

| Metric | Improvement |
|--------|-------------|
| Latency Reduction | %3$s%% |
| CPU Savings | %4$s%% |
| Throughput Increase | %5$s%% |

## Detailed Results

### Latency Benchmark
- **Before Optimization:** %6$sμs (avg)
- **After Optimization:** %7$sμs (avg)
- **P95 Before:** %8$sμs
- **P95 After:** %9$sμs

### CPU Utilization Benchmark
- **Before Optimization:** %10$s%%
- **After Optimization:** %11$s%%

### Throughput Benchmark
- **Before Optimization:** %12$s ops/s
- **After Optimization:** %13$s ops/s
"""


def benchmark_report(
    latency: DataFrame, cpu: DataFrame, throughput: DataFrame, calls_per_iteration: int, generated: str
) -> DataFrame:
    """One row with the benchmark as JSON and Markdown, from the three roll-ups
    (one row each)."""

    def named(df, prefix):
        return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])

    row = side_by_side(named(latency, "latency"), named(cpu, "cpu"), named(throughput, "throughput"))
    document = F.struct(
        F.struct(
            F.col("latency_iterations").alias("iterations"),
            F.lit(calls_per_iteration).alias("calls_per_iteration"),
        ).alias("configuration"),
        F.struct(
            *[
                F.struct(*[F.col(f"{p}_{c}").alias(c) for c in df.columns]).alias(p)
                for p, df in (("latency", latency), ("cpu", cpu), ("throughput", throughput))
            ]
        ).alias("benchmarks"),
        F.struct(
            F.col("latency_avg_improvement").alias("avg_latency_improvement"),
            F.col("cpu_avg_improvement").alias("avg_cpu_savings"),
            F.col("throughput_avg_improvement").alias("avg_throughput_increase"),
        ).alias("summary"),
    )
    text = F.format_string(
        _BENCHMARK_FORMAT.replace("{title}", TITLE).replace("{generated}", generated),
        "latency_iterations", F.lit(calls_per_iteration),
        *[_two(f"{p}_avg_improvement") for p in ("latency", "cpu", "throughput")],
        *[_two(f"latency_avg_{c}") for c in ("before_avg", "after_avg", "before_p95", "after_p95")],
        *[fixed(F.col(f"cpu_avg_{c}"), 1) for c in ("before_cpu", "after_cpu")],
        *[_whole(f"throughput_avg_{c}") for c in ("before_throughput", "after_throughput")],
    )
    return row.select(F.to_json(document).alias("json"), text.alias("markdown"))


# Fixed value: the report of two measured traces.
COMPARISON_FORMAT = """# {title} Comparison Report

**Trace:** %1$s
**Generated:** {generated}

## What Was Measured
- Calls before: %2$s
- Calls after: %3$s

## Changes

| Metric | Before | After | Change |
|--------|--------|-------|--------|
| Mean latency (us) | %4$s | %5$s | %6$s%% less |
| Median latency (us) | %7$s | %8$s | |
| P95 latency (us) | %9$s | %10$s | |
| P99 latency (us) | %11$s | %12$s | |
| Longest call (us) | %13$s | %14$s | |
| Mean CPU (%%) | %15$s | %16$s | %17$s%% less |
| Calls per second of latency | %18$s | %19$s | %20$s%% more |

## Methodology

Both sides are calls that were traced; nothing is projected or drawn at random. Percentiles
interpolate between the two nearest ranks over all calls of a side. Throughput is the number of calls
divided by the sum of their latencies. A change is relative to the value before; where a side has no
calls or no such measure it is unknown.
"""


def comparison_report(compared: DataFrame, generated: str) -> DataFrame:
    """One Markdown text per trace from ``whatif.compare``: measured figures, changes and how they were got."""
    shown = lambda column, digits=2: F.coalesce(
        fixed(F.col(column), digits) if digits else _whole(column), F.lit("unknown")
    )
    counted = lambda column: F.coalesce(F.col(column).cast("string"), F.lit("0"))
    pair = lambda measure, digits=2: [shown(f"{side}_{measure}", digits) for side in ("before", "after")]
    text = F.format_string(
        COMPARISON_FORMAT.replace("{title}", TITLE).replace("{generated}", generated),
        "trace_id", counted("before_calls"), counted("after_calls"),
        *pair("avg"), shown("latency_reduction"),
        *pair("p50"), *pair("p95"), *pair("p99"), *pair("max"),
        *pair("cpu", 1), shown("cpu_savings"),
        *pair("throughput", 0), shown("throughput_increase"),
    )
    return compared.select("trace_id", text.alias("content"))
