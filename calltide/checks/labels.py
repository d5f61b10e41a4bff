"""Checks of catalog lookups, labels and order-dependent rules."""

from pyspark.sql import functions as F

from calltide.catalog import agent_rows, catalog
from calltide.checks.base import check, views
from calltide.checks.inputs import labelled, r6
from calltide.operators.aggregate import value_counts
from calltide.operators.chunks import split_by_id, with_index
from calltide.operators.clock import start_offsets
from calltide.operators.label import is_high_latency, latency_ratio, mark_redundant, needs_optimization
from calltide.sources.tables import event_calls, lineitem_calls
from calltide.streaming.live import latency_bands, recent_events


@check(
    "catalog_usage",
    views("named")
    + """SELECT c.name, c.category, c.base AS base_latency_us, c.risk AS risk_level,
                c.is_measured, count(n.syscall_id) AS calls
         FROM catalog c LEFT JOIN named n ON n.syscall_name = c.name GROUP BY ALL""",
)
def catalog_usage(spark, folder):
    used = value_counts(event_calls(spark, folder), "syscall_name")
    return catalog(spark).join(used, F.col("name") == F.col("syscall_name"), "left").select(
        "name",
        "category",
        F.col("base").alias("base_latency_us"),
        F.col("risk").alias("risk_level"),
        "is_measured",
        F.coalesce("count", F.lit(0)).alias("calls"),
    )


_AGENT_VALUES = ", ".join(f"('{n}', '{c}')" for n, c in agent_rows())


@check(
    "agent_taxonomy",
    views("named", f"agent(name, category) AS (VALUES {_AGENT_VALUES})")
    + """SELECT coalesce(a.category, 'other') AS category, count(*) AS calls
         FROM named n LEFT JOIN agent a ON a.name = n.syscall_name GROUP BY 1""",
)
def agent_taxonomy(spark, folder):
    agent = catalog(spark, "agent").withColumnRenamed("category", "agent_category")
    calls = event_calls(spark, folder)
    joined = calls.join(F.broadcast(agent), F.col("name") == F.col("syscall_name"), "left")
    return joined.groupBy(F.coalesce("agent_category", F.lit("other")).alias("category")).agg(
        F.count(F.lit(1)).alias("calls")
    )


@check(
    "catalog_lookup",
    views("calls")
    + """SELECT syscall_id, syscall_name, category, base_latency_us, risk_level,
                round(latency_us, 6) AS latency_us FROM calls""",
)
def catalog_lookup(spark, folder):
    return event_calls(spark, folder).select(
        "syscall_id", "syscall_name", "category", "base_latency_us", "risk_level", r6("latency_us")
    )


@check(
    "latency_flags",
    views("labelled")
    + """SELECT syscall_id, latency_ratio,
                round(latency_us / greatest(base_latency_us, 0.01e0), 3) AS summary_ratio,
                is_high_latency AS high_by_ratio, latency_us > 150 AS high_absolute
         FROM labelled""",
)
def latency_flags(spark, folder):
    return event_calls(spark, folder).select(
        "syscall_id",
        latency_ratio().alias("latency_ratio"),
        latency_ratio(source="summary").alias("summary_ratio"),
        is_high_latency("ratio").alias("high_by_ratio"),
        is_high_latency("absolute").alias("high_absolute"),
    )


@check(
    "needs_optimization_rules",
    views("labelled")
    + """SELECT syscall_id, needs_optimization AS trace_rule,
                latency_us > base_latency_us * 2 OR is_redundant AS train_rule,
                latency_us > base_latency_us * 2 AS summary_rule FROM labelled""",
)
def needs_optimization_rules(spark, folder):
    return labelled(spark, folder).select(
        "syscall_id",
        needs_optimization("trace").alias("trace_rule"),
        needs_optimization("train").alias("train_rule"),
        needs_optimization("summary").alias("summary_rule"),
    )


@check(
    "redundant_calls",
    views("labelled")
    + """SELECT syscall_id, trace_id, is_redundant AS is_redundant_trace, is_redundant_generator
         FROM labelled""",
)
def redundant_calls(spark, folder):
    marked = mark_redundant(event_calls(spark, folder), "both", span=1000)
    return marked.select("syscall_id", "trace_id", "is_redundant_trace", "is_redundant_generator")


@check(
    "redundant_by_process",
    views("calls")
    + """, lagged_pid AS (
           SELECT syscall_id, pid, """
    + " + ".join(f"coalesce(CAST(lag(syscall_name, {i}) OVER w = syscall_name AS INT), 0)" for i in range(1, 6))
    + """ AS same5 FROM calls WINDOW w AS (PARTITION BY pid ORDER BY syscall_id))
         SELECT pid, count(*) AS calls, count(*) FILTER (WHERE same5 >= 3) AS redundant
         FROM lagged_pid GROUP BY pid""",
)
def redundant_by_process(spark, folder):
    marked = mark_redundant(event_calls(spark, folder), "trace", key="pid")
    return marked.groupBy("pid").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("is_redundant").alias("redundant")
    )


@check(
    "dense_call_ids",
    views("calls")
    + """SELECT syscall_id AS event_id, trace_id,
                row_number() OVER (PARTITION BY trace_id ORDER BY syscall_id) - 1 AS dense_id
         FROM calls""",
)
def dense_call_ids(spark, folder):
    calls, layout = split_by_id(event_calls(spark, folder), "trace_id", "syscall_id", 1000)
    return with_index(calls, layout, "dense_id").select(
        F.col("syscall_id").alias("event_id"), "trace_id", "dense_id"
    )


@check(
    "ranked_lineitem_calls",
    """WITH r AS (
         SELECT concat('host-', CAST(l_suppkey % 8 AS VARCHAR)) AS trace_id, l_suppkey AS pid,
                l_linenumber, l_extendedprice,
                row_number() OVER (PARTITION BY l_suppkey % 8
                  ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1
                  AS syscall_id FROM lineitem)
       SELECT trace_id, syscall_id, pid,
              CASE l_linenumber WHEN 1 THEN 'read' WHEN 2 THEN 'write' WHEN 3 THEN 'connect'
                WHEN 4 THEN 'execve' WHEN 5 THEN 'futex' WHEN 6 THEN 'openat' WHEN 7 THEN 'mmap' END
                AS syscall_name,
              round(CASE l_linenumber WHEN 1 THEN 0.5e0 WHEN 2 THEN 0.8e0 WHEN 3 THEN 50e0 WHEN 4 THEN 200e0
                WHEN 5 THEN 5e0 WHEN 6 THEN 0.8e0 ELSE 2.5e0 END * l_extendedprice / 33000, 6)
                AS latency_us FROM r""",
)
def ranked_lineitem_calls(spark, folder):
    return lineitem_calls(spark, folder).select(
        "trace_id", "syscall_id", "pid", "syscall_name", r6("latency_us")
    )


@check(
    "trace_clock",
    views("calls")
    + """SELECT syscall_id, trace_id,
                CAST(sum(CAST(round(latency_us * 1000) AS BIGINT) + 1000 * (syscall_id % 100 + 1))
                     OVER (PARTITION BY trace_id ORDER BY syscall_id) AS BIGINT)
                - CAST(round(latency_us * 1000) AS BIGINT) - 1000 * (syscall_id % 100 + 1) AS start_ns
         FROM calls""",
)
def trace_clock(spark, folder):
    calls = event_calls(spark, folder)
    gap_us = F.col("syscall_id") % 100 + 1
    return start_offsets(calls, gap_us, span=1000).select("syscall_id", "trace_id", "start_ns")


@check(
    "first_process_type",
    views("calls")
    + """SELECT pid, arg_min(process_type, syscall_id) AS process_type FROM calls GROUP BY pid""",
)
def first_process_type(spark, folder):
    return event_calls(spark, folder).groupBy("pid").agg(
        F.min_by("process_type", "syscall_id").alias("process_type")
    )


@check(
    "recent_events",
    views("labelled")
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY syscall_id DESC) AS back
                 FROM labelled)
         SELECT pid AS user_id, syscall_id AS event_id, CAST(back AS INT) AS back, syscall_name AS syscall,
                round(latency_us, 6) AS latency_us FROM r WHERE back <= 50""",
)
def recent_events_query(spark, folder):
    rows = labelled(spark, folder).select(
        F.col("pid").alias("user_id"),
        F.col("syscall_id").alias("event_id"),
        F.col("syscall_name").alias("syscall"),
        r6("latency_us"),
    )
    return recent_events(rows, 50).select("user_id", "event_id", "back", "syscall", "latency_us")


@check(
    "latency_bands",
    views("labelled")
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY syscall_id DESC) AS back
                 FROM labelled),
         m AS (SELECT *, greatest(max(latency_us) OVER (PARTITION BY pid), 100) AS top
               FROM r WHERE back <= 40)
         SELECT pid AS user_id, syscall_id AS event_id,
                CASE WHEN latency_us > top * 0.7e0 THEN 'red' WHEN latency_us > top * 0.4e0 THEN 'amber'
                     ELSE 'blue' END AS band,
                round(greatest(least(latency_us / top * 100, 100), 5), 6) AS height_pct FROM m""",
)
def latency_bands_query(spark, folder):
    rows = labelled(spark, folder).select(
        F.col("pid").alias("user_id"), F.col("syscall_id").alias("event_id"), "latency_us"
    )
    return latency_bands(recent_events(rows, 40)).select(
        "user_id", "event_id", "band", r6("height_pct")
    )
