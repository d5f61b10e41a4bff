"""Checks of summaries, histograms, top lists and data-set measures."""

from pyspark.sql import functions as F

from calltide.checks.base import check, hash01, views
from calltide.checks.inputs import cube, labelled, r6, scored
from calltide.functions.scalar import (
    derived_call_features,
    file_stamp,
    iso_time,
    short_number,
    type_title,
    uniform,
)
from calltide.operators import aggregate as agg
from calltide.operators.features import hash_split, shuffled
from calltide.operators.quantiles import quantiles
from calltide.sources.tables import event_calls, table

_SUMMARY_COLUMNS = """count(*) AS total_syscalls,
  count(*) FILTER (WHERE p_high > 0.5) AS high_latency_count,
  count(*) FILTER (WHERE p_opt > 0.5) AS optimization_candidates,
  count(*) FILTER (WHERE is_anomaly) AS anomalies_detected,
  round(avg(latency_us), 6) AS avg_latency, round(quantile_cont(latency_us, 0.95), 6) AS p95_latency,
  round(quantile_cont(latency_us, 0.99), 6) AS p99_latency,
  round(avg(cpu_usage), 6) AS cpu_avg, round(avg(memory_usage), 6) AS memory_avg"""
_MEANS = ("avg_latency", "p95_latency", "p99_latency", "cpu_avg", "memory_avg")
_COUNTS = ("total_syscalls", "high_latency_count", "optimization_candidates", "anomalies_detected")


@check("analysis_summary", views("scored") + f"SELECT {_SUMMARY_COLUMNS} FROM scored")
def analysis_summary(spark, folder):
    rows = scored(spark, folder)
    latencies = event_calls(spark, folder)
    return agg.summary(rows, agg.call_cube(rows), latencies=latencies).select(*_COUNTS, *[r6(c) for c in _MEANS])


@check(
    "analysis_summary_by_trace",
    views("scored") + f"SELECT trace_id, {_SUMMARY_COLUMNS} FROM scored GROUP BY trace_id",
)
def analysis_summary_by_trace(spark, folder):
    rows, keys = scored(spark, folder), ("trace_id",)
    out = agg.summary(rows, agg.call_cube(rows, keys), keys, latencies=event_calls(spark, folder))
    return out.select("trace_id", *_COUNTS, *[r6(c) for c in _MEANS])


@check(
    "price_quantiles",
    """SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0), 6) AS low,
              round(quantile_cont(l_extendedprice, 0.25), 6) AS q1,
              round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
              round(quantile_cont(l_extendedprice, 0.95), 6) AS p95,
              round(quantile_cont(l_extendedprice, 1), 6) AS high
       FROM lineitem GROUP BY ALL""",
)
def price_quantiles(spark, folder):
    probs = {"low": 0.0, "q1": 0.25, "median": 0.5, "p95": 0.95, "high": 1.0}
    keys = ("l_returnflag", "l_linestatus")
    out = quantiles(table(spark, folder, "lineitem"), "l_extendedprice", probs, keys)
    return out.select(*keys, *[r6(p) for p in probs])


@check(
    "time_quantiles",
    """WITH t AS (SELECT event_type, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS us FROM events)
       SELECT event_type, round(quantile_cont(us, 0.05), 1) AS p5, round(quantile_cont(us, 0.5), 1) AS p50,
              round(quantile_cont(us, 0.95), 1) AS p95 FROM t GROUP BY event_type""",
)
def time_quantiles(spark, folder):
    start = F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    rows = table(spark, folder, "events").select(
        "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) - start).alias("us")
    )
    out = quantiles(rows, "us", {"p5": 0.05, "p50": 0.5, "p95": 0.95}, ("event_type",))
    return out.select("event_type", *[F.round(c, 1).alias(c) for c in ("p5", "p50", "p95")])


@check(
    "syscall_summary",
    views("scored")
    + """SELECT syscall_name, round(avg(priority), 6) AS optimization_priority,
                round(avg(latency_us), 6) AS latency_us, count(*) AS count FROM scored GROUP BY 1""",
)
def syscall_summary(spark, folder):
    return agg.by_syscall(cube(spark, folder)).select(
        "syscall_name", r6("optimization_priority"), r6("latency_us"), "count"
    )


@check(
    "cluster_summary",
    views("scored")
    + """, n AS (SELECT pattern_cluster, syscall_name, count(*) AS c FROM scored GROUP BY ALL),
         d AS (SELECT pattern_cluster, syscall_name FROM n
               QUALIFY row_number() OVER (PARTITION BY pattern_cluster ORDER BY c DESC, syscall_name) = 1)
         SELECT s.pattern_cluster, any_value(d.syscall_name) AS dominant_syscall,
                round(avg(latency_us), 6) AS latency_us, round(avg(priority), 6) AS optimization_priority,
                count(*) AS count
         FROM scored s JOIN d ON d.pattern_cluster = s.pattern_cluster GROUP BY 1""",
)
def cluster_summary(spark, folder):
    return agg.by_cluster(cube(spark, folder)).select(
        "pattern_cluster", "dominant_syscall", r6("latency_us"), r6("optimization_priority"), "count"
    )


_CATEGORY_SQL = """SELECT category, round(avg(latency_us), 6) AS avg_latency,
  round(sum(latency_us), 6) AS total_latency, count(*) AS count,
  round(avg(p_high), 6) AS high_lat_prob, round(avg(p_opt), 6) AS opt_prob FROM scored GROUP BY category"""


@check("category_breakdown", views("scored") + _CATEGORY_SQL)
def category_breakdown(spark, folder):
    return agg.by_category(cube(spark, folder)).select(
        "category", r6("avg_latency"), r6("total_latency"), "count", r6("high_lat_prob"), r6("opt_prob")
    )


@check(
    "category_breakdown_by_trace",
    views("scored")
    + """SELECT trace_id, category, round(avg(latency_us), 6) AS avg_latency, count(*) AS count,
                round(avg(p_opt), 6) AS opt_prob FROM scored GROUP BY 1, 2""",
)
def category_breakdown_by_trace(spark, folder):
    keys = ("trace_id",)
    return agg.by_category(cube(spark, folder, keys), keys).select(
        "trace_id", "category", r6("avg_latency"), "count", r6("opt_prob")
    )


@check(
    "top_optimization_targets",
    views("scored")
    + """SELECT syscall_name, round(avg(priority), 6) AS optimization_priority,
                round(avg(latency_us), 6) AS latency_us, count(*) AS count
         FROM scored GROUP BY 1 ORDER BY round(avg(priority), 6) DESC, 1 LIMIT 10""",
)
def top_optimization_targets(spark, folder):
    rows = agg.by_syscall(cube(spark, folder)).withColumns(
        {c: r6(c) for c in ("optimization_priority", "latency_us")}
    )
    return agg.top(rows, 10, "optimization_priority", "syscall_name")


@check(
    "syscall_histogram",
    views("named") + "SELECT syscall_name, count(*) AS count FROM named GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
)
def syscall_histogram(spark, folder):
    counts = agg.value_counts(event_calls(spark, folder), "syscall_name")
    return agg.top(counts, 15, "count", "syscall_name")


@check(
    "category_histogram",
    views("calls")
    + """SELECT trace_id, category, count(*) AS count FROM calls GROUP BY 1, 2
         QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY count(*) DESC, category) <= 5""",
)
def category_histogram(spark, folder):
    counts = agg.value_counts(event_calls(spark, folder), "category", ("trace_id",))
    return agg.top(counts, 5, "count", "category", ("trace_id",))


@check(
    "flag_counts",
    views("labelled")
    + """SELECT syscall_name, count(*) FILTER (WHERE is_high_latency) AS count,
                round(avg(latency_us) FILTER (WHERE is_high_latency), 6) AS avg_latency,
                min(syscall_id) FILTER (WHERE is_high_latency) AS first_id
         FROM labelled GROUP BY 1 HAVING count(*) FILTER (WHERE is_high_latency) > 0""",
)
def flag_counts(spark, folder):
    out = agg.flag_counts(labelled(spark, folder), "is_high_latency")
    return out.select("syscall_name", "count", r6("avg_latency"), "first_id")


@check(
    "first_offenders",
    views("labelled")
    + """SELECT syscall_name, min(syscall_id) AS first_id FROM labelled WHERE is_redundant
         GROUP BY 1 ORDER BY 2, 1 LIMIT 5""",
)
def first_offenders(spark, folder):
    return agg.first_offenders(labelled(spark, folder), "is_redundant").select("syscall_name", "first_id")


@check(
    "dataset_summary",
    views("labelled")
    + """SELECT count(*) AS total_syscalls, count(DISTINCT syscall_name) AS unique_syscalls,
                count(*) FILTER (WHERE is_high_latency) AS is_high_latency_count,
                count(*) FILTER (WHERE is_redundant) AS is_redundant_count,
                count(*) FILTER (WHERE needs_optimization) AS needs_optimization_count,
                round(avg(is_high_latency::INT), 6) AS is_high_latency_rate,
                round(avg(is_redundant::INT), 6) AS is_redundant_rate,
                round(avg(needs_optimization::INT), 6) AS needs_optimization_rate,
                round(avg(latency_us), 6) AS avg_latency FROM labelled""",
)
def dataset_summary(spark, folder):
    out = agg.dataset_summary(labelled(spark, folder))
    return out.select(*[r6(c) if c.endswith(("_rate", "latency")) else c for c in out.columns])


@check(
    "dashboard_kpis",
    views("scored")
    + f""", s AS (SELECT trace_id, {_SUMMARY_COLUMNS} FROM scored GROUP BY trace_id)
         SELECT trace_id, round(avg_latency, 2) AS avg_latency, round(cpu_avg, 1) AS cpu_usage,
                CAST(floor(1000000 / avg_latency + 0.5e0) AS BIGINT) AS throughput, optimization_candidates,
                round((1 - avg_latency / p95_latency) * 100, 1) AS below_p95_pct,
                round(100 - cpu_avg, 1) AS cpu_available_pct FROM s""",
)
def dashboard_kpis(spark, folder):
    rows, keys = scored(spark, folder), ("trace_id",)
    return agg.dashboard_kpis(agg.summary(rows, agg.call_cube(rows, keys), keys))


@check(
    "category_chart",
    views("scored")
    + f""", c AS ({_CATEGORY_SQL})
         SELECT category, avg_latency, round(opt_prob * 100, 4) AS optimization_potential FROM c""",
)
def category_chart(spark, folder):
    out = agg.category_chart(agg.by_category(cube(spark, folder)))
    return out.select("category", r6("avg_latency"), F.round("optimization_potential", 4).alias("optimization_potential"))


@check(
    "masked_calls",
    views("scored")
    + """SELECT syscall_id, syscall_name FROM scored
         WHERE p_high > 0.7 OR is_redundant OR is_anomaly""",
)
def masked_calls(spark, folder):
    rows = scored(spark, folder)
    wanted = (F.col("high_latency_probability") > agg.RECOMMEND) | F.col("is_redundant") | F.col("is_anomaly")
    return rows.filter(wanted).select("syscall_id", "syscall_name")


@check(
    "call_features",
    views("calls")
    + """SELECT syscall_id, round(ln(1 + latency_us), 6) AS latency_log,
                round(latency_us * latency_us, 4) AS latency_squared,
                round(cpu_usage / (memory_usage + 0.1e0), 6) AS cpu_memory_ratio,
                round(base_latency_us / (latency_us + 0.1e0), 6) AS efficiency_score FROM calls""",
)
def call_features(spark, folder):
    out = event_calls(spark, folder).withColumns(derived_call_features())
    return out.select(
        "syscall_id",
        r6("latency_log"),
        F.round("latency_squared", 4).alias("latency_squared"),
        r6("cpu_memory_ratio"),
        r6("efficiency_score"),
    )


@check(
    "call_priority",
    views("scored")
    + """SELECT syscall_id, round(anomaly_score, 6) AS anomaly_score, is_anomaly, pattern_cluster,
                p_high AS high_latency_probability, p_opt AS optimization_probability,
                round(priority, 6) AS optimization_priority FROM scored""",
)
def call_priority(spark, folder):
    return scored(spark, folder).select(
        "syscall_id", r6("anomaly_score"), "is_anomaly", "pattern_cluster",
        "high_latency_probability", "optimization_probability", r6("optimization_priority"),
    )


@check(
    "hash_uniform",
    f"SELECT event_id, {hash01('42', 'event_id')} AS u FROM events",
)
def hash_uniform(spark, folder):
    return table(spark, folder, "events").select("event_id", uniform("42", "event_id").alias("u"))


@check(
    "train_test_split",
    views("named")
    + f"""SELECT syscall_id, CASE WHEN {hash01('42', 'syscall_id')} < 0.8 THEN 'train' ELSE 'test' END AS part
          FROM named""",
)
def train_test_split(spark, folder):
    return hash_split(event_calls(spark, folder), "syscall_id").select("syscall_id", "part")


@check(
    "shuffled_order",
    """SELECT event_id, CAST(row_number() OVER (ORDER BY md5(concat('42|', CAST(event_id AS VARCHAR))), event_id) - 1
              AS BIGINT) AS place FROM events""",
)
def shuffled_order(spark, folder):
    return shuffled(table(spark, folder, "events"), "event_id", "42").select("event_id", "place")


@check(
    "concatenated_traces",
    views("calls")
    + """SELECT process_type, count(*) AS calls, count(return_value) AS with_return,
                round(sum(latency_us), 4) AS latency_us FROM (
           SELECT process_type, return_value, latency_us FROM calls
           UNION ALL
           SELECT 'orders', NULL, o_totalprice FROM orders) x GROUP BY 1""",
)
def concatenated_traces(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.lit("orders").alias("process_type"), F.col("o_totalprice").alias("latency_us")
    )
    both = event_calls(spark, folder).unionByName(orders, allowMissingColumns=True)
    return both.groupBy("process_type").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count("return_value").alias("with_return"),
        F.round(F.sum("latency_us"), 4).alias("latency_us"),
    )


@check(
    "formatted_numbers",
    views("calls", "n AS (SELECT pid, trace_id, count(*) * 1237 AS big, min(ts) AS first FROM calls GROUP BY 1, 2)")
    + """SELECT pid, CASE WHEN big >= 1000000 THEN printf('%.1fM', big / 1000000 + CASE WHEN big % 500000 = 250000 THEN 0.01e0 ELSE 0e0 END)
                          WHEN big >= 1000 THEN printf('%.1fK', big / 1000 + CASE WHEN big % 500 = 250 THEN 0.01e0 ELSE 0e0 END)
                          ELSE CAST(big AS VARCHAR) END AS short,
                concat('Host ', substr(trace_id, 6)) AS title,
                strftime(first, '%Y-%m-%dT%H:%M:%S.%f') AS iso, strftime(first, '%Y%m%d_%H%M%S') AS stamp
         FROM n""",
)
def formatted_numbers(spark, folder):
    rows = event_calls(spark, folder).groupBy("pid", "trace_id").agg(
        (F.count(F.lit(1)) * 1237).alias("big"), F.min("ts").alias("first")
    )
    return rows.select(
        "pid",
        short_number(F.col("big")).alias("short"),
        type_title(F.replace("trace_id", F.lit("-"), F.lit("_"))).alias("title"),
        iso_time(F.col("first")).alias("iso"),
        file_stamp(F.col("first")).alias("stamp"),
    )
