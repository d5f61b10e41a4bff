"""Times the headline queries at ``$BENCH_SF_DIR`` and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from calltide.checks import QUERIES  # noqa: E402
from calltide.operators.label import label  # noqa: E402
from calltide.session import local_session  # noqa: E402
from calltide.sources.tables import lineitem_calls  # noqa: E402

# Parse, label, aggregate, percentiles, recommend, process advice, joins, live.
HEADLINE = (
    "parse_call_lines",
    "calls_from_mixed_lines",
    "parse_statistics",
    "redundant_calls",
    "category_breakdown",
    "analysis_summary",
    "price_quantiles",
    "top_optimization_targets",
    "recommendations_by_trace",
    "process_stats",
    "scheduling_recommendations",
    "latency_profile",
    "host_metrics_as_of",
    "recent_events",
    "tuning_script",
    "live_counters",
    "ring_buffers",
    "streamed_redundancy",
)


def lineitem_labels(spark, folder):
    """The large trace: numbered, labelled and counted by category."""
    return label(lineitem_calls(spark, folder)).groupBy("category").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if("is_redundant").alias("redundant"),
        F.count_if("needs_optimization").alias("candidates"),
    )


def timed(query, spark, folder) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "calltide-bench")
    spark.read.parquet(f"{folder}/events.parquet").count()
    jobs = {name: QUERIES[name] for name in HEADLINE} | {"lineitem_labels": lineitem_labels}
    seconds = {name: timed(query, spark, folder) for name, query in jobs.items()}
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
