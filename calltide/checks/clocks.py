"""Check of wall-clock times of traces without dates."""

from pyspark.sql import functions as F

from calltide.checks.base import check
from calltide.operators.chunks import split_by_id
from calltide.operators.clock import wall_times
from calltide.sources.tables import event_calls


@check(
    "wall_times",
    """SELECT event_id AS syscall_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM events""",
)
def wall_times_query(spark, folder):
    """Dates dropped and found again: a trace never pauses for a day."""
    calls = event_calls(spark, folder).select(
        "syscall_id", F.lit("one").alias("trace_id"), F.date_format("ts", "HH:mm:ss.SSSSSS").alias("ts_text")
    )
    chunked, layout = split_by_id(calls, "trace_id", "syscall_id", 500)
    dated = wall_times(chunked, "2024-01-01", layout)
    return dated.select("syscall_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))
