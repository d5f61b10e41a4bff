"""Call records as JSON documents and as plain events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from calltide.functions.scalar import iso_time
from calltide.schemas import CALL

POSTED = StructType([StructField("syscalls", ArrayType(CALL), True)])


def calls_from_json(rows: DataFrame, body: str) -> DataFrame:
    """Calls of posted documents ``{"syscalls": [...]}``; documents that are not
    JSON hold none. Missing fields are null."""
    posted = F.from_json(body, POSTED, {"mode": "PERMISSIVE"})
    return rows.select(F.explode(posted["syscalls"]).alias("c")).select("c.*")


def calls_to_json(calls: DataFrame, batch: int = 500) -> DataFrame:
    """Documents of at most ``batch`` calls each, for handing calls on."""
    record = F.struct(*[c.name for c in CALL.fields if c.name in calls.columns])
    slot = F.expr(f"syscall_id div {int(batch)}").alias("_slot")
    grouped = calls.groupBy("trace_id", slot).agg(F.collect_list(record).alias("syscalls"))
    return grouped.select("trace_id", F.to_json(F.struct("syscalls")).alias("body"))


def as_events(calls: DataFrame) -> DataFrame:
    """Calls in the shape of live events."""
    return calls.select(
        iso_time(F.col("ts")).alias("timestamp"),
        F.col("syscall_name").alias("syscall"),
        "category",
        F.col("latency_us").alias("latency"),
        F.col("cpu_usage").alias("cpu"),
        F.col("memory_usage").alias("memory"),
        "is_high_latency",
        "is_redundant",
    )
