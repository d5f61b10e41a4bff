"""Schemas of the tables the library reads and writes."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(*fields):
    return StructType([StructField(name, kind, True) for name, kind in fields])


CALL = _struct(
    ("trace_id", StringType()),
    ("ts_text", StringType()),
    ("syscall_id", LongType()),
    ("pid", LongType()),
    ("syscall_name", StringType()),
    ("category", StringType()),
    ("args_summary", StringType()),
    ("latency_us", DoubleType()),
    ("base_latency_us", DoubleType()),
    ("latency_ratio", DoubleType()),
    ("cpu_usage", DoubleType()),
    ("memory_usage", DoubleType()),
    ("context_switches", IntegerType()),
    ("return_value", LongType()),
    ("errno", StringType()),
    ("is_redundant", BooleanType()),
    ("risk_level", IntegerType()),
    ("is_high_latency", BooleanType()),
    ("needs_optimization", BooleanType()),
    ("source", StringType()),
)

EVENT = _struct(
    ("type", StringType()),
    ("timestamp", StringType()),
    ("syscall", StringType()),
    ("category", StringType()),
    ("latency_us", DoubleType()),
    ("cpu_usage", DoubleType()),
    ("memory_usage", DoubleType()),
    ("is_high_latency", BooleanType()),
    ("is_redundant", BooleanType()),
    ("process", StringType()),
    ("pid", LongType()),
    ("platform", StringType()),
    ("source", StringType()),
)

PROCESS = _struct(
    ("pid", LongType()),
    ("ppid", LongType()),
    ("name", StringType()),
    ("username", StringType()),
    ("status", StringType()),
    ("cpu", DoubleType()),
    ("memory", DoubleType()),
    ("exe", StringType()),
)

# One JSON message of the live feed: the fields of a single event and those of
# the batch, snapshot and agent envelopes side by side; ``type`` tells which.
MESSAGE = StructType(
    EVENT.fields
    + _struct(
        ("events", ArrayType(EVENT)),
        ("processes", ArrayType(PROCESS)),
        ("hostname", StringType()),
        ("count", LongType()),
        ("auto_switch", BooleanType()),
    ).fields
)

ANALYSIS = _struct(
    ("user_id", LongType()),
    ("trace_id", StringType()),
    ("title", StringType()),
    ("source_type", StringType()),
    ("filename", StringType()),
    ("total_syscalls", LongType()),
    ("analysis_json", StringType()),
    ("recommendations_json", StringType()),
    ("syscall_summary_json", StringType()),
    ("category_summary_json", StringType()),
    ("parse_stats_json", StringType()),
    ("created_at", TimestampType()),
)

EXPORT = _struct(
    ("user_id", LongType()),
    ("trace_id", StringType()),
    ("export_format", StringType()),
    ("filename", StringType()),
    ("content", StringType()),
    ("created_at", TimestampType()),
)
