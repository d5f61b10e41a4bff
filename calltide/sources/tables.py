"""Adapters: the given tables read as call traces.

`events` becomes a trace per host with one call per event; `lineitem` becomes a
large trace for the bench. Both go through the same catalog lookup as parsed
traces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.operators.chunks import rank_rows
from calltide.operators.label import attach_catalog


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _event_name() -> Column:
    kind, k = F.col("event_type"), F.col("k")
    usual = (
        F.when(kind == "view", "read")
        .when(kind == "click", "write")
        .when(kind == "purchase", "connect")
        .when(kind == "signup", "execve")
        .otherwise("futex")
    )
    rare = (
        F.when(kind == "view", "fsync")
        .when(kind == "click", "pwrite64")
        .when(kind == "purchase", "accept4")
        .when(kind == "signup", "openat")
        .otherwise("ioctl")
    )
    return F.when(k >= 95, "custom_call").when(k < 80, usual).otherwise(rare)


def event_calls(spark: SparkSession, folder: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Catalogued calls made from `events`; `event_id` is the call id. ``keep``
    names columns of the table to carry along."""
    user = F.col("user_id")
    rows = table(spark, folder, "events").withColumn(
        "k", F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    )
    calls = rows.select(
        F.col("event_id").alias("syscall_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        user.alias("pid"),
        F.concat(F.lit("host-"), (user % 8).cast("string")).alias("trace_id"),
        _event_name().alias("syscall_name"),
        F.when(F.col("event_type") == "error", -(F.col("k") % 22 + 1))
        .otherwise(0)
        .cast("long")
        .alias("return_value"),
        F.when(user % 4 == 0, "io_heavy")
        .when(user % 4 == 1, "cpu_heavy")
        .when(user % 4 == 2, "network")
        .otherwise("mixed")
        .alias("process_type"),
        F.col("k").cast("double").alias("cpu_usage"),
        (((F.col("event_id") * 37) % 1000).cast("double") / 10).alias("memory_usage"),
        (F.col("k") % 7).alias("context_switches"),
        "value",
    )
    return (
        attach_catalog(calls)
        .withColumn("latency_us", F.col("base_latency_us") * F.col("value") / 50)
        .drop(*({"value"} - set(keep)))
    )


def lineitem_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogued calls made from `lineitem`, numbered by their unique order."""
    # Call name by line number 1-7.
    names = ("read", "write", "connect", "execve", "futex", "openat", "mmap")
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("l_linenumber"))
    rows = table(spark, folder, "lineitem").select(
        F.concat(F.lit("host-"), (F.col("l_suppkey") % 8).cast("string")).alias("trace_id"),
        F.col("l_suppkey").alias("pid"),
        name.alias("syscall_name"),
        F.lit(0).cast("long").alias("return_value"),
        F.lit("mixed").alias("process_type"),
        F.col("l_quantity").alias("cpu_usage"),
        (F.col("l_discount") * 1000).alias("memory_usage"),
        F.col("l_linenumber").alias("context_switches"),
        "l_extendedprice",
        "l_shipdate",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_quantity",
    )
    order = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "pid", "l_quantity")
    ranked = rank_rows(rows, ("trace_id",), order, "syscall_id")
    return (
        attach_catalog(ranked)
        .withColumn("latency_us", F.col("base_latency_us") * F.col("l_extendedprice") / 33000)
        .drop("l_extendedprice", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    )
