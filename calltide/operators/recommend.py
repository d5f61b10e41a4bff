"""Ranked recommendations from the call cube."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltide.functions.scalar import fixed, type_label

# Texts of the recommendations.
SLOW_TEXT = "Consider batching or caching %s calls. Average latency: %sμs"
REDUNDANT_TEXT = "Eliminate redundant %s calls. Detected %d potentially redundant calls."
ANOMALY_TEXT = (
    "Investigate %d anomalous syscall patterns. "
    "These may indicate performance issues or bugs."
)


def _offenders(
    cube: DataFrame, keys: tuple[str, ...], count: str, latency: str | None, first: str, k: int
) -> DataFrame:
    """The first k names seen with the flag. The cube holds a few hundred rows per key."""
    names = (
        cube.groupBy(*keys, "syscall_name")
        .agg(
            F.sum(count).alias("count"),
            (F.try_divide(F.sum(latency), F.sum(count)) if latency else F.lit(None).cast("double")).alias(
                "avg_latency"
            ),
            F.min(first).alias("_first"),
        )
        .filter(F.col("count") > 0)
    )
    seen = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_first", "syscall_name")
    return names.withColumn("_rank", F.row_number().over(seen)).filter(F.col("_rank") <= k)


def _shape(df: DataFrame, keys, kind: str, severity: str, rank: Column, text: Column) -> DataFrame:
    return df.select(
        *keys,
        rank.cast("int").alias("seq"),
        F.lit(kind).alias("type"),
        F.col("syscall_name").alias("syscall"),
        F.lit(severity).alias("severity"),
        F.col("count"),
        F.col("avg_latency"),
        text.alias("recommendation"),
    )


def slow_recommendations(cube: DataFrame, keys: tuple[str, ...] = (), k: int = 5) -> DataFrame:
    found = _offenders(cube, keys, "n_slow", "slow_latency_sum", "slow_first", k)
    text = F.format_string(SLOW_TEXT, "syscall_name", fixed(F.col("avg_latency"), 2))
    return _shape(found, keys, "high_latency", "high", F.col("_rank"), text)


def redundancy_recommendations(cube: DataFrame, keys: tuple[str, ...] = (), k: int = 5) -> DataFrame:
    found = _offenders(cube, keys, "n_redundant", None, "redundant_first", k)
    text = F.format_string(REDUNDANT_TEXT, "syscall_name", "count")
    return _shape(found, keys, "redundancy", "medium", F.lit(100) + F.col("_rank"), text)


def anomaly_recommendations(cube: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    found = (
        cube.groupBy(*keys)
        .agg(F.sum("n_anomaly").alias("count"))
        .filter(F.col("count") > 0)
        .withColumn("syscall_name", F.lit(None).cast("string"))
        .withColumn("avg_latency", F.lit(None).cast("double"))
    )
    return _shape(found, keys, "anomaly", "high", F.lit(200), F.format_string(ANOMALY_TEXT, "count"))


def recommend(cube: DataFrame, keys: tuple[str, ...] = (), k: int = 5) -> DataFrame:
    """All recommendations; ``seq`` orders them: slow, redundant, anomalous."""
    return (
        slow_recommendations(cube, keys, k)
        .unionByName(redundancy_recommendations(cube, keys, k))
        .unionByName(anomaly_recommendations(cube, keys))
    )


def recommendation_counts(recommendations: DataFrame) -> DataFrame:
    return (
        recommendations.groupBy("severity", "type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("affected_calls"))
        .withColumn("label", type_label(F.col("type")))
    )
