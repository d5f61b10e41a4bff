"""Column expressions shared by the operators. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed, *keys) -> Column:
    """A reproducible number in [0, 1) for a seed and a key.

    The first 32 bits of an md5 digest: the same in every engine and under any
    partitioning, so results never depend on where a row is processed.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k) if isinstance(k, str) else k for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def clip(value: Column, low: float, high: float) -> Column:
    """``value`` within bounds; an unknown value stays unknown."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high))))


def call_priority(p_high: Column, p_opt: Column, anomaly: Column) -> Column:
    """Weight of a call: slow, worth optimising, unusual."""
    return p_high * 0.4 + p_opt * 0.4 + (F.lit(1.0) - clip(anomaly + 0.5, 0, 1)) * 0.2


def process_priority(cpu_change: Column, memory_change: Column, high_ratio: Column) -> Column:
    """Weight of a process from the parts that are known; null if none is."""
    parts = (F.abs(cpu_change) * 0.3, F.abs(memory_change) * 0.3, high_ratio * 100 * 0.4)
    known = F.coalesce(*parts).isNotNull()
    return F.when(known, sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0))))


def progress(score: Column) -> Column:
    """Priority score as the length of a progress bar, at most 100."""
    return F.when(score.isNotNull(), F.least(score * 10, F.lit(100.0)))


def fixed(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, rounding the exact binary value
    half to even, as C and Python do (Java's own formats round its shortest text)."""
    return F.call_function("format_number", value, F.lit("0." + "0" * digits))


def short_number(value: Column) -> Column:
    """1234 -> 1.2K, 1234567 -> 1.2M; exact halves (1250) go up."""

    def scaled(unit: int, letter: str) -> Column:
        half = (value % unit).isin(unit // 4, 3 * unit // 4)
        return F.concat(fixed(value / float(unit) + F.when(half, 0.01).otherwise(0.0), 1), F.lit(letter))

    return (
        F.when(value >= 1000000, scaled(1000000, "M"))
        .when(value >= 1000, scaled(1000, "K"))
        .otherwise(value.cast("string"))
    )


def type_title(value: Column) -> Column:
    """high_latency -> High Latency."""
    return F.initcap(F.replace(value, F.lit("_"), F.lit(" ")))


def type_label(value: Column) -> Column:
    # Display labels of the recommendation types.
    return (
        F.when(value == "high_latency", "High Latency Detected")
        .when(value == "redundancy", "Redundant Calls")
        .when(value == "anomaly", "Anomalous Pattern")
        .otherwise(value)
    )


def severity_icon(value: Column) -> Column:
    # Icon of a severity.
    return F.when(value == "high", "🔴").when(value == "medium", "🟡").otherwise("🟢")


def iso_time(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def file_stamp(value: Column) -> Column:
    return F.date_format(value, "yyyyMMdd_HHmmss")


def derived_call_features() -> dict[str, Column]:
    """Features computed from one call."""
    return {
        "latency_log": F.log1p("latency_us"),
        "latency_squared": F.col("latency_us") * F.col("latency_us"),
        "cpu_memory_ratio": F.col("cpu_usage") / (F.col("memory_usage") + 0.1),
        "efficiency_score": F.col("base_latency_us") / (F.col("latency_us") + 0.1),
    }
