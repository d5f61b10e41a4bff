"""Labels of a call: catalog attributes, slow, redundant, worth optimising."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltide.catalog import OTHER_BASE, OTHER_RISK, catalog
from calltide.operators.chunks import DEFAULT_SPAN, Layout, split_by_id, with_recent

# Fixed values of the labelling rules.
SLOW_FACTOR = 3
OPTIMISE_FACTOR = 2
SLOW_ABSOLUTE_US = 150
TRACE_WINDOW, TRACE_REPEATS = 5, 3
GENERATOR_WINDOW = 10


def attach_catalog(calls: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """Category, base latency and risk per call; unknown names get the `other` defaults.

    The built-in dimension has a fixed 158 rows, hence the broadcast; a given
    one is left to Spark's own size check.
    """
    fixed = dim is None
    dim = catalog(calls.sparkSession) if fixed else dim
    looked_up = dim.select(
        F.col("name").alias("syscall_name"),
        F.col("category").alias("_category"),
        F.col("base").alias("_base"),
        F.col("risk").alias("_risk"),
    )
    return (
        calls.join(F.broadcast(looked_up) if fixed else looked_up, "syscall_name", "left")
        .withColumn("category", F.coalesce("_category", F.lit("other")))
        .withColumn("base_latency_us", F.coalesce("_base", F.lit(OTHER_BASE)))
        .withColumn("risk_level", F.coalesce("_risk", F.lit(OTHER_RISK)).cast("int"))
        .drop("_category", "_base", "_risk")
    )


def latency_ratio(latency="latency_us", base="base_latency_us", source: str = "trace") -> Column:
    latency, base = F.col(latency), F.col(base)
    if source == "summary":
        return F.round(latency / F.greatest(base, F.lit(0.01)), 3)
    return F.round(F.when(base > 0, latency / base).otherwise(F.lit(1.0)), 3)


def is_high_latency(mode: str = "ratio") -> Column:
    if mode == "ratio":
        return F.col("latency_us") > F.col("base_latency_us") * SLOW_FACTOR
    if mode == "absolute":
        return F.col("latency_us") > SLOW_ABSOLUTE_US
    raise ValueError(f"unknown mode {mode!r}")


def needs_optimization(rule: str = "trace") -> Column:
    """``trace``: slow or redundant; ``train``: over twice the base or redundant;
    ``summary``: over twice the base."""
    over = F.col("latency_us") > F.col("base_latency_us") * OPTIMISE_FACTOR
    if rule == "trace":
        return F.col("is_high_latency") | F.col("is_redundant")
    if rule == "train":
        return over | F.col("is_redundant")
    if rule == "summary":
        return over
    raise ValueError(f"unknown rule {rule!r}")


def _repeats(depth: int) -> Column:
    return reduce(
        add,
        [
            F.coalesce((F.col(f"_prev_{i}") == F.col("syscall_name")).cast("int"), F.lit(0))
            for i in range(1, depth + 1)
        ],
    )


def _trace_rule() -> Column:
    return _repeats(TRACE_WINDOW) >= TRACE_REPEATS


def _generator_rule() -> Column:
    return _repeats(GENERATOR_WINDOW) * 2 > F.col("_n_prev")


def mark_redundant(
    calls: DataFrame,
    rule: str = "trace",
    key: tuple[str, ...] | str = "trace_id",
    order: str = "syscall_id",
    span: int = DEFAULT_SPAN,
    layout: Layout | None = None,
    name: str = "is_redundant",
    index: str | None = None,
) -> DataFrame:
    """Marks calls that repeat what came just before them.

    ``index`` names a column to hold the dense number of the call in its trace.

    ``trace``: at least 3 of the 5 calls before have the same name.
    ``generator``: more than half of the (up to) 10 calls before have it.
    ``both``: adds ``<name>_trace`` and ``<name>_generator`` from one pass.
    """
    if rule not in ("trace", "generator", "both"):
        raise ValueError(f"unknown rule {rule!r}")
    if layout is None:
        calls, layout = split_by_id(calls, key, order, span)
    depth = TRACE_WINDOW if rule == "trace" else GENERATOR_WINDOW
    marked = with_recent(calls, layout, "syscall_name", depth, index)
    if rule == "both":
        marked = marked.withColumn(f"{name}_trace", _trace_rule()).withColumn(
            f"{name}_generator", _generator_rule()
        )
    else:
        marked = marked.withColumn(name, _trace_rule() if rule == "trace" else _generator_rule())
    return marked.drop("_chunk", "_n_prev", *[f"_prev_{i}" for i in range(1, depth + 1)])


def label(
    calls: DataFrame,
    redundancy: str = "trace",
    optimise: str = "trace",
    slow: str = "ratio",
    key: tuple[str, ...] | str = "trace_id",
    span: int = DEFAULT_SPAN,
    layout: Layout | None = None,
    index: str | None = None,
) -> DataFrame:
    """All labels of catalogued calls with a latency: one shuffle of the rows."""
    marked = mark_redundant(calls, rule=redundancy, key=key, span=span, layout=layout, index=index)
    return (
        marked.withColumn("latency_ratio", latency_ratio())
        .withColumn("is_high_latency", is_high_latency(slow))
        .withColumn("needs_optimization", needs_optimization(optimise))
    )
