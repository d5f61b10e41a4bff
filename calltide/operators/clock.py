"""Time inside a trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltide.operators.chunks import DEFAULT_SPAN, Layout, split_by_id, with_running


def start_offsets(
    calls: DataFrame, gap_us: Column, key: str = "trace_id", order: str = "syscall_id", span: int = DEFAULT_SPAN
) -> DataFrame:
    """Adds ``start_ns``: when a call starts, counted from the first call of its
    trace, if each call follows the one before after its latency and a gap.

    Whole nanoseconds, so the sum is the same however the trace is split.
    """
    step = F.round(F.col("latency_us") * 1000).cast("long") + gap_us.cast("long") * 1000
    chunked, layout = split_by_id(calls.withColumn("_step", step), key, order, span)
    summed = with_running(chunked, layout, {"_end": F.col("_step")})
    return summed.withColumn("start_ns", F.col("_end") - F.col("_step")).drop("_end", "_step", "_chunk")


HALF_A_DAY = 12 * 3600


def _turn(before: Column, now: Column, slack: int) -> Column:
    """Days that pass from a clock time (microseconds) to the next one."""
    turn = F.when(now < before - slack * 1_000_000, 1)
    if slack:
        turn = turn.when(now > before + slack * 1_000_000, -1)
    return F.coalesce(turn, F.lit(0))


def wall_times(calls: DataFrame, date: str, layout: Layout, slack: int = 0) -> DataFrame:
    """Adds ``ts`` from the clock text of a trace that holds no dates.

    The day advances whenever the clock runs backwards within the key of ``layout``, which
    orders the calls. Lines of several processes can be slightly out of order; with ``slack``
    (seconds, at most half a day) only a clock that runs back by more than that starts a new day, and
    one that jumps ahead by more belongs to the day before. Rows without a clock text
    get a null.
    """
    seconds = (
        F.substring("ts_text", 1, 2).cast("long") * 3600
        + F.substring("ts_text", 4, 2).cast("long") * 60
        + F.substring("ts_text", 7, 2).cast("long")
    )
    fraction = F.rpad(F.substring("ts_text", 10, 6), 6, "0").cast("long")
    timed = calls.withColumn("_us", seconds * 1_000_000 + fraction)
    known = timed.filter(F.col("_us").isNotNull())

    inside = layout.inside()
    steps = known.withColumn("_turn", _turn(F.lag("_us").over(inside), F.col("_us"), slack))
    position = F.struct(*layout.order)
    pieces = steps.groupBy(*layout.cell).agg(
        F.sum("_turn").alias("_turns"),
        F.min_by("_us", position).alias("_first_us"),
        F.max_by("_us", position).alias("_last_us"),
    )
    across = layout.across()
    edge = _turn(F.lag("_last_us").over(across), F.col("_first_us"), slack)
    upto = across.rowsBetween(Window.unboundedPreceding, 0)
    days = (
        pieces.withColumn("_edge", edge)
        .withColumn("_upto", F.sum(F.col("_turns") + F.col("_edge")).over(upto))
        .select(*layout.cell, (F.col("_upto") - F.col("_turns")).alias("_days_before"))
    )
    running = layout.inside().rowsBetween(Window.unboundedPreceding, 0)
    midnight = F.unix_micros(F.to_timestamp(F.lit(date)))
    day = (F.col("_days_before") + F.col("_turned")) * 86_400_000_000
    dated = (
        steps.withColumn("_turned", F.sum("_turn").over(running))
        .join(days, layout.cell)
        .withColumn("ts", F.timestamp_micros(midnight + day + F.col("_us")))
        .drop("_turn", "_turned", "_days_before", "_us")
    )
    unknown = timed.filter(F.col("_us").isNull()).drop("_us").withColumn("ts", F.lit(None).cast("timestamp"))
    return dated.unionByName(unknown)
