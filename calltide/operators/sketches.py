"""Mergeable sketches: percentiles and distinct counts that roll up without the rows.

A table of sketches, say one row per trace, day and call name, is a few kilobytes for each
row. Any coarser grain, and any span of days, is a merge of its rows; the calls are not read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accuracy of value sketches: ranks within about 0.35 % at this size.
RANK_SIZE = 800
# Accuracy of distinct counts: a standard error of about 0.8 %.
DISTINCT_BITS = 14


def value_sketch(column: str) -> Column:
    """A sketch of the distribution of a column; nulls do not count."""
    return F.kll_sketch_agg_double(F.col(column).cast("double"), RANK_SIZE)


def merged_values(sketch: str) -> Column:
    return F.kll_merge_agg_double(sketch, RANK_SIZE)


def sketch_value(sketch: str, share: float) -> Column:
    """The value at a share of the ranks (0.95: the 95th percentile)."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(share)))


def distinct_sketch(column: str) -> Column:
    """A sketch of the set of a column's values; nulls do not count."""
    return F.hll_sketch_agg(column, DISTINCT_BITS)


def merged_sets(sketch: str) -> Column:
    return F.hll_union_agg(sketch)


def sketch_cube(
    calls: DataFrame,
    grain: tuple[str, ...],
    values: tuple[str, ...] = ("latency_us",),
    distinct: tuple[str, ...] = ("pid",),
) -> DataFrame:
    """Per cell of ``grain``: rows, a value sketch of every column of ``values`` and a set sketch of
    every column of ``distinct``. One pass; sketches are combined map-side."""
    return calls.groupBy(*grain).agg(
        F.count(F.lit(1)).alias("n"),
        *[value_sketch(c).alias(f"{c}_values") for c in values],
        *[distinct_sketch(c).alias(f"{c}_set") for c in distinct],
    )


def roll_up(cube: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The sketches of a coarser grain (none of ``keys``: of everything)."""
    return cube.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        *[merged_values(c).alias(c) for c in cube.columns if c.endswith("_values")],
        *[merged_sets(c).alias(c) for c in cube.columns if c.endswith("_set")],
    )


def read_out(sketches: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """Estimates instead of sketches: ``<column>_distinct`` and, for each of ``shares``, ``<column>_<name>``."""
    plain = [c for c in sketches.columns if not c.endswith(("_values", "_set"))]
    return sketches.select(
        *plain,
        *[
            sketch_value(c, p).alias(f"{c.removesuffix('_values')}_{name}")
            for c in sketches.columns
            if c.endswith("_values")
            for name, p in (shares or {}).items()
        ],
        *[F.hll_sketch_estimate(c).alias(f"{c.removesuffix('_set')}_distinct") for c in sketches.columns if c.endswith("_set")],
    )
