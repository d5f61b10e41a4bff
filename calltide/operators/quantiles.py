"""Exact percentiles that never gather a group's values in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltide.operators.sketches import sketch_value, value_sketch
from calltide.session import materialise

# Bands per power of two: a band is 0.02 % wide.
_PER_OCTAVE = 4096
# Even parts of a band's own range.
_PARTS = 4096
# Rows of a part whose values are ordered in one task.
LIMIT = 1 << 16
# Above -log2 of the smallest positive double, in bands.
_SHIFT = 1100 * _PER_OCTAVE


def _band(value: Column) -> Column:
    """A whole number that rises with the value."""
    size = F.floor(F.log2(F.abs(value)) * _PER_OCTAVE) + _SHIFT
    band = F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0)).cast("long")
    return F.coalesce(band, F.lit(0).cast("long"))


def _hit(want: str, before: Column, inside: Column) -> Column:
    """Those wanted ranks that lie among the ``inside`` rows after the first ``before``."""
    return F.filter(want, lambda r: (r.rank >= before) & (r.rank < before + inside))


def _holding(parts: DataFrame, cell: list[str], within: list[str], order: str) -> DataFrame:
    """The parts (counted, with ``_start`` and ``_want`` of what they are parts of) that hold a wanted rank."""
    upto = F.sum("_n").over(Window.partitionBy(*cell, *within).orderBy(order))
    return (
        parts.withColumn("_before", F.col("_start") + upto - F.col("_n"))
        .withColumn("_want", _hit("_want", F.col("_before"), F.col("_n")))
        .filter(F.size("_want") > 0)
        .select(*cell, "_id", "_n", "_low", "_high", F.col("_before").alias("_start"), "_want")
    )


def quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    keys: tuple[str, ...] = (),
    approx: bool = False,
    limit: int = LIMIT,
) -> DataFrame:
    """One row per key with a column per entry of ``probs`` (linear interpolation).

    The rows are counted by narrow bands of the value, which combines map-side to a
    few thousand rows per task and needs no order. Running totals tell which bands
    hold the wanted ranks. A band hit that holds more than ``limit`` rows is cut into even
    parts of its own range, and so are its parts, until those hit hold no more than ``limit`` rows
    or one value only. A part is at most 1 / 4096 as wide as what it is a part of, so
    this ends after a few rounds whatever the data. The values of the parts hit are
    counted, equal ones together, and ordered: at most ``limit`` of them in a task for each part.
    A round reads the rows once more; the parts, a few rows for every key, are written.

    ``approx`` takes the values from one mergeable sketch per key instead (see
    ``operators.sketches`` for sketches that are kept).
    """
    keys = list(keys)
    known = df.filter(F.col(value).isNotNull())
    for key in keys:
        known = known.filter(F.col(key).isNotNull())
    if approx:
        sketched = known.groupBy(*keys).agg(value_sketch(value).alias("_sketch"))
        return sketched.select(*keys, *[sketch_value("_sketch", p).alias(name) for name, p in probs.items()])

    cell = keys or ["_all"]
    source = known if keys else known.withColumn("_all", F.lit(0))
    rows = source.select(*cell, F.col(value).alias("_value"))

    exact_rank = lambda p: (F.col("_total") - 1) * F.lit(float(p))
    ranks = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.lit(end).alias("end"),
                (F.floor if end == "lo" else F.ceil)(exact_rank(p)).cast("long").alias("rank"),
                (exact_rank(p) - F.floor(exact_rank(p))).alias("part"),
            )
            for i, p in enumerate(probs.values())
            for end in ("lo", "hi")
        ]
    )
    size = [F.count(F.lit(1)).alias("_n"), F.min("_value").alias("_low"), F.max("_value").alias("_high")]

    def small(parts: DataFrame) -> DataFrame:
        # Without keys at most two parts per entry of `probs`; else Spark knows the size of the written table.
        return parts if keys else F.broadcast(parts)

    banded = rows.withColumn("_band", _band(F.col("_value")))
    bands = (
        banded.groupBy(*cell, "_band")
        .agg(*size)
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(*cell)))
        .withColumn("_start", F.lit(0).cast("long"))
        .withColumn("_want", ranks)
        .withColumn("_id", F.col("_band").cast("string"))
    )
    parts = materialise(_holding(bands, cell, [], "_band"), "quantile-parts")
    inside = banded.withColumn("_id", F.col("_band").cast("string")).drop("_band")
    while parts.filter((F.col("_n") > limit) & (F.col("_low") < F.col("_high"))).limit(1).count():
        share = (F.col("_value") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0).cast("double"))
        part = F.coalesce(F.floor(share * _PARTS).cast("long"), F.lit(0).cast("long"))
        parted = inside.join(small(parts), [*cell, "_id"]).withColumn("_part", part)
        counted = (
            parted.groupBy(*cell, "_id", "_part")
            .agg(*size, F.first("_start").alias("_start"), F.first("_want").alias("_want"))
            .withColumnRenamed("_id", "_whole")
            .withColumn("_id", F.concat_ws(".", "_whole", F.col("_part").cast("string")))
        )
        inside = parted.select(*cell, "_value", F.concat_ws(".", "_id", F.col("_part").cast("string")).alias("_id"))
        parts = materialise(_holding(counted, cell, ["_whole"], "_part"), "quantile-parts")

    counts = (
        inside.join(small(parts.select(*cell, "_id", "_start", "_want")), [*cell, "_id"])
        .groupBy(*cell, "_id", "_value")
        .agg(F.count(F.lit(1)).alias("_n"), F.first("_start").alias("_start"), F.first("_want").alias("_want"))
    )
    upto = F.col("_start") + F.sum("_n").over(Window.partitionBy(*cell, "_id").orderBy("_value"))
    hits = counts.withColumn("_upto", upto).select(
        *cell, "_value", F.explode(_hit("_want", F.col("_upto") - F.col("_n"), F.col("_n"))).alias("_hit")
    )

    def end_value(i, end):
        return F.max(F.when((F.col("_hit.i") == i) & (F.col("_hit.end") == end), F.col("_value")))

    ends = hits.groupBy(*cell).agg(
        *[end_value(i, end).alias(f"_{end}{i}") for i in range(len(probs)) for end in ("lo", "hi")],
        *[
            F.max(F.when(F.col("_hit.i") == i, F.col("_hit.part"))).alias(f"_part{i}")
            for i in range(len(probs))
        ],
    )
    return ends.select(
        *keys,
        *[
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_part{i}")).alias(name)
            for i, name in enumerate(probs)
        ],
    )
