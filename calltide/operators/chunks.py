"""Order-dependent work on groups of any size.

A plain window over a trace puts the whole trace in one task. Here a trace is
an ordered run of chunks of bounded size. Rows are shuffled once, by (key,
chunk); what a chunk needs to know about the chunks before it travels in a
small table with one row per chunk, where the per-key window runs. A trace with
a third of all rows is spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltide.session import materialise

DEFAULT_SPAN = 1 << 16


@dataclass(frozen=True)
class Layout:
    """How rows are ordered: inside ``key`` by ``chunk``, inside a chunk by ``order``.

    ``order`` must be unique within a chunk.
    """

    key: tuple[str, ...]
    chunk: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def cell(self) -> list[str]:
        return [*self.key, *self.chunk]

    def inside(self):
        return Window.partitionBy(*self.cell).orderBy(*self.order)

    def across(self):
        return Window.partitionBy(*self.key).orderBy(*self.chunk)


def split_by_id(
    df: DataFrame, key: tuple[str, ...] | str, order: str, span: int = DEFAULT_SPAN
) -> tuple[DataFrame, Layout]:
    """Chunk by ranges of a unique integer id: at most ``span`` rows per chunk."""
    key = (key,) if isinstance(key, str) else tuple(key)
    chunked = df.withColumn("_chunk", F.expr(f"`{order}` div {int(span)}"))
    return chunked, Layout(key, ("_chunk",), (order,))


def with_recent(
    df: DataFrame, layout: Layout, value: str, depth: int, index: str | None = None
) -> DataFrame:
    """Adds ``_prev_1`` .. ``_prev_depth`` (the values before this row in its key)
    and ``_n_prev`` (how many there are, at most ``depth``). With ``index``, also
    the dense 0-based place in the key, from the same window."""
    inside = layout.inside()
    rows = df.withColumns(
        {"_pos": F.row_number().over(inside)}
        | {f"_lag_{i}": F.lag(value, i).over(inside) for i in range(1, depth + 1)}
    )

    newest = Window.partitionBy(*layout.cell).orderBy(*[F.desc(c) for c in layout.order])
    tails = (
        df.select(*layout.cell, *layout.order, F.col(value).alias("_value"))
        .withColumn("_back", F.row_number().over(newest))
        .filter(F.col("_back") <= depth)
        .groupBy(*layout.cell)
        .agg(F.array_sort(F.collect_list(F.struct("_back", "_value"))).alias("_tail"))
        .select(*layout.cell, F.col("_tail._value").alias("_tail"))
    )
    # Every chunk holds a row or more, so the `depth` chunks before reach far enough.
    before = layout.across().rowsBetween(-depth, -1)
    carried = {"_carry": F.slice(F.flatten(F.reverse(F.collect_list("_tail").over(before))), 1, depth)}
    if index is not None:
        tails = tails.join(df.groupBy(*layout.cell).agg(F.count(F.lit(1)).alias("_rows")), layout.cell)
        earlier = layout.across().rowsBetween(Window.unboundedPreceding, -1)
        carried["_off"] = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    carry = tails.select(*layout.cell, *[expr.alias(name) for name, expr in carried.items()])
    added = {
        f"_prev_{i}": F.when(F.col("_pos") > i, F.col(f"_lag_{i}")).otherwise(
            F.get("_carry", F.lit(i) - F.col("_pos"))
        )
        for i in range(1, depth + 1)
    }
    added["_n_prev"] = F.least(F.col("_pos") - 1 + F.size("_carry"), F.lit(depth))
    if index is not None:
        added[index] = F.col("_off") + F.col("_pos") - 1
    joined = rows.join(carry, layout.cell).withColumns(added)
    return joined.drop("_pos", *carried, *[f"_lag_{i}" for i in range(1, depth + 1)])


def with_running(df: DataFrame, layout: Layout, sums: dict[str, Column]) -> DataFrame:
    """Adds running sums within the key, the current row included."""
    fed = df.withColumns({f"_in_{name}": expr for name, expr in sums.items()})
    upto = layout.inside().rowsBetween(Window.unboundedPreceding, 0)
    rows = fed.withColumns({f"_run_{name}": F.sum(f"_in_{name}").over(upto) for name in sums})

    totals = fed.groupBy(*layout.cell).agg(*[F.sum(f"_in_{n}").alias(f"_sum_{n}") for n in sums])
    earlier = layout.across().rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *layout.cell,
        *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_off_{n}") for n in sums],
    )
    joined = rows.join(offsets, layout.cell)
    out = joined.withColumns({n: F.col(f"_run_{n}") + F.col(f"_off_{n}") for n in sums})
    return out.drop(*[f"_{part}_{n}" for n in sums for part in ("in", "run", "off")])


def with_index(df: DataFrame, layout: Layout, name: str) -> DataFrame:
    """Adds a dense 0-based index within the key."""
    counted = with_running(df, layout, {name: F.lit(1).cast("long")})
    return counted.withColumn(name, F.col(name) - 1)


def rank_rows(
    df: DataFrame, key: tuple[str, ...], order: tuple[str, ...], name: str, partitions: int | None = None
) -> DataFrame:
    """A dense 0-based index within ``key`` for any unique order of columns.

    Range partitioning on (key, order) balances the rows whatever the keys
    weigh; a row's place is its place in the partition plus the rows of its key
    in earlier partitions. The sorted rows are written once, since range
    boundaries come from a sample and must not be drawn again.
    """
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(partitions, *key, *order)
        .sortWithinPartitions(*key, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    stored = materialise(placed, "ranked")
    cells = stored.groupBy(*key, "_part").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(
        *key, "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off")
    )
    return (
        stored.join(offsets, [*key, "_part"])
        .withColumn(name, F.col("_row") - F.col("_first") + F.col("_off"))
        .drop("_part", "_row", "_first", "_off")
    )
