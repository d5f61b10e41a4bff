"""The process tree of a snapshot: children and depth from parent links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltide.session import materialise


def child_counts(processes: DataFrame, keys: tuple[str, ...] = ("hostname",)) -> DataFrame:
    """Adds ``children``. Counts combine map-side, so a parent of most processes is one row."""
    counts = (
        processes.filter(F.col("ppid") != F.col("pid"))
        .groupBy(*keys, F.col("ppid").alias("pid"))
        .agg(F.count(F.lit(1)).alias("children"))
    )
    return processes.join(counts, [*keys, "pid"], "left").withColumn(
        "children", F.coalesce("children", F.lit(0))
    )


def depths(processes: DataFrame, keys: tuple[str, ...] = ("hostname",)) -> DataFrame:
    """Adds ``depth``: 0 for processes whose parent is not in the snapshot.

    Pointer doubling: every step each process looks up the ancestor of its
    ancestor, so a chain of n takes log2(n) joins. Every lookup hits one row
    (pids are unique in a snapshot); each step is written out, which cuts the
    lineage. Every step settles at least one process of a chain that is still
    open, so when a step settles none, the rest is on or under a cycle of links
    and gets a null. There is no limit to the depth.
    """
    cell = [*keys, "pid"]
    links = processes.select(*cell, "ppid")
    known = links.select(*keys, F.col("pid").alias("ppid"), F.lit(True).alias("_known"))
    state = materialise(
        links.join(known, [*keys, "ppid"], "left").select(
            *cell,
            F.when(F.col("_known") & (F.col("ppid") != F.col("pid")), F.col("ppid")).alias("_up"),
        ).withColumn("_steps", F.when(F.col("_up").isNull(), 0).otherwise(1).cast("long")),
        "tree",
    )
    open_ = state.filter(F.col("_up").isNotNull()).count()
    before = open_ + 1
    while 0 < open_ < before:
        higher = state.select(
            *keys, F.col("pid").alias("_up"), F.col("_up").alias("_next"), F.col("_steps").alias("_more")
        )
        state = materialise(
            state.join(higher, [*keys, "_up"], "left").select(
                *cell,
                F.col("_next").alias("_up"),
                (F.col("_steps") + F.coalesce("_more", F.lit(0))).alias("_steps"),
            ),
            "tree",
        )
        before, open_ = open_, state.filter(F.col("_up").isNotNull()).count()
    done = state.select(*cell, F.when(F.col("_up").isNull(), F.col("_steps")).alias("depth"))
    return processes.join(done, cell, "left")
