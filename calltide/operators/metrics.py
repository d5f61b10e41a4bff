"""Host metrics at the time of a call: the latest sample not after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calltide.session import materialise


def attach_metrics(
    calls: DataFrame,
    samples: DataFrame,
    key: str | tuple[str, ...] = "pid",
    time: str = "ts",
    partitions: int | None = None,
) -> DataFrame:
    """Adds the columns of the latest sample with ``time`` <= the call's, per key.

    Calls and samples form one timeline, dealt to range partitions by (key, time):
    a partition is a chunk of bounded size, whatever part of the rows a key has.
    The chunks are written once, as their bounds come from a sample. Inside a chunk
    a window carries the latest sample forward; what a chunk inherits is the last
    sample of the key's chunks before it, one small row per key and chunk. No array
    of samples is built and no key is ordered as a whole.

    Of samples at the same time the largest fields win. Calls without any earlier
    sample, key or time get nulls.
    """
    keys = [key] if isinstance(key, str) else list(key)
    fields = [c for c in samples.columns if c not in (*keys, time)]
    partitions = partitions or int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.unix_micros(F.col(time).cast("timestamp")).alias("_us")

    known = samples
    for name in (*keys, time):
        known = known.filter(F.col(name).isNotNull())
    packed = F.struct(*fields)
    points = known.groupBy(*keys, at).agg(F.max(packed).alias("_sample")).withColumn("_call", F.lit(None).cast("string"))
    whole = F.struct(*[F.col(f"`{c}`") for c in calls.columns])
    asked = calls.select(*keys, at, whole.alias("_call"))
    empty = F.lit(None)
    timeline = asked.withColumn("_sample", empty.cast(points.schema["_sample"].dataType)).unionByName(
        points.withColumn("_call", empty.cast(asked.schema["_call"].dataType))
    )
    # A sample comes before the calls of its time.
    timeline = timeline.withColumn("_kind", F.when(F.col("_call").isNull(), 0).otherwise(1))
    dealt = timeline.repartitionByRange(partitions, *keys, "_us", "_kind")
    chunked = materialise(dealt.withColumn("_chunk", F.spark_partition_id()), "timeline")

    inside = Window.partitionBy(*keys, "_chunk").orderBy("_us", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    newest = F.max_by("_sample", F.when(F.col("_sample").isNotNull(), F.col("_us")))
    inherited = (
        chunked.groupBy(*keys, "_chunk")
        .agg(newest.alias("_newest"))
        .withColumn("_before", F.last("_newest", ignorenulls=True).over(earlier))
        .drop("_newest")
    )
    carried = chunked.withColumn("_last", F.last("_sample", ignorenulls=True).over(inside))
    same = carried["_chunk"] == inherited["_chunk"]
    for name in keys:
        same = same & carried[name].eqNullSafe(inherited[name])
    found = (
        carried.filter(F.col("_kind") == 1)
        .join(inherited, same, "left")
        .withColumn("_found", F.when(F.col("_us").isNotNull(), F.coalesce("_last", "_before")))
    )
    return found.select("_call.*", *[F.col(f"_found.{f}").alias(f) for f in fields])
