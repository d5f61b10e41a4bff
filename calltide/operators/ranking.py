"""Exact rank statistics of scores, at any number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltide.operators.chunks import Layout, with_running
from calltide.session import materialise


def exact_auc(
    scored: DataFrame, score: str, label: str, keys: tuple[str, ...] = (), partitions: int | None = None
) -> DataFrame:
    """Area under the ROC curve per key: auc, positives, negatives; ties count half.

    Rows of equal score are counted together first, map-side. The distinct scores are dealt
    to range partitions, chunks of bounded size whose negatives are summed up; one row per
    chunk carries the sum on. No score is binned and no key is ordered as a whole.
    Rows without a score or label take no part; with one class only the area is null.
    """
    keys = list(keys)
    partitions = partitions or int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_positive = F.col(label).cast("double") > 0.5
    known = scored.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    counts = known.groupBy(*keys, F.col(score).cast("double").alias("_score")).agg(
        F.count_if(is_positive).alias("_pos"), F.count_if(~is_positive).alias("_neg")
    )
    dealt = counts.repartitionByRange(partitions, *keys, "_score").withColumn("_part", F.spark_partition_id())
    held = materialise(dealt, "scores").withColumn("_all", F.lit(0))
    layout = Layout(tuple(keys) or ("_all",), ("_part",), ("_score",))
    placed = with_running(held, layout, {"_upto": F.col("_neg")})
    # Twice the negatives below a positive, those of its own score counted once.
    twice = (F.col("_upto") * 2 - F.col("_neg")).cast("decimal(38,0)") * F.col("_pos")
    total = placed.groupBy(*keys).agg(
        F.sum(twice).alias("_won"), F.sum("_pos").alias("positives"), F.sum("_neg").alias("negatives")
    )
    pairs = F.col("positives").cast("double") * F.col("negatives") * 2
    return total.select(*keys, F.try_divide(F.col("_won").cast("double"), pairs).alias("auc"), "positives", "negatives")
