"""Spark-side starting points shared by the checked queries."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.checks.base import NUDGE
from calltide.operators.aggregate import call_cube
from calltide.operators.label import label
from calltide.operators.score import RuleModel
from calltide.sources.tables import event_calls


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    calls = event_calls(spark, folder)
    return label(calls).withColumn("iteration", F.col("syscall_id") % 5 + 1)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return RuleModel.fit(event_calls(spark, folder)).transform(labelled(spark, folder))


def cube(spark: SparkSession, folder: str, keys: tuple[str, ...] = ()) -> DataFrame:
    return call_cube(scored(spark, folder), keys)


def r6(name: str, column: str | None = None):
    """Rounded like ``round(x, 6)`` in the SQL of the checks."""
    return F.round(F.col(column or name) + NUDGE, 6).alias(name)
