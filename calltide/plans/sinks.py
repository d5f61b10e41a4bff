"""File sinks of call tables and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.schemas import CALL


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV files with a header, one per task."""
    df.write.mode(mode).option("header", "true").csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; nulls are kept as fields."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Calls of CSV files, by column name; columns the files lack are null.

    A value that its column's type cannot hold is null and counted in ``_mistyped``.
    """
    names = spark.read.option("header", "true").csv(path).columns
    kinds = {f.name: f.dataType for f in (schema or CALL).fields}
    text = spark.read.option("header", "true").csv(path)
    cast = {n: text[n].try_cast(kinds[n]) for n in names if n in kinds}
    lost = [(text[n].isNotNull() & c.isNull()).cast("int") for n, c in cast.items()]
    return text.select(
        *[cast[n].alias(n) if n in cast else text[n] for n in names],
        sum(lost, F.lit(0)).alias("_mistyped"),
    )


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return spark.read.schema(schema or CALL).json(path)
