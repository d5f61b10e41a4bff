"""Analysis and export history: tables of appended batches, partitioned by day.

Batches stand under one manifest (``plans.ledger``), so a reader sees whole batches only, and
``compact`` folds them into one snapshot with the newest row of every key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calltide.plans.ledger import Ledger

SOURCE_TYPES = ("file", "text", "sample", "live", "synthetic")
EXPORT_FORMATS = ("script", "json", "markdown")


def analysis_rows(
    analyses: DataFrame, source_type: str, created_at: Column, title: Column | None = None
) -> DataFrame:
    """History rows of per-trace analyses that carry ``user_id`` and ``trace_id``."""
    if source_type not in SOURCE_TYPES:
        raise ValueError(f"unknown source type {source_type!r}")
    filename = F.element_at(F.split("trace_id", "/"), -1)
    # Titles of analyses by source.
    titles = {
        "file": F.concat(F.lit("FileUpload_"), filename),
        "text": F.lit("PastedTextAnalysis"),
        "live": F.concat(F.lit("LiveTrace_"), F.substring("trace_id", 1, 30)),
    }
    title = titles.get(source_type, F.concat(F.lit(f"{source_type}_"), filename)) if title is None else title
    skip = {"user_id", "trace_id", "recommendations", "syscall_summary"}
    parsed = [c for c in ("parsed_lines", "skipped_lines", "errors", "total_errors") if c in analyses.columns]
    fields = [c for c in analyses.columns if c not in skip and c not in parsed]
    counts = F.transform_values("category_breakdown", lambda _, v: v["count"])
    return analyses.select(
        F.col("user_id").cast("long").alias("user_id"),
        "trace_id",
        title.alias("title"),
        F.lit(source_type).alias("source_type"),
        filename.alias("filename"),
        F.col("total_syscalls").cast("long").alias("total_syscalls"),
        F.to_json(F.struct(*fields)).alias("analysis_json"),
        F.to_json(F.coalesce("recommendations", F.array())).alias("recommendations_json"),
        F.to_json("syscall_summary").alias("syscall_summary_json"),
        F.to_json(counts).alias("category_summary_json"),
        (F.to_json(F.struct(*parsed)) if parsed else F.lit("{}")).alias("parse_stats_json"),
        created_at.cast("timestamp").alias("created_at"),
    )


def export_rows(texts: DataFrame, export_format: str, created_at: Column) -> DataFrame:
    """Export rows of report texts that carry ``user_id``, ``trace_id`` and ``content``."""
    if export_format not in EXPORT_FORMATS:
        raise ValueError(f"unknown format {export_format!r}")
    ending = {"script": ".sh", "json": ".json", "markdown": ".md"}[export_format]
    stem = "optimize_" if export_format == "script" else "report_"
    stamp = F.date_format(created_at.cast("timestamp"), "yyyyMMdd_HHmmss")
    return texts.select(
        F.col("user_id").cast("long").alias("user_id"),
        "trace_id",
        F.lit(export_format).alias("export_format"),
        F.concat(F.lit(stem), stamp, F.lit(ending)).alias("filename"),
        "content",
        created_at.cast("timestamp").alias("created_at"),
    )


# What tells the rows of the two histories apart.
ANALYSIS_KEYS = ("user_id", "trace_id")
EXPORT_KEYS = ("user_id", "trace_id", "export_format", "filename")


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to a history table. Running it twice is harmless: reads keep
    the latest row of a key. Rebalancing gathers a day's rows in few files and
    splits a day that is too large for one. Several writers may append at once."""
    dated = rows.withColumn("created_date", F.to_date("created_at")).hint("rebalance", "created_date")
    Ledger(rows.sparkSession, path, partition_by="created_date").put(dated)


def compact(spark: SparkSession, path: str, keys: tuple[str, ...] = ANALYSIS_KEYS) -> None:
    """Folds all batches of a history into one snapshot with the newest row of every key, by day.

    Readers that have begun go on with the batches they hold; those go with the next folding.
    """
    Ledger(spark, path, list(keys), order=["created_at"], partition_by="created_date").fold()


def _latest(df: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of every key. A hash of the whole row settles ties, so only the
    columns that a reader asks for travel, not the texts of all analyses."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("_mix"))
    mixed = df.withColumn("_mix", F.xxhash64(F.struct(*[c for c in df.columns if c not in keys])))
    kept = mixed.withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") == 1)
    return kept.select(*keys, *[c for c in df.columns if c not in keys])


def history(spark: SparkSession, path: str, user_id: int | None = None, since: str | None = None) -> DataFrame:
    """Latest analysis per (user, trace); a date bound prunes partitions."""
    rows = Ledger(spark, path).read_all()
    if since is not None:
        rows = rows.filter(F.col("created_date") >= F.to_date(F.lit(since)))
    if user_id is not None:
        rows = rows.filter(F.col("user_id") == user_id)
    return _latest(rows.drop("created_date"), list(ANALYSIS_KEYS))


def exports(spark: SparkSession, path: str, user_id: int | None = None) -> DataFrame:
    rows = Ledger(spark, path).read_all().drop("created_date")
    if user_id is not None:
        rows = rows.filter(F.col("user_id") == user_id)
    return _latest(rows, list(EXPORT_KEYS))


def latest_per_user(rows: DataFrame, k: int, tie: str = "trace_id") -> DataFrame:
    """The k newest rows of every user; ``place`` 1 is the newest."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), tie)
    return rows.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= k)


def history_table(rows: DataFrame, source_type: str | None = None, search: str | None = None) -> DataFrame:
    """The listing: date, title, type, calls and slow calls."""
    if source_type is not None:
        rows = rows.filter(F.col("source_type") == source_type)
    if search is not None:
        rows = rows.filter(F.lower("title").contains(search.lower()))
    return rows.select(
        "user_id",
        "trace_id",
        F.date_format("created_at", "MMM dd, yyyy HH:mm").alias("date"),
        "title",
        F.initcap("source_type").alias("type"),
        F.col("total_syscalls").alias("syscalls"),
        F.get_json_object("analysis_json", "$.high_latency_count").cast("long").alias("high_latency"),
    )


def history_counts(rows: DataFrame, by_source: bool = False) -> DataFrame:
    keys = ["user_id", "source_type"] if by_source else ["user_id"]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("analyses"))
