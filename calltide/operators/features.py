"""Feature columns and splits for the models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltide.functions.scalar import derived_call_features, uniform
from calltide.operators.chunks import rank_rows

# Model inputs in their order.
CALL_FEATURES = (
    "syscall_name_encoded category_encoded latency_us base_latency_us latency_ratio latency_log "
    "cpu_usage memory_usage cpu_memory_ratio context_switches risk_level efficiency_score "
    "process_type_encoded"
).split()
PROCESS_FEATURES = (
    "lat_mean lat_std lat_max syscall_count cpu_mean cpu_max mem_mean mem_max ctx_sum "
    "high_lat_count redundant_count risk_mean efficiency high_lat_ratio redundancy_ratio "
    "latency_cv process_type_encoded"
).split()
CALL_LABELS = ("syscall_name", "category", "process_type")


def with_known_process_type(calls: DataFrame) -> DataFrame:
    """Traces hold no process type; the features always do."""
    if "process_type" not in calls.columns:
        return calls.withColumn("process_type", F.lit("unknown"))
    return calls.withColumn("process_type", F.coalesce("process_type", F.lit("unknown")))


def call_features(calls: DataFrame) -> DataFrame:
    """The numeric inputs of the call models except the encoded labels; nulls are 0."""
    derived = with_known_process_type(calls).withColumns(derived_call_features())
    plain = [c for c in CALL_FEATURES if not c.endswith("_encoded")]
    return derived.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in plain})


def process_features(stats: DataFrame) -> DataFrame:
    plain = [c for c in PROCESS_FEATURES if not c.endswith("_encoded")]
    return stats.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in plain})


def hash_split(df: DataFrame, *key: str, train: float = 0.8, seed: str = "42") -> DataFrame:
    """Adds ``part``: train or test by a hash of the key, the same in every run."""
    return df.withColumn("part", F.when(uniform(seed, *key) < train, "train").otherwise("test"))


def shuffled(df: DataFrame, key: str, seed: str = "42") -> DataFrame:
    """Adds ``place``: the row's position in a reproducible random order."""
    mixed = F.md5(F.concat_ws("|", F.lit(seed), F.col(key)))
    placed = df.withColumn("_mix", mixed).withColumn("_all", F.lit(0))
    return rank_rows(placed, ("_all",), ("_mix", key), "place").drop("_mix", "_all")
