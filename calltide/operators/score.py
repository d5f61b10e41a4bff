"""Rule scoring of calls: exact, reproducible, no training labels needed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltide.functions.scalar import call_priority
from calltide.operators.label import latency_ratio

SCORE_COLUMNS = (
    "high_latency_probability",
    "optimization_probability",
    "anomaly_score",
    "pattern_cluster",
    "is_anomaly",
    "optimization_priority",
)


def _log_ratio() -> Column:
    return F.log(F.greatest(F.col("latency_ratio"), F.lit(0.001)))


@dataclass(frozen=True)
class RuleModel:
    """Mean and spread of the log latency ratio of the fitted calls."""

    mean: float
    std: float

    @classmethod
    def fit(cls, calls: DataFrame) -> "RuleModel":
        """One pass over two columns; catalogued calls need no labels for it."""
        if "latency_ratio" not in calls.columns:
            calls = calls.withColumn("latency_ratio", latency_ratio())
        row = calls.agg(F.avg(_log_ratio()), F.stddev_samp(_log_ratio())).first()
        return cls(float(row[0] or 0.0), float(row[1] or 0.0))

    def transform(self, calls: DataFrame) -> DataFrame:
        """Flags as probabilities, distance in standard deviations as anomaly
        score (negative beyond 3) and bands of the latency ratio as clusters."""
        distance = F.abs(_log_ratio() - self.mean) / (self.std if self.std > 0 else 1.0)
        ratio = F.col("latency_ratio")
        return (
            calls.withColumn("high_latency_probability", F.col("is_high_latency").cast("double"))
            .withColumn("optimization_probability", F.col("needs_optimization").cast("double"))
            .withColumn("anomaly_score", F.lit(0.3) - distance / 10)
            .withColumn(
                "pattern_cluster",
                F.when(ratio < 0.5, 0).when(ratio < 1, 1).when(ratio < 2, 2).when(ratio < 3, 3).otherwise(4),
            )
            .withColumn("is_anomaly", F.col("anomaly_score") < 0)
            .withColumn(
                "optimization_priority",
                call_priority(
                    F.col("high_latency_probability"),
                    F.col("optimization_probability"),
                    F.col("anomaly_score"),
                ),
            )
        )
