"""Standardising by the population deviation, as a stage of a Spark ML pipeline."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Scaling(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns to standardise", TypeConverters.toListString)
    outputPrefix = Param(Params._dummy(), "outputPrefix", "before the names of the new columns", TypeConverters.toString)


class PopulationScaler(Estimator, _Scaling, DefaultParamsReadable, DefaultParamsWritable):
    """Learns mean and population deviation of columns; a deviation of zero counts as 1."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputPrefix: str = "scaled_"):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None}, outputPrefix=outputPrefix)

    def outputs(self) -> list[str]:
        return [self.getOrDefault("outputPrefix") + c for c in self.getOrDefault("inputCols")]

    def _fit(self, dataset: DataFrame) -> "PopulationScalerModel":
        columns = self.getOrDefault("inputCols")
        row = dataset.agg(*[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
        means, deviations = row[: len(columns)], row[len(columns) :]
        model = PopulationScalerModel()
        model._set(
            inputCols=columns,
            outputPrefix=self.getOrDefault("outputPrefix"),
            means=[m or 0.0 for m in means],
            deviations=[d or 1.0 for d in deviations],
        )
        return model


class PopulationScalerModel(Model, _Scaling, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the columns minus their mean over their deviation."""

    means = Param(Params._dummy(), "means", "mean of each column", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "population deviation of each column", TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        prefix = self.getOrDefault("outputPrefix")
        learned = zip(*(self.getOrDefault(name) for name in ("inputCols", "means", "deviations")))
        return dataset.withColumns({prefix + c: (F.col(c) - F.lit(m)) / F.lit(d) for c, m, d in learned})
