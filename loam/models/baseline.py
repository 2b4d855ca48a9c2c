"""Weighted mean baseline regressor (M5) -- the reference point every
learner must beat, and the smallest estimator that honours ``weightCol``.

The fit is one aggregation (per group when ``groupCols`` is set). Group
means stay on the cluster: the small fitted table is checkpointed (so
scoring never re-aggregates the training data) and joined back without a
broadcast hint -- AQE broadcasts it when its run-time size is small, and
falls back to a shuffle join when there are many groups. The global mean
is the fallback for unseen groups.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable, MLReadable, MLReader, \
    MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.session import cut_lineage


class _MeanParams(Params):
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "output column", TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "weight column ('' = 1.0)", TypeConverters.toString)
    groupCols = Param(Params._dummy(), "groupCols", "per-group means", TypeConverters.toListString)

    def _w(self):
        w = self.getOrDefault("weightCol")
        return F.col(w).cast("double") if w else F.lit(1.0)


class MeanRegressor(Estimator, _MeanParams, DefaultParamsReadable, DefaultParamsWritable):
    """Predicts the (weighted) mean label of the training rows."""

    @keyword_only
    def __init__(self, *, labelCol="label", predictionCol="prediction", weightCol="", groupCols=None):
        super().__init__()
        self._setDefault(labelCol="label", predictionCol="prediction", weightCol="", groupCols=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame):
        y = F.col(self.getOrDefault("labelCol")).cast("double")
        w = self._w()
        row = df.agg((F.sum(w * y) / F.sum(w)).alias("m")).first()
        groups = self.getOrDefault("groupCols")
        table = None
        if groups:
            table = cut_lineage(
                df.groupBy(*groups).agg((F.sum(w * y) / F.sum(w)).alias("__gmean"))
            )
        m = MeanModel(globalMean=float(row["m"]) if row["m"] is not None else 0.0)
        m.group_means = table
        return self._copyValues(m)


class MeanModel(Model, _MeanParams, MLReadable, MLWritable):
    globalMean = Param(Params._dummy(), "globalMean", "fitted mean", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, globalMean=0.0, labelCol="label", predictionCol="prediction",
                 weightCol="", groupCols=None):
        super().__init__()
        self._setDefault(labelCol="label", predictionCol="prediction", weightCol="", groupCols=[],
                         globalMean=0.0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        self.group_means: DataFrame | None = None

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.getOrDefault("predictionCol")
        gm = F.lit(float(self.getOrDefault("globalMean")))
        groups = self.getOrDefault("groupCols")
        if not groups or self.group_means is None:
            return df.withColumn(out, gm)
        return df.join(self.group_means, groups, "left").withColumn(
            out, F.coalesce(F.col("__gmean"), gm)
        ).drop("__gmean")

    def copy(self, extra=None):
        c = super().copy(extra)
        c.group_means = self.group_means
        return c

    def write(self):
        return _MeanWriter(self)

    @classmethod
    def read(cls):
        return _MeanReader()


class _MeanWriter(MLWriter):
    def __init__(self, model: MeanModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        params = {p.name: m.getOrDefault(p) for p in m.params if m.isDefined(p)}
        spark = self.sparkSession
        spark.createDataFrame([(json.dumps(params),)], "params string").coalesce(1) \
            .write.mode("overwrite").json(f"{path}/params")
        if m.group_means is not None:
            m.group_means.write.mode("overwrite").parquet(f"{path}/group_means")


class _MeanReader(MLReader):
    def load(self, path: str) -> MeanModel:
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        params = json.loads(spark.read.json(f"{path}/params").first()["params"])
        m = MeanModel(**params)
        if params.get("groupCols"):
            m.group_means = spark.read.parquet(f"{path}/group_means")
        return m
