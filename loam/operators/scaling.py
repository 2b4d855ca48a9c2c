"""Min-max scaling fitted on training rows only.

The fit is one aggregation (min and max of every column in a single pass,
partially aggregated per task); the fitted scaler is a plain column
expression per feature, so applying it is free inside whole-stage codegen.
A constant column scales with divisor 1 (0 on training rows), and values
outside the training range are not clipped.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_minmax(df: DataFrame, columns: list[str], where: Column | None = None) -> dict:
    """Per-column (min, max) over the rows selected by ``where``."""
    src = df if where is None else df.filter(where)
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`").cast("double") + F.lit(0.0)
        aggs += [F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}")]
    row = src.agg(*aggs).first()
    return {c: (row[f"mn{i}"], row[f"mx{i}"]) for i, c in enumerate(columns)}


def minmax_expr(c: Column, lo: float, hi: float) -> Column:
    rng = (hi - lo) if (lo is not None and hi is not None) else None
    scale = 1.0 if (rng is None or rng == 0) else 1.0 / rng
    base = 0.0 if lo is None else lo
    return (c.cast("double") - F.lit(float(base))) * F.lit(scale)


def apply_minmax(df: DataFrame, bounds: dict, suffix: str = "") -> DataFrame:
    """Scale every fitted column in place (or to ``<col><suffix>``)."""
    return df.withColumns(
        {f"{c}{suffix}": minmax_expr(F.col(f"`{c}`"), lo, hi) for c, (lo, hi) in bounds.items()}
    )


class _MinMaxParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns to scale",
                      typeConverter=TypeConverters.toListString)
    splitCol = Param(Params._dummy(), "splitCol", "column naming the split ('' = all rows)",
                     typeConverter=TypeConverters.toString)
    fitSplits = Param(Params._dummy(), "fitSplits", "split values used for the fit",
                      typeConverter=TypeConverters.toListString)


class ColumnMinMaxScaler(Estimator, _MinMaxParams, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator form for pipelines: fits on ``splitCol in fitSplits`` rows
    only, so the leakage guard travels with the pipeline."""

    @keyword_only
    def __init__(self, *, inputCols=None, splitCol="", fitSplits=None):
        super().__init__()
        self._setDefault(splitCol="", fitSplits=["train"])
        kwargs = self._input_kwargs
        self._set(**{k: v for k, v in kwargs.items() if v is not None})

    def _fit(self, df: DataFrame):
        split = self.getOrDefault("splitCol")
        where = F.col(split).isin(self.getOrDefault("fitSplits")) if split else None
        bounds = fit_minmax(df, self.getOrDefault("inputCols"), where)
        m = ColumnMinMaxModel(boundsJson=json.dumps(bounds))
        return self._copyValues(m)


class ColumnMinMaxModel(Model, _MinMaxParams, DefaultParamsReadable, DefaultParamsWritable):
    boundsJson = Param(Params._dummy(), "boundsJson", "fitted {col: [min, max]}",
                       typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, boundsJson=None, inputCols=None, splitCol="", fitSplits=None):
        super().__init__()
        self._setDefault(splitCol="", fitSplits=["train"])
        kwargs = self._input_kwargs
        self._set(**{k: v for k, v in kwargs.items() if v is not None})

    @property
    def bounds(self) -> dict:
        return {k: tuple(v) for k, v in json.loads(self.getOrDefault("boundsJson")).items()}

    def _transform(self, df: DataFrame) -> DataFrame:
        return apply_minmax(df, self.bounds)
