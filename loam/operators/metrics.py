"""Regression metrics and evaluation tables.

Every metric is one grouped aggregation (partial aggregation per task,
one small shuffle of per-group partial sums), so predictions are never
collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Goal for the test MSE on the original scale, and the MSE at
# or below which a result is flagged as suspicious.
GOAL_MSE = 0.780
SUSPICIOUS_MSE = 1.0


def regression_metrics(
    df: DataFrame,
    label: str = "y",
    pred: str = "pred",
    group_cols: list[str] | None = None,
    goal: float = GOAL_MSE,
    suspicious_at: float = SUSPICIOUS_MSE,
) -> DataFrame:
    """n, MSE, RMSE, MAE, R^2 per group plus two independent flags.

    R^2 = 1 - SSE / (n * var_pop(y)); null when the label is constant.
    ``suspicious`` is ``mse <= 1``; ``goal_met`` is ``mse < goal``.
    """
    groups = list(group_cols if group_cols is not None else ["model", "split"])
    y = F.col(f"`{label}`").cast("double")
    p = F.col(f"`{pred}`").cast("double")
    e = y - p
    agg = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        F.sum(e * e).alias("__sse"),
        F.var_pop(y).alias("__var"),
    )
    return agg.select(
        *groups,
        "n",
        "mse",
        F.sqrt("mse").alias("rmse"),
        "mae",
        F.when(F.col("__var") > 0, F.lit(1.0) - F.col("__sse") / (F.col("n") * F.col("__var")))
        .alias("r2"),
        (F.col("mse") <= F.lit(suspicious_at)).alias("suspicious"),
        (F.col("mse") < F.lit(goal)).alias("goal_met"),
    )


def metrics_wide(metrics: DataFrame, splits: list[str] | None = None,
                 group_cols: list[str] | None = None) -> DataFrame:
    """Metric table with one column per split (E4): unpivot with ``stack``,
    then ``pivot`` on a fixed list of split values (no extra job to find
    the distinct values)."""
    splits = splits or ["val", "test"]
    groups = list(group_cols or [])
    long = metrics.select(
        *groups,
        "split",
        F.expr("stack(4, 'mse', mse, 'rmse', rmse, 'mae', mae, 'r2', r2) AS (metric, value)"),
    )
    return long.groupBy(*groups, "metric").pivot("split", splits).agg(F.first("value"))


def model_comparison(metrics: DataFrame, split: str = "test", goal: float = GOAL_MSE) -> DataFrame:
    """MSE of every model on one split against the goal (E5)."""
    return metrics.filter(F.col("split") == split).select(
        "model",
        "mse",
        F.lit(float(goal)).alias("goal_mse"),
        (F.col("mse") < F.lit(goal)).alias("goal_met"),
        (F.col("mse") - F.lit(goal)).alias("gap_to_goal"),
    )


def pred_vs_actual_limits(df: DataFrame, label: str = "y", pred: str = "pred",
                          group_cols: list[str] | None = None) -> DataFrame:
    """Axis limits of the predicted-vs-actual view (E6):
    ``least(min y, min pred) * 0.95`` and ``greatest(max y, max pred) * 1.05``."""
    groups = list(group_cols if group_cols is not None else ["split"])
    y = F.col(f"`{label}`") + F.lit(0.0)
    p = F.col(f"`{pred}`") + F.lit(0.0)
    return df.groupBy(*groups).agg(
        (F.least(F.min(y), F.min(p)) * F.lit(0.95)).alias("lim_lo"),
        (F.greatest(F.max(y), F.max(p)) * F.lit(1.05)).alias("lim_hi"),
    )


def residuals(df: DataFrame, label: str = "y", pred: str = "pred", out: str = "residual") -> DataFrame:
    """Residual ``y - pred``."""
    return df.withColumn(out, F.col(f"`{label}`") - F.col(f"`{pred}`"))


def mae_summary(metrics: DataFrame) -> DataFrame:
    """"On average the model is off by +-MAE" (E10)."""
    return metrics.select(
        *[c for c in metrics.columns if c in ("model", "split")],
        F.format_string("+-%.2f", F.col("mae")).alias("typical_error"),
    )
