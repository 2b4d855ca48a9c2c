"""Feature derivation, target transform, weights and output classes.

Every derived feature is a column expression, emitted in one
``withColumns`` so Catalyst collapses them into a single projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Epsilon added to every denominator.
EPS = 1e-6

# Adjacent-sieve ratios (name, numerator, denominator).
RATIOS = [
    ("ratio_9_25", "p9_5", "p25_4"),
    ("ratio_4_9", "p4_8", "p9_5"),
    ("ratio_2_4", "p2_0", "p4_8"),
    ("ratio_042_2", "p0_42", "p2_0"),
    ("ratio_076_042", "p0_076", "p0_42"),
]

# Prediction classes (below 2 very low, above 100 atypical).
ALERT_LOW = 2.0
ALERT_HIGH = 100.0


@dataclass(frozen=True)
class Derived:
    name: str
    inputs: tuple[str, ...]
    expr: Column


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def ratio(num: Column, den: Column, eps: float = EPS) -> Column:
    """``num / (den + eps)``; a zero denominator gives null, not an error (F1)."""
    return F.try_divide(num, den + F.lit(eps))


def derived_features(
    activity: str = "diff", compaction_name: str = "compacidade"
) -> list[Derived]:
    """The eight derived features in output order.

    ``activity='diff'`` is ``ll - ip``; ``'identity_ip'`` is the other
    definition, ``ll - (ll - ip)``, which equals ``ip``. ``compaction_name``
    names the density / moisture ratio (the two spellings in use).
    """
    out = [Derived(n, (a, b), ratio(_c(a), _c(b))) for n, a, b in RATIOS]
    if activity == "diff":
        act = _c("ll") - _c("ip")
    elif activity == "identity_ip":
        act = _c("ll") - (_c("ll") - _c("ip"))
    else:
        raise ValueError(f"unknown activity variant {activity!r}")
    out.append(Derived("atividade", ("ll", "ip"), act))
    out.append(Derived(compaction_name, ("d_max", "w_opt"), ratio(_c("d_max"), _c("w_opt"))))
    out.append(Derived("finos_sq", ("p0_076",), _c("p0_076") * _c("p0_076")))
    return out


def add_features(
    df: DataFrame,
    activity: str = "diff",
    compaction_name: str = "compacidade",
    scenario: list[str] | None = None,
) -> DataFrame:
    """Add the derived features (F6); with ``scenario`` only those whose
    inputs all belong to the scenario (F7). Target and other columns kept."""
    defs = derived_features(activity, compaction_name)
    if scenario is not None:
        s = set(scenario)
        defs = [d for d in defs if set(d.inputs) <= s]
    return df.withColumns({d.name: d.expr for d in defs})


def scenario_feature_names(
    scenario: list[str], activity: str = "identity_ip", compaction_name: str = "compactacao"
) -> list[str]:
    """Trained column order for a scenario: its base features, then the
    derived ones it allows (metadata ``feature_names``)."""
    s = set(scenario)
    return list(scenario) + [
        d.name for d in derived_features(activity, compaction_name) if set(d.inputs) <= s
    ]


def scenario_frame(
    df: DataFrame,
    scenario: list[str],
    feature_names: list[str] | None = None,
    activity: str = "identity_ip",
    compaction_name: str = "compactacao",
    keep: list[str] | None = None,
    all_base: list[str] | None = None,
) -> DataFrame:
    """Scenario scoring frame.

    Base features outside the scenario get a neutral 0.0 when absent, only
    derived features whose inputs are in the scenario are made, and the
    result is projected to ``feature_names`` (the trained order).
    """
    from loam.functions.cleaning import fill_missing_features
    from loam.schema import FEATURES

    base = all_base or FEATURES
    names = feature_names or scenario_feature_names(scenario, activity, compaction_name)
    df = fill_missing_features(df, base, 0.0)
    df = add_features(df, activity, compaction_name, scenario)
    return df.select(*[_c(k) for k in (keep or [])], *[_c(n) for n in names])


def log1p_target(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Target transform ``log1p`` (F8)."""
    return df.withColumn(out or col, F.log1p(_c(col)))


def expm1_col(col: str) -> Column:
    """Inverse transform."""
    return F.expm1(_c(col))


def target_range(df: DataFrame, col: str) -> DataFrame:
    """Min and max of the target before and after ``log1p`` (F10); one pass."""
    x = _c(col) + F.lit(0.0)
    return df.agg(
        F.min(x).alias("y_min"),
        F.max(x).alias("y_max"),
        F.min(F.log1p(x)).alias("log_min"),
        F.max(F.log1p(x)).alias("log_max"),
    )


def threshold_weight(
    y: Column,
    threshold: float = 25.0,
    w_minor: float = 3.0,
    w_major: float = 1.0,
    log_space: bool = False,
) -> Column:
    """Sample weight: ``w_minor`` above the threshold, else ``w_major``
    (F11). With ``log_space`` the label is ``log1p`` of the original and the
    threshold is moved to log space too."""
    import math

    thr = math.log1p(threshold) if log_space else threshold
    return F.when(y > F.lit(thr), F.lit(float(w_minor))).otherwise(F.lit(float(w_major)))


def alert_class(pred: Column, low: float = ALERT_LOW, high: float = ALERT_HIGH) -> Column:
    """Output class of a prediction."""
    return (
        F.when(pred < F.lit(low), F.lit("very_low"))
        .when(pred > F.lit(high), F.lit("atypical"))
        .otherwise(F.lit("normal"))
    )


def round2(c: Column) -> Column:
    """Two-decimal result."""
    return F.round(c, 2)
