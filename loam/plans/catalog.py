"""Registered queries (one per operator family of the inventory) and the
independent SQL each is checked against.

Every query reads the driver tables through :mod:`loam.plans.standins`
and runs the library's own operator on the whole table. Floating results
that come out of aggregations are rounded to 6 places in both engines so
that summation order does not decide equality.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.functions import cleaning, features
from loam.models.baseline import MeanRegressor
from loam.models.ensemble import VotingRegressor
from loam.operators import diagnostics, metrics, scaling, splits
from loam.plans import cleaning_job
from loam.plans import standins as S
from loam.schema import canonicalize_columns, to_soil_table
from loam.session import cut_lineage, ensure_checkpoint_dir
from loam.sources import files

Query = Callable[[SparkSession, str], DataFrame]


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(
        *[
            F.round(F.col(f.name), places).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


# ---------------------------------------------------------------- helpers
def _soil(spark, d) -> DataFrame:
    return to_soil_table(S.soil_raw(spark, d), S.LINEITEM_KEY)


def _events_split(spark, d) -> DataFrame:
    ev = S.events_predictions(spark, d)
    out, _ = splits.holdout_split(ev, ["event_id"], seed=42)
    return out


def _events_model_preds(spark, d) -> DataFrame:
    """Three fitted baselines over the events label, predictions rounded to
    2 places: per-type mean, global mean, and the zero predictor."""
    # the split (a shuffle) feeds two fits and three scorings: cut lineage
    ev = cut_lineage(_events_split(spark, d))
    train = ev.filter(F.col("split") == "train")
    gm = MeanRegressor(labelCol="y", predictionCol="pred", groupCols=["event_type"]).fit(train)
    glob = MeanRegressor(labelCol="y", predictionCol="pred").fit(train)
    base = ev.select("event_id", "event_type", "split", "y")
    parts = [
        gm.transform(base).withColumn("model", F.lit("group_mean")),
        glob.transform(base).withColumn("model", F.lit("global_mean")),
        base.withColumn("pred", F.lit(0.0)).withColumn("model", F.lit("zero")),
    ]
    out = None
    for p in parts:
        p = p.select("event_id", "split", "y", "model", F.round("pred", 2).alias("pred"))
        out = p if out is None else out.unionByName(p)
    return out


def _residuals(spark, d) -> DataFrame:
    p = _events_model_preds(spark, d).filter(F.col("model") == "group_mean")
    return metrics.residuals(p, "y", "pred")


# ---------------------------------------------------------------- queries
def q_scan_profile(spark, d):
    return files.profile(S.table(spark, d, "part"))


def q_canonical_columns(spark, d):
    return _soil(spark, d)


def q_parse_locale_number(spark, d):
    df = S.acctbal_br_text(spark, d)
    return cleaning.parse_locale_numbers(df, ["c_name", "c_mktsegment", "acctbal"])


def q_parse_locale_bad_column(spark, d):
    df = S.acctbal_br_text(spark, d, spoil=True)
    return cleaning.parse_locale_numbers(df, ["acctbal"]).select("c_custkey", "acctbal")


def q_parse_decimal_comma(spark, d):
    p = S.table(spark, d, "part")
    txt = F.when(F.col("p_size") == 13, F.lit("n/a")).otherwise(
        F.regexp_replace(F.col("p_retailprice").cast("string"), r"\.", ",")
    )
    return p.select("p_partkey", cleaning.parse_decimal_comma(txt).alias("price"))


def _customer_masked(spark, d):
    c = S.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return cleaning.mask_outliers(c, ["c_nationkey", "c_acctbal"])


def q_mask_outliers(spark, d):
    return _customer_masked(spark, d)


def q_drop_incomplete(spark, d):
    return cleaning.drop_incomplete(_customer_masked(spark, d))


def q_cleaning_report(spark, d):
    return cleaning.cleaning_report(_customer_masked(spark, d))


def q_clean_job(spark, d):
    raw = canonicalize_columns(S.soil_dirty_text(spark, d))
    return cleaning.clean(raw)


def q_clean_folder(spark, d):
    """The cleaning job over a folder of CSV files in two layouts (order and
    spelling of the headers differ), written as a numbered version."""
    raw = S.soil_dirty_text(spark, d)
    # the files are in the local format throughout: a decimal comma
    raw = raw.select(*[
        F.replace(F.col(f"`{f.name}`").cast("string"), F.lit("."), F.lit(",")).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.DecimalType)) else F.col(f"`{f.name}`")
        for f in raw.schema.fields])
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/folders/{uuid.uuid4().hex}"
    other = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in raw.columns]), F.lit(2)) == 1
    turned = [F.col(f"`{c}`").alias(f" {c} ") for c in reversed(raw.columns)]
    for part in (raw.where(~other), raw.where(other).select(*turned)):
        part.write.mode("append").option("header", True).csv(f"{base}/in")
    done = cleaning_job.run(spark, f"{base}/in", f"{base}/out")
    wanted = q_clean_job(spark, d).schema
    out = spark.read.option("header", True).csv(done["path"])
    # a text file has no types: the keys were parsed as decimal numbers too
    typed = [F.col(f"`{f.name}`").cast("double") if isinstance(f.dataType, T.NumericType) else F.col(f"`{f.name}`") for f in wanted.fields]
    return out.select(*[c.cast(f.dataType).alias(f.name) for c, f in zip(typed, wanted.fields)])


def q_range_valid(spark, d):
    return cleaning.range_valid(_soil(spark, d))


def q_range_violations(spark, d):
    return cleaning.range_violations(_soil(spark, d), S.LINEITEM_KEY)


def q_ratio_features(spark, d):
    f = features.add_features(_soil(spark, d))
    derived = [x.name for x in features.derived_features()]
    return f.select(*S.LINEITEM_KEY, *derived)


SCENARIO_A = ["p4_8", "p2_0", "p0_42", "p0_076", "ll", "ip"]


def q_scenario_features(spark, d):
    soil = _soil(spark, d)
    # the scoring input only carries the scenario's columns
    partial = soil.select(*S.LINEITEM_KEY, *SCENARIO_A)
    return features.scenario_frame(partial, SCENARIO_A, keep=S.LINEITEM_KEY)


def q_target_log1p(spark, d):
    ev = S.table(spark, d, "events").select("event_id", "value")
    t = features.log1p_target(ev, "value", "y_log")
    out = t.select("event_id", "y_log", F.expm1("y_log").alias("y_back"))
    return round_doubles(out)


def q_target_range(spark, d):
    return round_doubles(features.target_range(S.table(spark, d, "events"), "value"))


def q_sample_weights(spark, d):
    ev = S.table(spark, d, "events").select("event_id", "value")
    return ev.select(
        "event_id",
        features.threshold_weight(F.col("value"), 25.0).alias("weight"),
        features.threshold_weight(F.log1p("value"), 25.0, log_space=True).alias("weight_log"),
    )


def _orders_split(spark, d):
    o = S.table(spark, d, "orders").select("o_orderkey")
    return splits.holdout_split(o, ["o_orderkey"], seed=42)[0]


def q_holdout_split(spark, d):
    return _orders_split(spark, d)


def q_holdout_sizes(spark, d):
    return splits.split_report(_orders_split(spark, d))


def q_kfold_assign(spark, d):
    o = S.table(spark, d, "orders").select("o_orderkey")
    return splits.assign_folds(o, ["o_orderkey"], k=10, seed=42)


def q_row_index(spark, d):
    o = S.table(spark, d, "orders").filter(F.col("o_orderstatus") != "P").select("o_orderkey")
    return splits.row_index(o, "o_orderkey")


def q_row_index_text(spark, d):
    """Names that share their first nine characters."""
    c = S.table(spark, d, "customer").select("c_name", "c_nationkey")
    return splits.row_index(c, "c_name", ["c_nationkey"])


def q_row_index_wide(spark, d):
    """Keys that a double cannot tell apart."""
    o = S.table(spark, d, "orders").select((F.col("o_orderkey") + F.lit(1 << 60)).alias("key"))
    return splits.row_index(o, "key")


def q_row_index_hot(spark, d):
    """Three order values, ties by text, then by key."""
    o = S.table(spark, d, "orders").select("o_orderstatus", F.col("o_orderdate").cast("string").alias("day"), "o_orderkey")
    return splits.row_index(o, "o_orderstatus", ["day", "o_orderkey"])


def q_residual_kde_binned(spark, d):
    """The binned density, fine enough to agree in four places."""
    k = diagnostics.residual_kde(_residuals(spark, d), "residual", ["split"], method="binned", cells_per_bw=256)
    return k.select("split", "grid_index", F.round("x", 6).alias("x"), F.round("density", 4).alias("density"))


def q_minmax_scale(spark, d):
    p = S.table(spark, d, "part").select(
        "p_partkey", F.col("p_size").cast("double").alias("size"),
        F.col("p_retailprice").alias("price"), F.lit(1.0).alias("const"),
    )
    sp, _ = splits.holdout_split(p, ["p_partkey"], seed=42)
    est = scaling.ColumnMinMaxScaler(inputCols=["size", "price", "const"], splitCol="split")
    return round_doubles(est.fit(sp).transform(sp))


def q_weighted_mean_baseline(spark, d):
    ev = _events_split(spark, d).withColumn(
        "w", features.threshold_weight(F.col("y"), 25.0)
    )
    m = MeanRegressor(labelCol="y", predictionCol="pred", weightCol="w").fit(
        ev.filter(F.col("split") == "train")
    )
    scored = m.transform(ev)
    out = scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.first("pred").alias("pred"),
        F.avg((F.col("y") - F.col("pred")) ** 2).alias("mse"),
    )
    return round_doubles(out)


def q_voting_mean(spark, d):
    ev = _events_split(spark, d).withColumn("w", features.threshold_weight(F.col("y"), 25.0))
    members = [
        ("mean", MeanRegressor(labelCol="y")),
        ("wmean", MeanRegressor(labelCol="y", weightCol="w")),
        ("type_mean", MeanRegressor(labelCol="y", groupCols=["event_type"])),
    ]
    vm = VotingRegressor(members=members, predictionCol="pred").fit(
        ev.filter(F.col("split") == "train")
    )
    out = vm.transform(ev.filter(F.col("split") != "train"))
    return round_doubles(out.select("event_id", "split", "pred_mean", "pred_wmean",
                                    "pred_type_mean", "pred"))


def q_regression_metrics(spark, d):
    m = metrics.regression_metrics(_events_model_preds(spark, d), "y", "pred")
    return round_doubles(m)


def q_metrics_wide(spark, d):
    p = _events_model_preds(spark, d).filter(F.col("model") == "group_mean")
    m = metrics.regression_metrics(p, "y", "pred")
    return round_doubles(metrics.metrics_wide(m))


def q_model_comparison(spark, d):
    m = metrics.regression_metrics(_events_model_preds(spark, d), "y", "pred")
    return round_doubles(metrics.model_comparison(m))


def q_mae_summary(spark, d):
    p = _events_model_preds(spark, d).filter(F.col("model") == "group_mean")
    return metrics.mae_summary(metrics.regression_metrics(p, "y", "pred"))


def q_residuals(spark, d):
    return round_doubles(_residuals(spark, d).select("event_id", "split", "residual"))


def q_pred_vs_actual_limits(spark, d):
    p = _events_model_preds(spark, d).filter(F.col("model") == "group_mean")
    return round_doubles(metrics.pred_vs_actual_limits(p, "y", "pred"))


def q_residual_histogram(spark, d):
    return round_doubles(diagnostics.residual_histogram(_residuals(spark, d), "residual", ["split"]))


def q_residual_kde(spark, d):
    k = diagnostics.residual_kde(_residuals(spark, d), "residual", ["split"])
    return round_doubles(k)


def _user_results(spark, d):
    e = S.table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("model"), F.col("user_id").alias("draw")).agg(
        F.round(F.avg("value"), 6).alias("mae_val")
    )


def q_search_rank(spark, d):
    e = S.table(spark, d, "events")
    res = e.groupBy(F.col("user_id").alias("draw")).agg(F.round(F.avg("value"), 6).alias("mae_val"))
    return diagnostics.search_rank(res, "mae_val", "draw")


def q_search_best(spark, d):
    return diagnostics.search_best(_user_results(spark, d), "mae_val", "draw", ["model"])


def q_early_stop(spark, d):
    e = S.table(spark, d, "events")
    hist = e.groupBy(
        F.col("event_type").alias("config"),
        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("epoch"),
    ).agg(F.round(F.avg("value"), 6).alias("val_loss"))
    return diagnostics.early_stop(hist, "config", "epoch", "val_loss", patience=5)


QUERIES: dict[str, Query] = {
    "scan_profile": q_scan_profile,
    "canonical_columns": q_canonical_columns,
    "parse_locale_number": q_parse_locale_number,
    "parse_locale_bad_column": q_parse_locale_bad_column,
    "parse_decimal_comma": q_parse_decimal_comma,
    "mask_outliers": q_mask_outliers,
    "drop_incomplete": q_drop_incomplete,
    "cleaning_report": q_cleaning_report,
    "clean_job": q_clean_job,
    "clean_folder": q_clean_folder,
    "range_valid": q_range_valid,
    "range_violations": q_range_violations,
    "ratio_features": q_ratio_features,
    "scenario_features": q_scenario_features,
    "target_log1p": q_target_log1p,
    "target_range": q_target_range,
    "sample_weights": q_sample_weights,
    "holdout_split": q_holdout_split,
    "holdout_sizes": q_holdout_sizes,
    "kfold_assign": q_kfold_assign,
    "row_index": q_row_index,
    "row_index_text": q_row_index_text,
    "row_index_wide": q_row_index_wide,
    "row_index_hot": q_row_index_hot,
    "minmax_scale": q_minmax_scale,
    "weighted_mean_baseline": q_weighted_mean_baseline,
    "voting_mean": q_voting_mean,
    "regression_metrics": q_regression_metrics,
    "metrics_wide": q_metrics_wide,
    "model_comparison": q_model_comparison,
    "mae_summary": q_mae_summary,
    "residuals": q_residuals,
    "pred_vs_actual_limits": q_pred_vs_actual_limits,
    "residual_histogram": q_residual_histogram,
    "residual_kde": q_residual_kde,
    "residual_kde_binned": q_residual_kde_binned,
    "search_rank": q_search_rank,
    "search_best": q_search_best,
    "early_stop": q_early_stop,
}
