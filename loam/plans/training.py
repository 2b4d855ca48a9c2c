"""Training job: soil table -> clean -> features -> exact split -> scaler
fitted on training rows -> sample weights -> RF + GBT + ET voting fit on
train+validation -> predictions on the original scale -> metrics.

The prepared table (one row per sample with ``split``, label, weight and
scaled features) is computed once and checkpointed to the shared
checkpoint folder: every later fit re-reads it instead of re-running the
split's shuffle, and a lost executor costs a re-read, not a recompute.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions import cleaning, features
from loam.models.ensemble import VotingRegressor, gradient_boosting
from loam.models.extratrees import ExtraTreesRegressor
from loam.models.forest import ForestRegressor
from loam.operators import metrics, scaling, splits
from loam.schema import FEATURES, TARGET
from loam.session import cut_lineage


@dataclass
class TrainConfig:
    features: list[str] = field(default_factory=lambda: list(FEATURES))
    derived: bool = False            # add the 8 derived features (saved with the model)
    activity: str = "diff"
    compaction_name: str = "compacidade"
    target: str = TARGET
    key_cols: list[str] = field(default_factory=list)
    log_target: bool = True
    use_weights: bool = True
    threshold: float = 25.0
    w_minor: float = 3.0
    w_major: float = 1.0
    test_size: float = 0.20
    val_size: float = 0.15
    seed: int = 42
    clean: bool = True
    checkpoint: bool = True
    layout: bool = True              # lay the table out by key and keep it in memory, for MLlib's and the forests' fits
    partitions: int = 16             # of the training table, at least; part of the fitted result (bagging, sampled cuts)
    rf_params: dict = field(default_factory=lambda: {"n_estimators": 100, "max_depth": 12})
    gb_params: dict = field(default_factory=lambda: {"n_estimators": 100, "max_depth": 4,
                                                     "learning_rate": 0.1})
    et_params: dict = field(default_factory=lambda: {"n_estimators": 50, "max_depth": 12})
    goal_mse: float = metrics.GOAL_MSE

    def feature_names(self) -> list[str]:
        names = list(self.features)
        if self.derived:
            names += [d.name for d in features.derived_features(self.activity, self.compaction_name)
                      if set(d.inputs) <= set(self.features)]
        return names


@dataclass
class Prepared:
    df: DataFrame                  # key, split, label, y_orig, weight, scaled features, features vector
    sizes: splits.SplitSizes
    scaler: scaling.ColumnMinMaxModel
    feature_names: list[str]
    config: TrainConfig

    def release(self) -> None:
        """Free the in-memory copy; later reads go to the written table."""
        self.df.unpersist()


#: Rows of a partition of the training table, on average at most.
PARTITION_ROWS = 1 << 19


def table_partitions(least: int, rows: int) -> int:
    return max(least, math.ceil(rows / PARTITION_ROWS))


def prepare(df: DataFrame, cfg: TrainConfig) -> Prepared:
    """Canonical soil table in, prepared training table out."""
    keys = list(cfg.key_cols)
    src = df.select(*keys, *cfg.features, cfg.target)
    if cfg.clean:
        src = cleaning.drop_incomplete(cleaning.mask_outliers(src, cfg.features + [cfg.target]))
    if cfg.derived:
        src = features.add_features(src, cfg.activity, cfg.compaction_name, cfg.features)
    names = cfg.feature_names()
    y = F.col(cfg.target).cast("double")
    label = F.log1p(y) if cfg.log_target else y
    src = src.withColumn("y_orig", y).withColumn("label", label)
    src = src.withColumn(
        "weight",
        features.threshold_weight(F.col("label"), cfg.threshold, cfg.w_minor, cfg.w_major,
                                  log_space=cfg.log_target)
        if cfg.use_weights else F.lit(1.0),
    )
    split_df, sizes = splits.holdout_split(src, keys, cfg.test_size, cfg.val_size, cfg.seed)
    if cfg.checkpoint:
        # the split's shuffle runs once; the scaler fit and every later
        # pass of the learners read the checkpoint (and survive executor loss)
        split_df = cut_lineage(split_df)
    # The layout depends on the keys, the configured count and the row count
    # alone: MLlib's bagging draws per partition, so core count and file layout
    # must not show.
    if keys and cfg.layout:
        # MLlib keeps a partition's rows as objects while it caches them, so
        # partitions do not grow beyond a number of rows.
        partitions = table_partitions(cfg.partitions, sizes.n)
        spread = F.pmod(F.xxhash64(*keys), F.lit(partitions)).cast("int")
        split_df = split_df.repartitionById(partitions, spread).sortWithinPartitions(*keys)
    scaler = scaling.ColumnMinMaxScaler(inputCols=names, splitCol="split", fitSplits=["train"])
    scaler_model = scaler.fit(split_df)
    scaled = scaler_model.transform(split_df)
    assembled = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="error") \
        .transform(scaled).select(*keys, "split", "label", "y_orig", "weight", *names, "features")
    # kept in memory for the iterative fits; a lost block is recomputed from
    # the written table, and release() frees it when the fits are done
    if cfg.layout:
        assembled = assembled.persist(StorageLevel.MEMORY_AND_DISK_DESER)
    return Prepared(assembled, sizes, scaler_model, names, cfg)


def ensemble_estimator(p: Prepared) -> VotingRegressor:
    cfg = p.config
    members = [
        ("rf", ForestRegressor.from_search_params(cfg.rf_params, p.feature_names, "label", seed=cfg.seed, keyCols=cfg.key_cols)),
        ("gb", gradient_boosting(cfg.gb_params, cfg.seed)),
        ("et", ExtraTreesRegressor.from_search_params(cfg.et_params, p.feature_names, "label",
                                                      seed=cfg.seed)),
    ]
    return VotingRegressor(members=members, predictionCol="prediction",
                           weightCol="weight" if cfg.use_weights else "")


def fit_ensemble(p: Prepared, members: list | None = None):
    """Voting fit on train + validation with sample weights (M4, M5, M9).
    ``members`` replaces the configured (name, estimator) list."""
    tv = p.df.filter(F.col("split").isin("train", "val"))
    est = ensemble_estimator(p)
    if members:
        est = VotingRegressor(members=members, predictionCol="prediction",
                              weightCol="weight" if p.config.use_weights else "")
    return est.fit(tv)


def fit_individuals(p: Prepared, members: list | None = None):
    """Every member refitted by itself on train + validation, without sample
    weights (M9): the models whose test metrics are compared with the
    ensemble's (E5) and whose importances are ranked (O1)."""
    tv = p.df.filter(F.col("split").isin("train", "val"))
    return VotingRegressor(members=members or ensemble_estimator(p).members).fit(tv)


def evaluate_all(ensemble, individuals, p: Prepared) -> DataFrame:
    """Metrics of the ensemble (validation rows in sample, test rows) and of the
    individual refits (test rows), on the original scale."""
    voted = predictions(ensemble, p).where("model = 'ensemble'")
    alone = predictions(individuals, p, ("test",)).where("model <> 'ensemble'")
    return metrics.regression_metrics(voted.unionByName(alone), "y", "pred",
                                      ["model", "split"], goal=p.config.goal_mse)


def predictions(model, p: Prepared, splits_: tuple = ("val", "test")) -> DataFrame:
    """Long table (key, split, model, y, pred) on the original scale.

    Validation rows were part of the voting fit, so they are labelled
    ``val_in_sample``.
    """
    keys = list(p.config.key_cols)
    scored = model.transform(p.df.filter(F.col("split").isin(*splits_)))
    inv = (lambda c: F.expm1(c)) if p.config.log_target else (lambda c: c)
    split_label = F.when(F.col("split") == "val", F.lit("val_in_sample")).otherwise(F.col("split"))
    cols = {"ensemble": "prediction"}
    cols.update({n: f"pred_{n}" for n, _ in model.members})
    # the model runs once per row; the per-model predictions are unpivoted
    # with one explode (a union of four selects would score four times)
    pairs = F.array(*[F.struct(F.lit(n).alias("model"), inv(F.col(c)).alias("pred"))
                      for n, c in cols.items()])
    return scored.select(*keys, split_label.alias("split"), F.col("y_orig").alias("y"),
                         F.explode(pairs).alias("__p")) \
        .select(*keys, "split", "__p.model", "y", "__p.pred")


def evaluate(model, p: Prepared) -> DataFrame:
    """Metrics per (model, split) on the original scale."""
    return metrics.regression_metrics(predictions(model, p), "y", "pred",
                                      ["model", "split"], goal=p.config.goal_mse)


def importances(model, names: list[str]) -> DataFrame:
    """One row per feature: RF and ET importances (input of O1)."""
    members = dict(model.members)
    rf = list(members["rf"].featureImportances)
    et = list(members["et"].featureImportances)
    spark = model_session()
    return spark.createDataFrame(
        [(n, float(a), float(b)) for n, a, b in zip(names, rf, et)],
        "feature string, rf double, et double",
    )


def model_session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()
