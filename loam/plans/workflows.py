"""End-to-end workflows: the tree-ensemble job and the MLP job.

Sizes default to the source's (150 draws x 10 folds per tree model; 20
MLP draws, 100 search epochs with patience 5, final fit of 300 epochs with
patience 15 and the LR plateau rule); tests run them with tiny sizes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.models import mlp, search
from loam.operators import diagnostics, metrics
from loam.plans import training
from loam.schema import FEATURE_LABELS
from loam.sources import artifacts


@dataclass
class SearchSizes:
    n_iter: int = search.TREE_DRAWS
    folds: int = search.CV_FOLDS
    parallelism: int = 4
    overrides: dict = field(default_factory=dict)   # e.g. cap trees in tests
    use_weights_in_search: bool = False             # the source searched unweighted


@dataclass
class TreeResult:
    model: object
    prepared: training.Prepared
    best: dict
    search_results: dict
    metrics: DataFrame
    importances: DataFrame
    individuals: object         # the members refitted without weights
    comparison: DataFrame       # ensemble and refits on the test rows against the goal


def tree_ensemble(df: DataFrame, cfg: training.TrainConfig, sizes: SearchSizes | None = None,
                  save_to: str | None = None, scenario: str = "all") -> TreeResult:
    """Search RF, GB and ET on the training rows (K-fold CV), refit the
    weighted voting ensemble on train+validation with the best parameters,
    evaluate on the original scale, refit each model without weights, compare
    these on the test rows and rank their importances, optionally save."""
    sizes = sizes or SearchSizes()
    p = training.prepare(df, cfg)
    train = p.df.filter(F.col("split") == "train")
    spaces = {"rf": search.RF_SPACE, "gb": search.GB_SPACE, "et": search.ET_SPACE}
    best, results = {}, {}
    for kind, space in spaces.items():
        res = search.random_search_cv(
            train, kind, space, n_iter=sizes.n_iter, k=sizes.folds, key_cols=cfg.key_cols,
            seed=cfg.seed, feature_names=p.feature_names,
            weight="weight" if sizes.use_weights_in_search and cfg.use_weights else None,
            overrides=sizes.overrides, parallelism=sizes.parallelism,
        )
        results[kind] = res
        best[kind] = {**search.best_params(res), **sizes.overrides}
    cfg.rf_params, cfg.gb_params, cfg.et_params = best["rf"], best["gb"], best["et"]
    model = training.fit_ensemble(p)
    met = training.evaluate(model, p)
    # without weights the refits would be the members over again
    alone = training.fit_individuals(p) if cfg.use_weights else model
    compared = metrics.model_comparison(training.evaluate_all(model, alone, p), goal=cfg.goal_mse)
    imp = diagnostics.importance_rank(training.importances(alone, p.feature_names), ["rf", "et"],
                                      labels=FEATURE_LABELS)
    if save_to:
        artifacts.save_artifacts(save_to, p.scaler, model, {
            "cenario": scenario, "features_cenario": list(cfg.features),
            "feature_names": p.feature_names, "log_target": cfg.log_target,
            "activity": cfg.activity, "compaction_name": cfg.compaction_name,
        })
    return TreeResult(model, p, best, results, met, imp, alone, compared)


@dataclass
class MLPSizes:
    draws: int = search.MLP_DRAWS
    search_epochs: int = 100
    search_patience: int = 5
    final_epochs: int = 300
    final_patience: int = 15
    shards: int = 8


@dataclass
class MLPResult:
    model: mlp.MLPModel
    search_results: DataFrame
    history: DataFrame
    metrics: DataFrame
    early_stop: DataFrame


def mlp_job(df: DataFrame, cfg: training.TrainConfig, sizes: MLPSizes | None = None) -> MLPResult:
    """Random search over (lr, batch, dropout) with early stopping on the
    validation rows, then a fit on train with validation-only early stopping
    and the LR plateau rule, which gives the epoch count; the final model is
    fitted anew on train + validation for that many epochs. Metrics on
    val (in sample by then) and test."""
    sizes = sizes or MLPSizes()
    p = training.prepare(df, cfg)
    draws = search.mlp_draws(sizes.draws, cfg.seed)
    base = mlp.MLPConfig(epochs=sizes.search_epochs, patience=sizes.search_patience,
                         shards=sizes.shards, seed=cfg.seed)
    weight = "weight" if cfg.use_weights else None
    res = mlp.search(p.df, p.feature_names, "label", draws, base, weight)
    best = diagnostics.search_best(res, "mae_val", "draw", payload=["lr", "batch_size", "dropout"]).first()
    final_cfg = mlp.MLPConfig(lr=best["lr"], batch_size=best["batch_size"], dropout=best["dropout"],
                              epochs=sizes.final_epochs, patience=sizes.final_patience,
                              reduce_lr=True, shards=sizes.shards, seed=cfg.seed)
    chosen = mlp.fit_many(p.df, p.feature_names, "label", [final_cfg], weight)
    hist = mlp.history_frame(df.sparkSession, chosen)
    both = p.df.withColumn("split", F.when(F.col("split") == "val", "train").otherwise(F.col("split")))
    epochs = max(1, chosen[0]["best_epoch"] + 1)
    refit_cfg = mlp.MLPConfig(**{**final_cfg.__dict__, "epochs": epochs, "reduce_lr": False})
    model, _ = mlp.fit(both, p.feature_names, "label", refit_cfg, weight)
    scored = model.transform(p.df.filter(F.col("split").isin("val", "test")))
    inv = F.expm1("prediction") if cfg.log_target else F.col("prediction")
    preds = scored.select(F.lit("mlp").alias("model"), "split", F.col("y_orig").alias("y"),
                          inv.alias("pred"))
    met = metrics.regression_metrics(preds, "y", "pred", ["model", "split"], goal=cfg.goal_mse)
    stop = diagnostics.early_stop(hist, "config", "epoch", "val_loss", sizes.final_patience)
    return MLPResult(model, res, hist, met, stop)
