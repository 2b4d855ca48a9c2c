from loam.plans import training, workflows


def test_tree_workflow_tiny(spark, soil, tmpdir_path):
    cfg = training.TrainConfig(key_cols=["k"])
    sizes = workflows.SearchSizes(n_iter=2, folds=2, overrides={"n_estimators": 4, "max_depth": 4})
    r = workflows.tree_ensemble(soil, cfg, sizes, save_to=tmpdir_path + "/model")
    assert set(r.best) == {"rf", "gb", "et"}
    assert all(r.search_results[k].count() == 2 for k in r.best)
    mets = {(m.model, m.split) for m in r.metrics.collect()}
    assert ("ensemble", "test") in mets and ("et", "val_in_sample") in mets
    assert r.importances.count() == 10
    assert {m.model for m in r.comparison.collect()} == {"ensemble", "rf", "gb", "et"}


def test_individual_refits_take_no_weights(spark, soil):
    """The refits equal members fitted one by one without a weight column, and
    differ from the weighted members; the ensemble's rows stay as they were."""
    from loam.models.baseline import MeanRegressor

    cfg = training.TrainConfig(key_cols=["k"], log_target=False, threshold=30.0)
    p = training.prepare(soil, cfg)
    members = [("mean", MeanRegressor(labelCol="label")), ("ip", MeanRegressor(labelCol="label", groupCols=["ip"]))]
    voted, alone = training.fit_ensemble(p, members), training.fit_individuals(p, members)
    rows = p.df.where("split <> 'test'").select("label", "weight", "ip").collect()
    plain = sum(r.label for r in rows) / len(rows)
    weighted = sum(r.label * r.weight for r in rows) / sum(r.weight for r in rows)
    assert abs(dict(alone.members)["mean"].getOrDefault("globalMean") - plain) < 1e-9
    assert abs(dict(voted.members)["mean"].getOrDefault("globalMean") - weighted) < 1e-9
    assert abs(plain - weighted) > 0.1
    got = {(r.model, r.split): r for r in training.evaluate_all(voted, alone, p).collect()}
    assert set(got) == {("ensemble", "test"), ("ensemble", "val_in_sample"), ("mean", "test"), ("ip", "test")}
    test = p.df.where("split = 'test'").select("y_orig").collect()
    assert abs(got["mean", "test"].mse - sum((r.y_orig - plain) ** 2 for r in test) / len(test)) < 1e-6
    before = {(r.model, r.split): r for r in training.evaluate(voted, p).collect()}
    assert got["ensemble", "test"] == before["ensemble", "test"]


def test_mlp_workflow_tiny(spark, soil):
    cfg = training.TrainConfig(key_cols=["k"], use_weights=False)
    sizes = workflows.MLPSizes(draws=2, search_epochs=2, search_patience=1, final_epochs=3,
                               final_patience=2, shards=2)
    r = workflows.mlp_job(soil, cfg, sizes)
    assert r.search_results.count() == 2
    assert r.history.count() >= 1
    assert {m.split for m in r.metrics.collect()} == {"val", "test"}
    assert r.early_stop.count() == 1
