import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.models import extratrees, mlp, search
from loam.models.baseline import MeanRegressor
from loam.models.ensemble import VotingModel, VotingRegressor, gradient_boosting, random_forest
from loam.plans import scoring, training
from loam.schema import FEATURES
from loam.sources import artifacts


@pytest.fixture(scope="module")
def prepared(spark, soil):
    cfg = training.TrainConfig(key_cols=["k"], checkpoint=True,
                               rf_params={"n_estimators": 15, "max_depth": 6},
                               gb_params={"n_estimators": 15, "max_depth": 3},
                               et_params={"n_estimators": 6, "max_depth": 8, "max_features": 0.5})
    return training.prepare(soil, cfg)


def _mse(df, pred="prediction"):
    return df.select(F.avg((F.col("label") - F.col(pred)) ** 2)).first()[0]


def test_extratrees_beats_mean_and_respects_leaf_size(spark, prepared):
    tr = prepared.df.filter("split = 'train'")
    te = prepared.df.filter("split = 'test'")
    est = extratrees.ExtraTreesRegressor(inputCols=prepared.feature_names, labelCol="label",
                                         numTrees=5, maxDepth=10, minSamplesLeaf=4, seed=3)
    m = est.fit(tr)
    base = MeanRegressor(labelCol="label").fit(tr)
    assert _mse(m.transform(te)) < 0.5 * _mse(base.transform(te))
    # every leaf holds at least min_samples_leaf training rows
    X = np.asarray(tr.select(*prepared.feature_names).collect(), dtype=float)
    for tree in m.forest.arrays():
        leaves = extratrees.route(X, tree)
        assert np.bincount(leaves)[np.unique(leaves)].min() >= 4
    imp = np.asarray(m.featureImportances)
    assert math.isclose(imp.sum(), 1.0, rel_tol=1e-9)


def test_extratrees_partition_and_seed_invariant(spark, prepared):
    tr = prepared.df.filter("split = 'train'")
    kw = dict(inputCols=prepared.feature_names, labelCol="label", numTrees=3, maxDepth=5, seed=11)
    a = extratrees.ExtraTreesRegressor(**kw).fit(tr)
    b = extratrees.ExtraTreesRegressor(**kw).fit(tr.repartition(7))
    for ta, tb in zip(a.forest.arrays(), b.forest.arrays()):
        assert np.array_equal(ta["feature"], tb["feature"])
        assert np.allclose(ta["threshold"], tb["threshold"])
        assert np.allclose(ta["value"], tb["value"])


def test_extratrees_persistence(spark, prepared, tmpdir_path):
    tr = prepared.df.filter("split = 'train'")
    m = extratrees.ExtraTreesRegressor(inputCols=prepared.feature_names, labelCol="label",
                                       numTrees=2, maxDepth=4).fit(tr)
    path = os.path.join(tmpdir_path, "et")
    m.write().save(path)
    m2 = extratrees.ExtraTreesModel.load(path)
    a = [r.prediction for r in m.transform(tr).orderBy("k").collect()]
    b = [r.prediction for r in m2.transform(tr).orderBy("k").collect()]
    assert np.allclose(a, b)


def test_voting_is_mean_of_members_and_saves(spark, prepared, tmpdir_path):
    tv = prepared.df.filter("split in ('train', 'val')")
    model = training.fit_ensemble(prepared)
    out = model.transform(prepared.df.filter("split = 'test'")).collect()
    for r in out:
        assert math.isclose(r.prediction, (r.pred_rf + r.pred_gb + r.pred_et) / 3, rel_tol=1e-12)
    met = {(r.model, r.split): r for r in training.evaluate(model, prepared).collect()}
    base = MeanRegressor(labelCol="label").fit(tv)
    te = prepared.df.filter("split = 'test'")
    base_mse = te.select(F.avg((F.col("y_orig") - F.expm1(F.lit(base.getOrDefault("globalMean")))) ** 2)).first()[0]
    assert met[("ensemble", "test")].mse < base_mse
    assert ("ensemble", "val_in_sample") in met
    path = os.path.join(tmpdir_path, "vote")
    model.write().save(path)
    again = VotingModel.load(path)
    b = again.transform(prepared.df.filter("split = 'test'")).collect()
    assert np.allclose(sorted(r.prediction for r in out), sorted(r.prediction for r in b))


def test_weighted_mean_regressor(spark):
    df = spark.createDataFrame([(1.0, 1.0, "a"), (3.0, 3.0, "a"), (10.0, 1.0, "b")],
                               "label double, w double, g string")
    m = MeanRegressor(labelCol="label", weightCol="w").fit(df)
    assert math.isclose(m.getOrDefault("globalMean"), (1 + 9 + 10) / 5)
    g = MeanRegressor(labelCol="label", groupCols=["g"]).fit(df)
    new = spark.createDataFrame([("a",), ("c",)], "g string")
    got = {r.g: r.prediction for r in g.transform(new).collect()}
    assert got == {"a": 2.0, "c": 14.0 / 3}


def test_search_draws():
    d = search.draw_configs(search.RF_SPACE, 150, seed=42)
    assert len({tuple(sorted((k, str(v)) for k, v in c.items())) for c in d}) == 150
    assert search.space_size(search.RF_SPACE) == 1_895_400
    assert search.space_size(search.GB_SPACE) == 452_760
    assert search.space_size(search.ET_SPACE) == 231_660
    m = search.mlp_draws(20, 42)
    assert m == search.mlp_draws(20, 42) and len(m) == 20
    assert all(c["lr"] in search.MLP_LEARNING_RATES for c in m)


def test_cv_search_small(spark, prepared):
    tr = prepared.df.filter("split = 'train'")
    res = search.random_search_cv(tr, "rf", search.RF_SPACE, n_iter=2, k=3, key_cols=["k"],
                                  feature_names=prepared.feature_names,
                                  overrides={"n_estimators": 5, "max_depth": 4}).collect()
    assert len(res) == 2 and sum(r.is_best for r in res) == 1


def test_mlp_forward_and_training(spark, prepared):
    net = mlp.plain_network([np.array([[1.0, -1.0]]), np.array([[2.0], [1.0]])], [np.zeros(2), np.zeros(1)])
    X = np.array([[2.0], [-1.0]])
    assert np.allclose(mlp.forward_infer(net, X), [2 * 2 + 0.1 * -2, 2 * -0.1 + 1])
    cfg = mlp.MLPConfig(epochs=6, patience=3, batch_size=32, lr=3e-3, dropout=0.0, shards=2)
    model, hist = mlp.fit(prepared.df, prepared.feature_names, "label", cfg)
    h = hist.orderBy("epoch").collect()
    assert len(h) >= 2 and h[-1].loss < h[0].loss
    out = model.transform(prepared.df.filter("split = 'test'"))
    assert out.filter(F.col("prediction").isNull()).count() == 0


def test_scoring_batch_equals_stream_and_missing_artifacts(spark, prepared, tmpdir_path, soil):
    model = training.fit_ensemble(prepared)
    folder = os.path.join(tmpdir_path, "art")
    meta = {"cenario": "all", "features_cenario": list(FEATURES),
            "feature_names": prepared.feature_names, "log_target": True,
            "activity": "diff", "compaction_name": "compacidade"}
    artifacts.save_artifacts(folder, prepared.scaler, model, meta)
    with pytest.raises(artifacts.ArtifactsNotFoundError):
        artifacts.load_artifacts(spark, os.path.join(tmpdir_path, "nothing"))
    art = artifacts.load_artifacts(spark, folder)
    assert art.metadata["feature_names"] == prepared.feature_names
    samples = soil.limit(40).withColumn("ll", F.format_string("%.1f", "ll"))  # text input
    samples = samples.withColumn("ll", F.regexp_replace("ll", r"\.", ","))
    batch = {r.k: r.cbr_pred for r in scoring.score(samples, art, ["k"]).collect()}
    src = os.path.join(tmpdir_path, "in")
    samples.write.parquet(src)
    from loam.streaming.scoring import sample_stream, start_scoring

    q = start_scoring(sample_stream(spark, src, samples.schema), art, ["k"],
                      os.path.join(tmpdir_path, "pred"), os.path.join(tmpdir_path, "ck"))
    q.awaitTermination(120)
    streamed = {r.k: r.cbr_pred for r in spark.read.parquet(os.path.join(tmpdir_path, "pred")).drop("batch").collect()}
    assert streamed.keys() == batch.keys() and all(math.isclose(batch[k], streamed[k]) for k in batch)


def test_mean_model_persistence(spark, tmpdir_path):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "a"), (10.0, "b")], "label double, g string")
    m = MeanRegressor(labelCol="label", groupCols=["g"]).fit(df)
    path = os.path.join(tmpdir_path, "mean")
    m.write().save(path)
    from loam.models.baseline import MeanModel

    again = MeanModel.load(path)
    new = spark.createDataFrame([("a",), ("b",), ("z",)], "g string")
    a = {r.g: r.prediction for r in m.transform(new).collect()}
    b = {r.g: r.prediction for r in again.transform(new).collect()}
    assert a == b == {"a": 2.0, "b": 10.0, "z": 14.0 / 3}


def test_mlp_flat_roundtrip_and_average():
    a = mlp.init_params(4, mlp.MLPConfig(), seed=1)
    b = mlp.init_params(4, mlp.MLPConfig(), seed=2)
    a["t"], b["t"] = 10, 30
    back = mlp.unflat(mlp.flat(a), a)
    assert np.array_equal(mlp.flat(back), mlp.flat(a))
    avg = mlp.unflat((1 * mlp.flat(a) + 3 * mlp.flat(b)) / 4, a)
    assert np.allclose(avg["W"][0], (a["W"][0] + 3 * b["W"][0]) / 4) and avg["t"] == 25


def test_no_row_is_left_out_of_a_batch():
    for n in (1, 2, 3, 8, 9, 17, 33):
        for size in (1, 2, 8, 16):
            parts = mlp.batches_of(np.arange(n), size)
            assert set(np.concatenate(parts).tolist()) == set(range(n))
            assert all(len(p) >= 2 for p in parts)


def test_mlp_does_not_depend_on_arrow_batches(spark, prepared, monkeypatch):
    monkeypatch.setattr(mlp, "BLOCK_ROWS", 40)
    base = mlp.MLPConfig(epochs=2, batch_size=16, shards=3, seed=4)
    configs = [base, mlp.MLPConfig(**{**base.__dict__, "lr": 1e-2})]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    fitted = []
    try:
        for rows in ("7", "1000", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            fitted.append(mlp.fit_many(prepared.df, prepared.feature_names, "label", configs))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for other in fitted[1:]:
        for a, b in zip(fitted[0], other):
            assert np.allclose(mlp.flat(a["params"]), mlp.flat(b["params"]), atol=1e-12)
    alone = mlp.fit_many(prepared.df, prepared.feature_names, "label", configs[:1])
    assert np.allclose(mlp.flat(alone[0]["params"]), mlp.flat(fitted[0][0]["params"]), atol=1e-12)


def test_mlp_blocks_keep_every_row_in_order():
    import pandas as pd

    frames = [pd.DataFrame({"i": range(a, b)}) for a, b in ((0, 3), (3, 3), (3, 20), (20, 21))]
    parts = [p["i"].tolist() for p in mlp._blocks(frames, 8)]
    assert parts == [list(range(0, 8)), list(range(8, 16)), list(range(16, 21))]


def test_mlp_saves_loads_and_scores_alike(spark, tmpdir_path):
    df = spark.range(60).select(
        (F.col("id") / 60).alias("a"), F.pmod("id", F.lit(7)).cast("double").alias("b"),
        F.sin("id").alias("label"), F.when(F.col("id") % 5 == 0, "val").otherwise("train").alias("split"),
    )
    model, _ = mlp.fit(df, ["a", "b"], "label", mlp.MLPConfig(epochs=2, shards=2, batch_size=8, hidden=[4, 4, 4, 4]))
    model.write().overwrite().save(f"{tmpdir_path}/net")
    back = mlp.MLPModel.load(f"{tmpdir_path}/net")
    assert [r["prediction"] for r in back.transform(df).collect()] == [r["prediction"] for r in model.transform(df).collect()]


def test_extratrees_refuses_null_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0), (4.0, 5.0)], "x double, label double")
    with pytest.raises(Exception, match="null or NaN in training column x"):
        extratrees.ExtraTreesRegressor(inputCols=["x"], numTrees=2).fit(df)


def test_forest_does_not_depend_on_the_input_layout(spark, soil):
    from loam.plans import training

    sums = set()
    for parts in (3, 11):
        cfg = training.TrainConfig(key_cols=["k"], rf_params={"n_estimators": 4, "max_depth": 4}, partitions=4)
        p = training.prepare(soil.repartition(parts), cfg)
        m = training.ForestRegressor.from_search_params(cfg.rf_params, p.feature_names, "label", seed=1, keyCols=["k"]).fit(p.df)
        sums.add(round(sum(r["prediction"] for r in m.transform(p.df).select("prediction").collect()), 9))
        p.release()
    assert len(sums) == 1


def test_only_known_classes_are_loaded():
    from loam.models.registry import known_class

    with pytest.raises(ValueError):
        known_class("os.system")


def test_mlp_step_on_whole_vectors_follows_the_plain_formulas():
    cfg = mlp.MLPConfig(hidden=[5])
    start = mlp.init_params(3, cfg, 1)
    rng = np.random.RandomState(2)
    X, y, w = rng.rand(7, 3), rng.rand(7), rng.rand(7)
    p = mlp.in_training(start)
    loss, mse = mlp._train_batch(p, X, y, w, 0.01, 0.0, rng)
    z = X @ start["W"][0]
    zh = (z - z.mean(0)) / np.sqrt(z.var(0) + mlp.BN_EPS)
    e = np.where(zh > 0, zh, 0.1 * zh) @ start["W"][1][:, 0] - y
    assert np.isclose(mse, np.mean(e * e)) and np.isclose(loss, np.sum(w * np.abs(e)) / 7 + mlp.l2_penalty(start))
    # Adam's first step is the learning rate against the sign of the gradient
    grad = np.where(zh > 0, zh, 0.1 * zh).T @ (w * np.sign(e) / 7)
    assert np.allclose(p["W"][1][:, 0], start["W"][1][:, 0] - 0.01 * np.sign(grad), atol=1e-6)
    # weights, moments and gradients are views of one vector each; the given parameters stay
    theta, m, *_ = p["vectors"]
    assert p["t"] == 1 and start["t"] == 0 and np.shares_memory(p["W"][0], theta) and np.shares_memory(p["m"]["b"][1], m)
    assert np.array_equal(theta, np.concatenate([a.ravel() for k in ("W", "b", "gamma", "beta") for a in p[k]]))
    assert np.array_equal(mlp.flat(start), mlp.flat(mlp.init_params(3, cfg, 1)))


def test_mlp_shards_are_packed_in_hash_order(spark, monkeypatch):
    from pyspark.sql import functions as F

    df = spark.range(900).select(
        (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 60).cast("double").alias("b"),
        (F.col("id") % 30).cast("double").alias("y"), F.when(F.col("id") % 5 == 0, "val").otherwise("train").alias("split"))
    monkeypatch.setattr(mlp, "BLOCK_ROWS", 50)
    want = {}
    for r in df.select("*", F.xxhash64("a", "b", "y").alias("h")).collect():
        want.setdefault(r["h"] % 3, []).append((r["h"], r["a"], r["b"], r["y"], 1.0, r["split"] == "val"))
    for most in (mlp.SORT_ROWS, 20):  # one range of the hash a shard; many
        monkeypatch.setattr(mlp, "SORT_ROWS", most)
        data = mlp._sharded(df.repartition(4), ["a", "b"], "y", None, 3)
        for shard, rows in want.items():
            got = []
            for r in data.where(F.col("shard") == shard).collect():
                numbers, val = mlp._unpacked(r["block"], r["rows"], (np.float64, 4), (np.bool_, 1))
                got.append([(*map(float, x), bool(v)) for x, v in zip(numbers.T, val[0])])
            assert sum(got, []) == [x[1:] for x in sorted(rows)]
            assert all(len(b) == 50 for b in got[:-1])
        data.unpersist()


def test_rows_of_colliding_hashes_are_ordered_by_their_values():
    numbers = np.array([[2.0, 1.0, 1.0, 0.0], [5.0, 5.0, 5.0, 5.0], [1.0, 1.0, 1.0, 1.0]])
    at = mlp._in_order(np.array([3, 3, 3, 9]), numbers, np.array([False, True, False, False]))
    assert at.tolist() == [2, 1, 0, 3]


def test_mlp_queries_keep_no_second_copy_of_the_table(spark, monkeypatch):
    from loam.plans import learners

    kept = []
    monkeypatch.setattr(learners.training, "prepare", lambda df, cfg: kept.append(cfg.layout) or (_ for _ in ()).throw(KeyError))
    monkeypatch.setattr(learners, "_soil", lambda *a: None)
    for q in (learners.q_mlp_predict, learners.q_mlp_history, learners.q_mlp_search):
        with pytest.raises(KeyError):
            q(spark, "")
    assert kept == [False] * 3


def test_table_partitions_follow_the_rows():
    assert training.table_partitions(16, 500) == training.table_partitions(16, 16 << 19) == 16
    assert training.table_partitions(16, 216_000_000) == 412  # the rows of a partition stay bounded


def test_kept_tables_are_not_read_back_as_whole_blocks(spark):
    cfg = training.TrainConfig(key_cols=["k"], features=["a"], target="cbr", clean=False)
    df = spark.range(50).selectExpr("id as k", "id * 1.0D as a", "id + 2.0D as cbr")
    p = training.prepare(df, cfg)
    data = mlp._sharded(p.df, ["a"], "label", None, 2)
    for kept in (p.df, data):
        assert kept.storageLevel.useDisk and kept.storageLevel.deserialized
        kept.unpersist()
