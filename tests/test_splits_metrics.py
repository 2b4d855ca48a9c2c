import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.operators import diagnostics, metrics, ranking, scaling, splits


def test_split_sizes_rule():
    s = splits.split_sizes(498)
    assert (s.test, s.val, s.train) == (100, 60, 338)


def test_holdout_exact_disjoint_and_partition_independent(spark):
    df = spark.range(498).withColumnRenamed("id", "key")
    a, sz = splits.holdout_split(df, ["key"], seed=42)
    b, _ = splits.holdout_split(df.repartition(13), ["key"], seed=42)
    ra = {r.key: r.split for r in a.collect()}
    rb = {r.key: r.split for r in b.collect()}
    assert ra == rb and len(ra) == 498
    counts = {k: list(ra.values()).count(k) for k in ("test", "val", "train")}
    assert counts == {"test": 100, "val": 60, "train": 338}


def test_multi_bucket_rank_equals_brute_force(spark):
    df = spark.range(3000).withColumnRenamed("id", "key")
    ranked, n = ranking.hash_rank(df, ["key"], seed=7, rank_col="r", rows_per_bucket=100)
    got = {r.key: r.r for r in ranked.collect()}
    import hashlib

    order = sorted(range(3000), key=lambda k: (hashlib.md5(f"7:{k}".encode()).hexdigest(), k))
    assert got == {k: i for i, k in enumerate(order)} and n == 3000


def test_key_rank_multi_bucket(spark):
    vals = [int(x) for x in np.random.RandomState(1).permutation(5000)[:2000] * 3]
    df = spark.createDataFrame([(v,) for v in vals], "k long")
    out = ranking.key_rank(df, "k", rank_col="i", rows_per_bucket=100)
    got = sorted((r.i, r.k) for r in out.collect())
    assert [k for _, k in got] == sorted(vals) and [i for i, _ in got] == list(range(2000))


def test_kfold_sizes(spark):
    df = spark.range(103).withColumnRenamed("id", "key")
    f = splits.assign_folds(df, ["key"], k=10)
    sizes = sorted(r["count"] for r in f.groupBy("fold").count().collect())
    assert sizes == [10] * 7 + [11] * 3


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.RandomState(3)
    x = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25)])  # a hot value
    g = np.where(np.arange(len(x)) % 2 == 0, "a", "b")
    df = spark.createDataFrame([(str(a), float(b)) for a, b in zip(g, x)], "g string, x double")
    res = ranking.exact_quantiles(df, "x", [0.1, 0.25, 0.5, 0.9], ["g"])
    for key in ("a", "b"):
        want = np.percentile(x[g == key], [10, 25, 50, 90])
        assert np.allclose(res[(key,)]["q"], want, rtol=0, atol=1e-12)


def test_minmax_train_only_and_no_clipping(spark):
    df = spark.createDataFrame(
        [(1.0, 5.0, "train"), (3.0, 5.0, "train"), (10.0, 5.0, "test"), (-1.0, 7.0, "val")],
        "a double, c double, split string",
    )
    m = scaling.ColumnMinMaxScaler(inputCols=["a", "c"], splitCol="split").fit(df)
    r = m.transform(df).collect()
    assert [x.a for x in r] == [0.0, 1.0, 4.5, -1.0]
    assert [x.c for x in r] == [0.0, 0.0, 0.0, 2.0]  # constant column: divisor 1


def test_metrics_match_numpy(spark):
    rng = np.random.RandomState(0)
    y = rng.uniform(0, 50, 200)
    p = y + rng.normal(0, 2, 200)
    df = spark.createDataFrame([("m", "test", float(a), float(b)) for a, b in zip(y, p)],
                               "model string, split string, y double, pred double")
    r = metrics.regression_metrics(df, "y", "pred").first()
    mse = np.mean((y - p) ** 2)
    r2 = 1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2)
    assert math.isclose(r.mse, mse, rel_tol=1e-9) and math.isclose(r.r2, r2, rel_tol=1e-9)
    assert math.isclose(r.mae, np.mean(np.abs(y - p)), rel_tol=1e-9)
    assert r.suspicious is False and r.goal_met is False
    const = spark.createDataFrame([("m", "t", 2.0, 1.0), ("m", "t", 2.0, 3.0)],
                                  "model string, split string, y double, pred double")
    assert metrics.regression_metrics(const, "y", "pred").first().r2 is None


def test_histogram_matches_numpy_auto(spark):
    rng = np.random.RandomState(5)
    x = rng.standard_t(3, 700)
    df = spark.createDataFrame([("s", float(v)) for v in x], "split string, residual double")
    h = diagnostics.residual_histogram(df).orderBy("bin").collect()
    counts, edges = np.histogram(x, bins="auto")
    assert [r.n for r in h] == counts.tolist()
    assert np.allclose([r.bin_lo for r in h], edges[:-1])


def test_kde_matches_brute_force(spark):
    rng = np.random.RandomState(9)
    x = rng.normal(2, 3, 400)
    df = spark.createDataFrame([("s", float(v)) for v in x], "split string, residual double")
    k = diagnostics.residual_kde(df, gridsize=15).orderBy("grid_index").collect()
    bw = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min() - 3 * bw, x.max() + 3 * bw, 15)
    dens = [np.exp(-0.5 * ((g - x) / bw) ** 2).sum() / (len(x) * bw * math.sqrt(2 * math.pi)) for g in grid]
    assert np.allclose([r.density for r in k], dens) and np.allclose([r.x for r in k], grid)


def test_early_stop_matches_loop(spark):
    hist = [0.9, 0.8, 0.85, 0.7, 0.75, 0.74, 0.73, 0.72, 0.71, 0.69, 0.8]
    df = spark.createDataFrame([(0, e, v) for e, v in enumerate(hist)], "config int, epoch int, val_loss double")
    r = diagnostics.early_stop(df, patience=5).first()
    best, wait, stop = math.inf, 0, len(hist) - 1
    for e, v in enumerate(hist):
        if v < best:
            best, wait = v, 0
        else:
            wait += 1
            if wait >= 5:
                stop = e
                break
    assert r.stop_epoch == stop == 8 and r.best_epoch == 3 and r.epochs_run == 9


def test_search_best_and_rank_ties(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.4), (2, 0.4), (3, 0.9)], "draw int, mae_val double")
    assert diagnostics.search_best(df).first().draw == 1
    ranks = {r.draw: r.rank for r in diagnostics.search_rank(df).collect()}
    assert ranks == {1: 1, 2: 2, 0: 3, 3: 4}


def test_importance_rank(spark):
    df = spark.createDataFrame([("a", 0.1, 0.3), ("b", 0.6, 0.2), ("c", 0.3, 0.5)],
                               "feature string, rf double, et double")
    out = diagnostics.importance_rank(df, ["rf", "et"], top_n=2).orderBy("rank").collect()
    assert [r.feature for r in out] == ["b", "c"]


def test_reduce_lr_rule():
    lrs = diagnostics.reduce_lr_on_plateau([1.0] + [2.0] * 9, 0.1, patience=7)
    assert lrs[:8] == [0.1] * 8 and math.isclose(lrs[8], 0.05)


def test_early_stop_blocked_random_histories(spark):
    rng = np.random.RandomState(4)
    rows, expect = [], {}
    for cfg in range(6):
        vals = np.round(rng.uniform(0, 1, 60) + np.linspace(0.5, 0, 60), 3)
        best, wait, stop = math.inf, 0, 59
        for ep, v in enumerate(vals):
            rows.append((cfg, ep, float(v)))
            if v < best:
                best, wait = v, 0
            else:
                wait += 1
                if wait >= 4:
                    stop = ep
                    break
        cut = vals[: stop + 1]
        expect[cfg] = (stop, int(np.argmin(cut)), stop + 1)
        rows += [(cfg, ep, float(v)) for ep, v in enumerate(vals) if ep > stop]
    df = spark.createDataFrame(rows, "config int, epoch int, val_loss double")
    got = {r.config: (r.stop_epoch, r.best_epoch, r.epochs_run)
           for r in diagnostics.early_stop(df, patience=4).collect()}
    assert got == expect


def test_key_rank_with_hot_value_and_ties(spark):
    rng = np.random.RandomState(8)
    vals = np.concatenate([rng.randint(0, 500, 1400), np.full(700, 250)])  # a third share one value
    rows = [(float(v), i) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "m double, draw long")
    out = ranking.key_rank(df, "m", ["draw"], "r", rows_per_bucket=50)
    got = {r.draw: r.r for r in out.collect()}
    want = {d: i for i, (_, d) in enumerate(sorted(rows))}
    assert got == want


@pytest.mark.parametrize("kind", ["text", "wide long", "hot", "equal rows", "decimal", "double"])
def test_key_rank_orders_every_type_exactly(spark, kind):
    rng = np.random.RandomState(3)
    if kind == "text":  # a common prefix, as URLs have
        vals, t = [f"https://example.com/{v:05d}" for v in rng.permutation(2000)], "string"
    elif kind == "wide long":  # doubles cannot tell these apart
        vals, t = [2**60 + int(v) for v in rng.permutation(2000)], "long"
    elif kind == "hot":
        vals, t = [7] * 1500 + [int(v) for v in rng.randint(0, 20, 500)], "long"
    elif kind == "equal rows":
        vals, t = ["same"] * 2000, "string"
    elif kind == "decimal":
        vals, t = [__import__("decimal").Decimal(int(v)) / 100 for v in rng.permutation(2000)], "decimal(30,2)"
    else:
        vals, t = [float(v) for v in rng.standard_cauchy(1998)] + [float("inf"), float("-inf")], "double"
    tie = [0] * 2000 if kind == "equal rows" else [int(v) for v in rng.permutation(2000)]
    df = spark.createDataFrame(list(zip(vals, tie)), f"k {t}, __part long").repartition(7)
    out = ranking.key_rank(df, "k", ["__part"], "r", rows_per_bucket=20) if kind != "equal rows" else ranking.key_rank(df, "k", [], "r", 20)
    rows = sorted((r["r"], r["k"], r["__part"]) for r in out.collect())
    assert [r[0] for r in rows] == list(range(2000))
    assert [r[1:] for r in rows] == sorted(zip(vals, tie))
    if kind in ("hot", "equal rows"):  # the hot value is sorted by many tasks
        sizes = [r["count"] for r in ranking.ordered_parts(df.select("k"), ["k"], 100).groupBy("__part").count().collect()]
        assert len(sizes) > 50 and max(sizes) < 200


def test_quantiles_of_awkward_groups(spark):
    rng = np.random.RandomState(5)
    groups = {
        "hot": np.r_[np.full(3000, 1.5), rng.normal(size=900)],
        "tiny": np.array([3.0, -1.0]),
        "one": np.array([2.0]),
        "wide": rng.standard_cauchy(2000) ** 9,
        "near": 1.0 + rng.randint(0, 50, 1000) * np.finfo(float).eps,
        "signs": np.r_[np.zeros(5), -np.zeros(5), np.array([-5e-324, 5e-324, np.inf, -np.inf])],
        None: rng.normal(size=77),
    }
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("hot", None), ("one", float("nan")), ("none at all", None)]
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    table = ranking.quantile_table(spark.createDataFrame(rows, "g string, x double").repartition(5), "x", probs, ["g"])
    assert "Window" not in table._jdf.queryExecution().executedPlan().toString()
    got = {r["g"]: r for r in table.collect()}
    assert got.keys() == groups.keys()
    for g, x in groups.items():
        want = []
        for p in probs:
            s, at = np.sort(x), p * (len(x) - 1)
            lo, hi = int(np.floor(at)), int(np.ceil(at))
            want.append(s[lo] if lo == hi or s[lo] == s[hi] else s[lo] + (s[hi] - s[lo]) * (at - lo))
        assert (got[g]["n"], got[g]["min"], got[g]["max"]) == (len(x), x.min(), x.max())
        assert np.array_equal(np.array(got[g]["q"]), np.array(want)), g
    whole = ranking.exact_quantiles(spark.createDataFrame(rows, "g string, x double").where("g = 'near'"), "x", [0.5])
    assert whole[()]["q"] == [np.quantile(groups["near"], 0.5)]
    assert ranking.quantile_table(spark.createDataFrame([], "g string, x double"), "x", [0.5], ["g"]).collect() == []


def test_density_exact_and_binned(spark):
    rng = np.random.RandomState(6)
    x = {"a": np.r_[rng.normal(size=400), rng.normal(8, 0.1, 300)], None: rng.standard_cauchy(200)}
    df = spark.createDataFrame([(g, float(v)) for g, xs in x.items() for v in xs], "split string, residual double").repartition(4)
    exact = {(r["split"], r["grid_index"]): r for r in diagnostics.residual_kde(df, gridsize=45).collect()}
    binned = {(r["split"], r["grid_index"]): r for r in diagnostics.residual_kde(df, gridsize=45, method="binned", cells_per_bw=8).collect()}
    assert exact.keys() == binned.keys() and len(exact) == 90
    for g, xs in x.items():
        bw = xs.std(ddof=1) * len(xs) ** -0.2
        grid = np.linspace(xs.min() - 3 * bw, xs.max() + 3 * bw, 45)
        want = np.exp(-0.5 * ((grid[:, None] - xs) / bw) ** 2).sum(1) / (len(xs) * bw * np.sqrt(2 * np.pi))
        bound = diagnostics.kde_error_bound(bw, 8)
        for i in range(45):
            assert abs(exact[g, i]["density"] - want[i]) < 1e-9 and abs(exact[g, i]["x"] - grid[i]) < 1e-6
            assert abs(binned[g, i]["density"] - want[i]) <= bound + 1e-12


def test_split_moves_no_row_and_keeps_exact_sizes(spark):
    df = spark.range(498).withColumn("s", F.concat(F.lit("k"), F.col("id")))
    out, sz = splits.holdout_split(df, ["id", "s"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    n = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert n == {"test": 100, "val": 60, "train": 338} == {"test": sz.test, "val": sz.val, "train": sz.train}
    ranked, _ = splits.holdout_split(df, ["id", "s"], keep_rank=True)
    assert {(r["id"], r["split"]) for r in out.select("id", "split").collect()} == {
        (r["id"], r["split"]) for r in ranked.select("id", "split").collect()
    }
    folds = splits.assign_folds(df, ["id"], 10)
    assert "Exchange" not in folds._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["count"] for r in folds.groupBy("fold").count().collect()) == [49, 49] + [50] * 8


def test_split_equal_and_null_keys_stay_together(spark):
    rows = [(i // 3 if i < 90 else None, i) for i in range(100)]
    df = spark.createDataFrame(rows, "k long, v long")
    out, _ = splits.holdout_split(df, ["k"])
    assert out.groupBy("k").agg(F.countDistinct("split").alias("c")).where("c > 1").count() == 0
    assert out.count() == 100


def test_key_rank_takes_nulls_text_and_dates(spark):
    rows = [(None, 1), ("b", 2), ("a", 3), ("", 4), ("é", 5), ("ab", 6), ("abcdefgh", 7), ("abcdefgg", 8), (None, 0)]
    df = spark.createDataFrame(rows, "t string, i long")
    want = [i for _, i in sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))]
    got = [r["i"] for r in ranking.key_rank(df, "t", ["i"], "r").orderBy("r").collect()]
    assert got == want
    dates = df.withColumn("d", F.expr("date_add(date'2020-01-01', cast(i as int))"))
    assert [r["i"] for r in ranking.key_rank(dates, "d", [], "r").orderBy("r").collect()] == sorted(i for _, i in rows)
    metric = spark.createDataFrame([(0, 2.0), (1, None), (2, 1.0)], "draw long, mae_val double")
    assert [r["draw"] for r in diagnostics.search_rank(metric).orderBy("rank").collect()] == [1, 2, 0]


def test_kde_and_histogram_of_constant_groups(spark):
    df = spark.createDataFrame([("a", 1.0)] * 5 + [("b", float(i)) for i in range(20)], "split string, residual double")
    kde = diagnostics.residual_kde(df, gridsize=5)
    assert {r["split"] for r in kde.collect()} == {"b"}
    hist = diagnostics.residual_histogram(df)
    a = hist.where("split = 'a'").collect()
    assert len(a) == 1 and (a[0]["bin_lo"], a[0]["bin_hi"], a[0]["n"]) == (0.5, 1.5, 5)


@pytest.mark.parametrize("kind", ["normal", "heavy", "flat"])
def test_bins_follow_numpy_auto(kind):
    rng = np.random.default_rng(4)
    x = {"normal": rng.normal(size=900), "heavy": rng.standard_cauchy(900), "flat": np.r_[np.zeros(800), rng.normal(size=100)]}[kind]
    q = np.quantile(x, [0.25, 0.75])
    assert diagnostics.auto_bin_count(len(x), x.min(), x.max(), q[0], q[1]) == len(np.histogram_bin_edges(x, "auto")) - 1
