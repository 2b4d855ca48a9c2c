import os

from loam.plans import cleaning_job


def test_cleaning_job_csv_to_versioned(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "raw.csv")
    header = "25.4mm,9.5mm,4.8mm,2.0mm,0.42mm,0.076mm,LL ,IP ,Umidade Ótima,Densidade máxima ,CBR \n"
    rows = [
        '100,90,80,70,60,50,"35,5",12,15,"1.850","12,5"\n',
        '100,90,80,70,60,50,"40,0",15,18,"1.900","0,5"\n',     # CBR < 1 -> masked -> dropped
        '100,90,80,70,60,50,"38,0",NA,14,"1.800","20,0"\n',    # missing IP -> dropped
    ]
    with open(src, "w", encoding="utf-8") as f:
        f.write(header + "".join(rows))
    out = os.path.join(tmpdir_path, "data")
    r1 = cleaning_job.run(spark, src, out)
    assert (r1["version"], r1["rows_before"], r1["rows_after"], r1["rows_removed"]) == (1, 3, 1, 2)
    got = spark.read.option("header", True).csv(r1["path"]).collect()
    assert len(got) == 1 and float(got[0]["ll"]) == 35.5 and float(got[0]["d_max"]) == 1850.0
    assert float(got[0]["cbr"]) == 12.5
    r2 = cleaning_job.run(spark, src, out)
    assert r2["version"] == 2


def test_cleaning_job_reads_a_folder_of_two_layouts(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    os.mkdir(src)
    names = ["25.4mm", "9.5mm", "4.8mm", "2.0mm", "0.42mm", "0.076mm", "LL ", "IP ", "Umidade Ótima", "Densidade máxima ", "CBR "]
    values = ["100", '"90,5"', "80", "70", "60", "50", '"35,5"', "12", "15", '"1.850"', '"12,5"']
    for i in range(6):
        pairs = list(zip(names, values))[:: -1 if i % 2 else 1]
        with open(os.path.join(src, f"part {i}.csv"), "w", encoding="utf-8") as f:
            f.write(",".join(n.strip() if i % 2 else n for n, _ in pairs) + "\n" + ",".join(v for _, v in pairs) + "\n")
    done = cleaning_job.run(spark, src, os.path.join(tmpdir_path, "out"))
    assert (done["rows_before"], done["rows_after"]) == (6, 6)
    rows = spark.read.option("header", True).csv(done["path"]).collect()
    assert {(float(r["p9_5"]), float(r["ll"]), float(r["d_max"]), float(r["cbr"])) for r in rows} == {(90.5, 35.5, 1850.0, 12.5)}


def test_filters_and_columns_reach_the_scan(spark):
    from pyspark.sql import functions as F

    from loam.operators import ranking
    from loam.plans import standins

    d = "/root/testdata/sf0.001"
    if not os.path.exists(d):
        return
    orders = standins.table(spark, d, "orders").filter(F.col("o_orderstatus") != "P").select("o_orderkey")
    plan = ranking.ordered_parts(orders, ["o_orderkey"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), Not(EqualTo(o_orderstatus,P))]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan


def test_mlp_search_takes_all_draws(monkeypatch):
    from loam.plans import learners

    seen = {}

    class Table:
        df, feature_names = None, ["a"]

        def release(self):
            pass

    monkeypatch.setattr(learners, "_prepared", lambda *a, **kw: Table())
    monkeypatch.setattr(learners.mlp, "search", lambda df, cols, label, draws, base: seen.update(draws=draws, base=base))
    monkeypatch.setattr(learners.diagnostics, "search_rank", lambda *a: None)
    learners.q_mlp_search(None, "")
    assert seen["draws"] == learners.search.mlp_draws(20, 42)
    assert (seen["base"].epochs, seen["base"].patience) == (100, 5)


def searched(monkeypatch, query):
    """What a registered search hands to the operator."""
    from loam.plans import learners

    seen = {}

    class Frame:
        def filter(self, _):
            return self

    class Table:
        df, feature_names = Frame(), ["a"]

        def release(self):
            pass

    def taken(train, kind, space, n_iter=None, k=None, overrides=None, **kw):
        seen.update(kind=kind, space=space, n_iter=n_iter, k=k, overrides=overrides)

    monkeypatch.setattr(learners, "_prepared", lambda *a, **kw: Table())
    monkeypatch.setattr(learners.search, "random_search_cv", taken)
    monkeypatch.setattr(learners.F, "col", lambda c: c)
    query(None, "")
    return seen


def test_forest_search_takes_all_draws_and_folds(monkeypatch):
    from loam.plans import learners

    assert searched(monkeypatch, learners.q_search_results) == {"kind": "rf", "space": learners.search.RF_SPACE, "n_iter": 150, "k": 10, "overrides": None}


def test_extra_trees_search_takes_all_draws_and_folds(monkeypatch):
    from loam.plans import learners

    assert searched(monkeypatch, learners.q_search_results_et) == {"kind": "et", "space": learners.search.ET_SPACE, "n_iter": 150, "k": 10, "overrides": None}


def test_boosting_search_takes_whole_points(monkeypatch):
    from loam.plans import learners

    assert searched(monkeypatch, learners.q_search_results_gb) == {"kind": "gb", "space": learners.search.GB_SPACE, "n_iter": 150, "k": 10, "overrides": None}
