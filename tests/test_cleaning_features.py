import math

import pytest
from pyspark.sql import functions as F

from loam.functions import cleaning, features


def test_strict_and_auto_locale_parse(spark):
    df = spark.createDataFrame(
        [("1.234,50", "100.0", "Argila"), (" 12,5 ", "1.850", "Areia"), (None, "7", "x")],
        "a string, b string, t string",
    )
    out, dec = cleaning.parse_locale_numbers(df, return_decisions=True)
    assert dec == {"a": True, "b": True, "t": False}
    r = out.collect()
    assert r[0].a == 1234.5 and r[1].a == 12.5 and r[2].a is None
    assert r[0].b == 1000.0  # the strict rule drops every '.'
    assert r[2].t == "x"
    auto = cleaning.parse_locale_numbers(df, ["a", "b"], mode="auto").collect()
    assert auto[0].b == 100.0 and auto[0].a == 1234.5 and auto[1].b == 1.85


def test_one_bad_cell_keeps_column_text(spark):
    df = spark.createDataFrame([("1,5",), ("abc",), ("2,0",)], "a string")
    out = cleaning.parse_locale_numbers(df)
    assert dict(out.dtypes)["a"] == "string"
    assert [r.a for r in out.collect()] == ["1,5", "abc", "2,0"]


def test_mask_drop_report_nan_and_bounds(spark):
    df = spark.createDataFrame(
        [(0.5, 10.0), (1.0, float("nan")), (3000.0, 5.0), (3000.5, 2.0), (None, 4.0)],
        "ll double, cbr double",
    )
    m = cleaning.mask_outliers(df, ["ll", "cbr"])
    vals = [r.ll for r in m.collect()]
    assert vals == [None, 1.0, 3000.0, None, None]
    assert m.collect()[1].cbr is None  # NaN is masked too
    rep = cleaning.cleaning_report(m).first()
    assert (rep.rows_before, rep.rows_after, rep.rows_removed) == (5, 1, 4)
    assert cleaning.drop_incomplete(m).count() == 1
    # per-column bounds keep a legal zero
    z = spark.createDataFrame([(0.0,)], "ip double")
    assert cleaning.mask_outliers(z, ["ip"], bounds={"ip": (0.0, 80.0)}).first().ip == 0.0


def test_range_rules(spark):
    df = spark.createDataFrame(
        [(1, 50.0, 1500.0), (2, 81.0, 1500.0), (3, 10.0, 2300.0), (4, 80.0, 1200.0)],
        "k int, ip double, d_max double",
    )
    rules = {"ip": (0.0, 80.0), "d_max": (1200.0, 2200.0)}
    assert sorted(r.k for r in cleaning.range_valid(df, rules).collect()) == [1, 4]
    v = sorted((r.k, r.rule) for r in cleaning.range_violations(df, ["k"], rules).collect())
    assert v == [(2, "ip"), (3, "d_max")]


def test_decimal_comma(spark):
    df = spark.createDataFrame([("12,5",), ("3.25",), ("x",)], "s string")
    assert [r.v for r in df.select(cleaning.parse_decimal_comma(F.col("s")).alias("v")).collect()] == [
        12.5, 3.25, None]


def test_features_edge_cases(spark, soil):
    df = spark.createDataFrame([(0.0, 5.0, 3.0, 2.0, 7.0, 9.0, 30.0, 10.0, 10.0, 1800.0, 5.0)],
                               ",".join(f"{c} double" for c in
                                        ["p25_4", "p9_5", "p4_8", "p2_0", "p0_42", "p0_076", "ll",
                                         "ip", "w_opt", "d_max", "cbr"]))
    r = features.add_features(df).first()
    assert math.isclose(r.ratio_9_25, 5.0 / 1e-6)
    assert r.atividade == 20.0 and math.isclose(r.compacidade, 1800.0 / (10.0 + 1e-6))
    assert r.finos_sq == 81.0
    r2 = features.add_features(df, activity="identity_ip").first()
    assert r2.atividade == 10.0
    zero = spark.createDataFrame([(1.0, -1e-6)], "p9_5 double, p25_4 double")
    assert zero.select(features.ratio(F.col("p9_5"), F.col("p25_4")).alias("r")).first().r is None


def test_scenario_frame(spark, soil):
    sc = ["p0_42", "p0_076", "ll", "ip"]
    names = features.scenario_feature_names(sc)
    assert names == sc + ["ratio_076_042", "atividade", "finos_sq"]
    out = features.scenario_frame(soil.select("k", *sc), sc, keep=["k"])
    assert out.columns == ["k"] + names


def test_log1p_roundtrip_and_weights(spark):
    df = spark.createDataFrame([(0.0,), (24.99,), (25.0,), (25.01,), (100.0,)], "y double")
    t = features.log1p_target(df, "y", "l").withColumn("back", F.expm1("l")).collect()
    assert all(math.isclose(r.y, r.back, abs_tol=1e-9) for r in t)
    w = df.select(features.threshold_weight(F.col("y")).alias("w"),
                  features.threshold_weight(F.log1p("y"), log_space=True).alias("wl")).collect()
    assert [r.w for r in w] == [1.0, 1.0, 1.0, 3.0, 3.0] == [r.wl for r in w]


def test_alerts(spark):
    df = spark.createDataFrame([(1.99,), (2.0,), (100.0,), (100.004,)], "p double")
    out = df.select(features.alert_class(F.col("p")).alias("a"), features.round2(F.col("p")).alias("r"))
    assert [r.a for r in out.collect()] == ["very_low", "normal", "normal", "atypical"]


def test_auto_mode_separators(spark):
    df = spark.createDataFrame([("1.234,5",), ("1,234.5",), ("12,5",), ("7",)], "a string")
    out = [r.a for r in cleaning.parse_locale_numbers(df, mode="auto").collect()]
    assert out == [1234.5, 1234.5, 12.5, 7.0]


def test_fill_missing_features(spark):
    df = spark.createDataFrame([(1.0,)], "ll double")
    out = cleaning.fill_missing_features(df, ["ll", "ip"]).first()
    assert out.ll == 1.0 and out.ip == 0.0


def test_codes_with_a_type_suffix_stay_text(spark):
    df = spark.createDataFrame([("12D", "1,5"), ("7F", "2e3"), ("3d", " -4 ")], "code string, num string")
    out = cleaning.parse_locale_numbers(df)
    assert dict(out.dtypes) == {"code": "string", "num": "double"}
    assert [r["num"] for r in out.collect()] == [1.5, 2000.0, -4.0]
    got = df.select(cleaning.parse_decimal_comma(F.col("code")).alias("c"), cleaning.parse_decimal_comma(F.col("num")).alias("n")).collect()
    assert [r["c"] for r in got] == [None] * 3 and [r["n"] for r in got] == [1.5, 2000.0, -4.0]


def test_parse_of_many_columns_is_compiled(spark):
    # methods of more than 8,000 bytes stay interpreted by the JVM
    n = 24
    df = spark.range(4).select(*[F.concat(F.col("id").cast("string"), F.lit(f".00{i % 10},5")).alias(f"c {i}.") for i in range(n)], F.lit("x,1").alias("_0"))
    out, decisions = cleaning.parse_locale_numbers(df, return_decisions=True)
    plans = out._jdf.queryExecution().debug().codegenToSeq()
    assert all(plans.apply(i)._3().maxMethodCodeSize() < 8000 for i in range(plans.length()))
    assert out.columns == df.columns and decisions == {**{f"c {i}.": True for i in range(n)}, "_0": False}
    got = sorted(tuple(r) for r in out.collect())
    assert got[3] == (*[3000.5 + i % 10 for i in range(n)], "x,1")


@pytest.mark.parametrize("mode", ["strict_br", "auto"])
def test_cells_that_are_no_plain_numbers(spark, mode):
    cells = ["1.234,5", " 7 ", "", " ", "-2,5e1", "12D", "Infinity", "NaN", "1 2", "1\n", "0x1", "+.5", ".", "٣"]
    df = spark.createDataFrame([(c,) for c in cells], "t string")
    parsed = {c: cleaning.parse_locale_numbers(spark.createDataFrame([(c,)], "t string"), mode=mode).first().t for c in cells}
    numbers = {"1.234,5": 1234.5, " 7 ": 7.0, "": None, " ": None, "-2,5e1": -25.0, "1 2": 12.0, "+.5": 5.0 if mode == "strict_br" else 0.5}
    if mode == "auto":
        numbers["1\n"] = 1.0
    if mode == "strict_br":
        numbers["."] = None
    assert parsed == {**{c: c for c in cells}, **numbers}
    assert cleaning.parse_locale_numbers(df, mode=mode).count() == len(cells)
