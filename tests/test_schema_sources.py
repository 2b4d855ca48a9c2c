import os

import pytest
from pyspark.sql import functions as F

from loam import schema
from loam.sources import files


def test_canonicalize_raw_and_alias_headers(spark):
    raw = spark.createDataFrame(
        [(1.0,) * 11],
        ["25.4mm", "P9.5", "4,8mm", "2.0mm", "0.42mm", "0.076mm", "LL ", "I.P.", "Wot",
         "γdmax", "CBR "],
    )
    out = schema.canonicalize_columns(raw)
    assert out.columns == schema.FEATURES + ["cbr"]


def test_alias_clash_raises(spark):
    df = spark.createDataFrame([(1.0, 2.0)], ["LL", "ll "])
    with pytest.raises(schema.AliasClashError):
        schema.canonicalize_columns(df)


def test_missing_columns_error_lists_names(spark):
    df = spark.createDataFrame([(1.0, 2.0)], ["ll", "ip"])
    with pytest.raises(schema.MissingColumnsError) as e:
        schema.require_columns(df, ["ll", "ip", "cbr"])
    assert e.value.missing == ["cbr"] and e.value.actual == ["ll", "ip"]


def test_csv_roundtrip_na_tokens_and_typed_scan(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "a.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("LL ,IP ,note\n20.5,NA,x\n30,4.5,\nn/a,bad,y\n")
    df = files.read_csv(spark, p)
    rows = df.collect()
    assert rows[0]["IP "] is None and rows[1]["note"] is None and rows[2]["LL "] is None
    typed = files.read_csv(spark, p, schema.T.StructType([
        schema.T.StructField("ll", schema.T.DoubleType()),
        schema.T.StructField("ip", schema.T.DoubleType()),
        schema.T.StructField("note", schema.T.StringType()),
    ]))
    r = typed.collect()
    assert r[0]["ll"] == 20.5 and r[1]["ip"] == 4.5 and r[2]["ip"] is None


def test_list_files_and_folder_scan(spark, tmpdir_path):
    with pytest.raises(files.SourceNotFoundError):
        files.list_files(spark, os.path.join(tmpdir_path, "missing"))
    assert files.list_files(spark, tmpdir_path) == []
    for name in ("x.csv", "y.csv"):
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write("a,b\n1,2\n")
    with open(os.path.join(tmpdir_path, "z.txt"), "w") as f:
        f.write("no")
    names = [f["name"] for f in files.list_files(spark, tmpdir_path)]
    assert names == ["x.csv", "y.csv"]
    df = files.read_csv_folder(spark, tmpdir_path)
    assert sorted(r.source_file for r in df.collect()) == ["x.csv", "y.csv"]


def test_versioned_sink_uses_max_plus_one(spark, tmpdir_path):
    df = spark.range(3).withColumn("v", F.col("id") * 2)
    base = os.path.join(tmpdir_path, "out")
    p1, n1 = files.write_versioned(df, base, prefix="cleaned_v")
    p2, n2 = files.write_versioned(df, base, prefix="cleaned_v")
    assert (n1, n2) == (1, 2)
    import shutil

    shutil.rmtree(p1)  # a deletion must not lead to overwriting version 2
    _, n3 = files.write_versioned(df, base, prefix="cleaned_v")
    assert n3 == 3
    assert spark.read.option("header", True).csv(p2).count() == 3


def test_profile_and_shape(spark):
    df = spark.createDataFrame([(1, "ab", None), (3, None, 2.5)], "a int, s string, d double")
    prof = {r.column_name: r for r in files.profile(df).collect()}
    assert prof["a"].min_value == 1.0 and prof["a"].max_value == 3.0
    assert prof["s"].n_null == 1 and prof["s"].max_value == 2.0
    assert prof["d"].n_null == 1
    assert files.shape(df) == (2, 3)


def test_folder_scan_reads_each_file_by_its_own_header(spark, tmpdir_path):
    import os

    with open(os.path.join(tmpdir_path, "a.csv"), "w") as f:
        f.write("LL,IP\n40,10\n")
    with open(os.path.join(tmpdir_path, "b.csv"), "w") as f:
        f.write("IP,LL,X\n11,41,z\n")
    got = sorted(tuple(r) for r in files.read_csv_folder(spark, tmpdir_path).select("LL", "IP", "X", "source_file").collect())
    assert got == [("40", "10", None, "a.csv"), ("41", "11", "z", "b.csv")]


def test_many_files_are_read_by_layout_in_few_jobs(spark, tmpdir_path):
    for i in range(60):
        head, row = [("a,b", f"{i},x"), ("b,a", f"x,{i}"), ("a", f"{i}")][i % 3]
        with open(os.path.join(tmpdir_path, f"f {i}.csv"), "w") as f:
            f.write(f"{head}\n{row}\n" + ("NA\n" if i % 3 == 2 else ""))
    open(os.path.join(tmpdir_path, "empty.csv"), "w").close()
    layouts = files.header_layouts(spark, tmpdir_path)
    assert [(h, len(n)) for h, n in layouts] == [("a", 20), ("a,b", 20), ("b,a", 20)]
    rows = files.read_csv_folder(spark, tmpdir_path).collect()
    assert sorted(int(r.a) for r in rows if r.a is not None) == list(range(60))
    assert sum(r.b == "x" for r in rows) == 40 and sum(r.a is None for r in rows) == 20


def test_concurrent_writers_get_a_version_each(spark, tmpdir_path):
    from concurrent.futures import ThreadPoolExecutor

    base = os.path.join(tmpdir_path, "out")
    df = spark.range(3)
    with ThreadPoolExecutor(8) as pool:
        done = list(pool.map(lambda _: files.write_versioned(df, base, "v"), range(8)))
    assert sorted(n for _, n in done) == list(range(1, 9))
    assert all(os.path.exists(os.path.join(p, "_SUCCESS")) for p, _ in done)
    assert files.next_version(spark, base, "v") == 9
