import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from loam.session import build_session

    s = build_session("local[4]", app="loam-tests", shuffle_partitions=8)
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loam-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="loam-test-")


@pytest.fixture(scope="session")
def soil(spark):
    """Soil table of the canonical schema built from spark.range with fixed
    formulas (CBR depends on the features, so learners can beat the mean)."""
    from pyspark.sql import functions as F

    n = 600
    i = F.col("id").cast("double")
    df = spark.range(n).select(
        F.col("id").alias("k"),
        (F.lit(90.0) + (i * 7 % 11)).alias("p25_4"),
        (F.lit(70.0) + (i * 5 % 23)).alias("p9_5"),
        (F.lit(50.0) + (i * 3 % 29)).alias("p4_8"),
        (F.lit(35.0) + (i * 11 % 31)).alias("p2_0"),
        (F.lit(20.0) + (i * 13 % 37)).alias("p0_42"),
        (F.lit(10.0) + (i * 17 % 41)).alias("p0_076"),
        (F.lit(25.0) + (i * 19 % 43)).alias("ll"),
        (F.lit(3.0) + (i * 23 % 19)).alias("ip"),
        (F.lit(8.0) + (i * 29 % 20)).alias("w_opt"),
        (F.lit(1500.0) + (i * 31 % 600)).alias("d_max"),
    )
    return df.withColumn(
        "cbr",
        F.lit(2.0) + (F.col("d_max") - 1500.0) / 20.0 + (60.0 - F.col("p0_076")) / 4.0
        + F.when(F.col("ip") > 12, -3.0).otherwise(2.0),
    ).cache()
