"""Stand-in inputs built from the driver's test tables.

They only reshape columns into the schemas the jobs expect (the soil table
with its raw headers, a dirty text table, labels with predictions); none
of them does any of the jobs' work. Every one grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# lineitem has no unique key column; these four together identify a row
LINEITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _soil_exprs() -> list[tuple[str, Column]]:
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    ln, ep = F.col("l_linenumber"), F.col("l_extendedprice")
    return [
        ("25.4mm", F.lit(100.0) - d * F.lit(100.0)),
        ("9.5mm", F.lit(100.0) - d * F.lit(100.0) - t * F.lit(100.0)),
        ("4.8mm", q * F.lit(2.0)),
        ("2.0mm", q * F.lit(1.6)),
        ("0.42mm", q * F.lit(1.2) + ln),
        ("0.076mm", q * F.lit(0.8) + ln),
        ("LL ", q + F.lit(20.0)),
        ("IP ", q * F.lit(0.5) + F.lit(2.0)),
        ("Umidade Ótima", t * F.lit(300.0) + F.lit(5.0)),
        ("Densidade máxima ", F.lit(1200.0) + F.floor(ep / F.lit(100.0)).cast("double")),
        ("CBR ", ep / F.lit(1000.0)),
    ]


# The same stand-in in SQL, used by the oracle queries.
SOIL_SQL = """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         100.0 - l_discount * 100.0 AS p25_4,
         100.0 - l_discount * 100.0 - l_tax * 100.0 AS p9_5,
         l_quantity * 2.0 AS p4_8,
         l_quantity * 1.6 AS p2_0,
         l_quantity * 1.2 + l_linenumber AS p0_42,
         l_quantity * 0.8 + l_linenumber AS p0_076,
         l_quantity + 20.0 AS ll,
         l_quantity * 0.5 + 2.0 AS ip,
         l_tax * 300.0 + 5.0 AS w_opt,
         CAST(1200.0 + floor(l_extendedprice / 100.0) AS DOUBLE) AS d_max,
         l_extendedprice / 1000.0 AS cbr
  FROM lineitem
"""


def soil_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soil-shaped table with the source's raw headers (dots, spaces,
    accents, trailing blanks), one row per lineitem row."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(*LINEITEM_KEY, *[e.alias(n) for n, e in _soil_exprs()])


def soil_dirty_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like :func:`soil_raw`, but two columns arrive as Brazilian-format
    text (``21,0`` and ``1.850``) and one legal text column is present."""
    li = table(spark, sf_dir, "lineitem")
    cols = []
    for n, e in _soil_exprs():
        # both columns are integer-valued: '21,0' and '1.850' are built with
        # plain string functions (same text as a locale formatter would give)
        if n == "LL ":
            e = F.concat(e.cast("long").cast("string"), F.lit(",0"))
        elif n == "Densidade máxima ":
            v = e.cast("long")
            e = F.concat((v / 1000).cast("long").cast("string"), F.lit("."),
                         F.lpad((v % 1000).cast("string"), 3, "0"))
        cols.append(e.alias(n))
    return li.select(*LINEITEM_KEY, F.col("l_returnflag").alias("flag"), *cols)


def acctbal_br_text(spark: SparkSession, sf_dir: str, spoil: bool = False) -> DataFrame:
    """customer with the balance as Brazilian-format text; ``spoil`` puts
    one non-numeric cell in it (customer key 1)."""
    c = table(spark, sf_dir, "customer")
    txt = F.translate(F.format_number("c_acctbal", 2), ",.", ".,")
    if spoil:
        txt = F.when(F.col("c_custkey") == 1, F.lit("n/d")).otherwise(txt)
    return c.select("c_custkey", "c_name", "c_mktsegment", txt.alias("acctbal"))


def events_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as (event_id, event_type, y) for the learners' label tables."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "event_type", F.col("value").alias("y"))
