"""Connected components of a distributed edge list.

Alternates the large-star and small-star steps: every node hangs its larger
neighbours, then its smaller ones, under the smallest node it knows, until the
edges are stars. All steps are groupBy-min (combined before the shuffle) and
joins; nothing is collected, each round is cut by a table in shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import cut_lineage


def _hang(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    out = out.where("u <> v")
    return out if large else out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node in edges (u, v)."""
    edges = cut_lineage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        edges = cut_lineage(_hang(_hang(edges, True), False))
        row = edges.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38)))")).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    leaves = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return leaves.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
