"""Connected components of a link table, on Spark alone: alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is two aggregations over the links; their number falls by a factor per round and the rounds grow with the logarithm
of the longest path. Links are never gathered; a hub's links meet only in a minimum and in a join that can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour ``v`` of ``u`` with the least node around ``u`` (itself included)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(down: DataFrame) -> DataFrame:
    """Links ``u`` and its smaller neighbours ``v`` with the least of them."""
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, u: str = "a", v: str = "b") -> DataFrame:
    """``node, component`` (the least node of the component) for every node that has a link. Nulls and loops are left out."""
    spark = edges.sparkSession
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v)))
    e = cut_lineage(e.distinct())
    # Done when every node with a smaller neighbour has one only, and that one has none.
    while not e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() or not e.groupBy("u").count().where("count > 1").isEmpty():
        e = cut_lineage(_small_star(cut_lineage(_large_star(e))))
        settle(spark)
    tails = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return tails.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
