"""Connected components by alternating star contractions, as Spark joins.

In a large star every node hands its larger neighbours the smallest node of
its neighbourhood; in a small star its smaller ones and itself. The graph ends
as stars around each component's smallest node. No neighbour list is ever
collected: the smallest neighbour is an aggregate that is joined back. Each
round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _smallest(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest node among u and its neighbours in (u, v)."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_smallest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v")
    joined = down.join(_smallest(down), "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v) that isn't its component's smallest."""
    now = written(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        now = written(_small(_large(now)), "edges")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = new
