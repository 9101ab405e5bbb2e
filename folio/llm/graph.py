"""Connected components by alternating stars, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.runtime import drop_stash, stash


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its least node) for every node of ``edges`` (columns u and v, one type).

    Each round links the greater neighbours of a node, then the lesser ones, to the least it knows, so that
    paths halve; it ends when only stars are left, in which a node has one edge or is a centre. Edges with a null end and loops
    are left out. A node with very many neighbours is an aggregation key only, split by map-side sums
    and by skew joins; no neighbour list is ever gathered.
    """
    now = stash(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # each node's greater neighbours to its least one
        large = stash(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), "large")
        # each node and its lesser neighbours to the least of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u")
        small = low.select("u", F.col("m").alias("v")).unionByName(linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        new = stash(small.distinct(), "small")
        drop_stash(large)
        drop_stash(now)
        now = new
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("centre")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("centre")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("centre").alias("centre")).where("up > 1 or up = 1 and centre = 1").isEmpty():
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
