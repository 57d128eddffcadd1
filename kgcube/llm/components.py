"""Connected components of a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgcube.llm.store import stored


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of long ids -> (node, root): each linked node and the smallest of its component.

    A step sends every larger neighbour of a node to the node's smallest neighbour, then every
    smaller one; the links become stars around the roots after a number of steps that grows with the
    logarithm of the longest path. Each step only has joins and minima by node, whose hot keys Spark
    combines before the shuffle or splits in the join.
    """
    a, b = F.col("a"), F.col("b")
    edges = stored(links.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    state = _fingerprint(edges)
    while state[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = stored(moved.unionByName(low.withColumnRenamed("m", "lo")).distinct())
        now = _fingerprint(edges)
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return nodes.unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
