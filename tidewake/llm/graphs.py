"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node reachable. edges: (a, b) longs, any order, repeats allowed.

    Alternates large-star and small-star steps; each is one or two groupings, so
    rounds grow with the logarithm of a component's size. Each round is stored,
    and the rounds end when the stored edges stop changing. A hub meets no
    single task: minima come from partial aggregation and joins that can split.
    """
    now = stored(edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "edges")
    seen = None
    while True:
        # Large star: larger neighbours of a node link to the least of it and its neighbours.
        both = now.select(F.col("lo").alias("n"), F.col("hi").alias("m")).unionByName(now.select(F.col("hi").alias("n"), F.col("lo").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("x")).select("n", F.least("n", "x").alias("x"))
        large = both.where("m > n").join(least, "n").select(F.col("x").alias("lo"), F.col("m").alias("hi")).where("lo < hi").distinct()
        # Small star: smaller neighbours, and the node, link to the least neighbour.
        least = large.groupBy("hi").agg(F.min("lo").alias("x"))
        small = large.join(least, "hi").select(F.col("x").alias("lo"), F.col("lo").alias("hi")).where("lo < hi").unionByName(least.select(F.col("x").alias("lo"), "hi")).distinct()
        now = stored(small, "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
