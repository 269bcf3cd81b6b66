"""Connected components of a graph given as a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import release, staged


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for each node of the edges ``a, b``; ``component`` itself has a row too.

    Each round joins every node with the smallest neighbour; the number of rounds grows with the logarithm of the longest path.
    A node with very many edges is a minimum per task before it is shuffled, and its join is split by Spark.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = staged(now), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        release(edges.sparkSession)
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = large.join(low, F.col("u") == F.col("c"))
        small = small.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                               F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = staged(small.select("e.u", "e.v").where("u <> v").distinct())
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
