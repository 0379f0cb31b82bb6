"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setlist.llm.common import written


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the component's smallest node), for every node of an edge.

    Each step links a node's neighbours to the smallest of them; map-side partial minima keep a
    node with very many neighbours even. Steps repeat, written each, until every node hangs on its
    smallest one: no node has two smaller neighbours, or both a smaller and a greater one. No edge
    list or component leaves the executors.
    """
    def unfinished(df: DataFrame) -> bool:
        ends = df.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            df.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        seen = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return not seen.where("up > 1 or up = 1 and down = 1").isEmpty()

    oriented = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    current = written(oriented.distinct(), "edges")
    while unfinished(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: every node and its smaller neighbours hang on the smallest of those.
        lower = written(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "large-star")
        root = lower.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            lower.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(root.select("u", F.col("m").alias("v"))).distinct()
        )
        current = written(small, "small-star")
    roots = current.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct())
