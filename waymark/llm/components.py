"""Connected components of an undirected graph given as edges between long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import drop_staged, stage


def star(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(u, v): every v, and u itself, is linked to the least of u and its v. Partial minima, then a join that
    may be split where u is a hub; no neighbourhood is gathered."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    linked = pairs.join(least, "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) -> (id, root) for every id in an edge; root is the component's least id.

    Large-star and small-star steps in turn, each staged in the shared folder, until nothing changes. Repeated edges
    count once, an edge from an id to itself adds nothing, a null id takes no part; no edges, no rows.
    """
    current = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "edges")
    if current.isEmpty():
        return current.select(F.col("u").alias("id"), F.col("v").alias("root"))
    mark = None
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        small = star(large, large)
        following = stage(small, "edges")
        now = following.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == tuple(now):
            drop_staged(current)
            return following.select(F.col("u").alias("id"), F.col("v").alias("root")).union(following.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        mark = tuple(now)
        drop_staged(current)
        current = following
