"""Connected components of an edge table, by alternating large-star and small-star steps on the DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized, spread_join, staged


def _sum(edges: DataFrame) -> tuple:
    """The number of edges, the sum of their hashes, and the most that any node has, or more."""
    r = edges.groupBy("b").agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("h"), F.max("n")).first()
    most = edges.groupBy("a").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return r[0], r[1], (r[2] or 0) + (most or 0)


def components(edges: DataFrame, most: int = 40) -> DataFrame:
    """node, root: for every node of an edge (a, b) the smallest node it is connected with. Each step keeps the edges
    as a staged table; the number of steps grows with the logarithm of the longest chain. Raises if ``most`` steps
    are not enough."""
    edges = staged(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _sum(edges)
    for _ in range(most):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
        large = spread_join(both, low, "a", 2 * before[0], before[2]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, low, "a", 2 * before[0], before[2]).select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = staged(sized(small.where("a <> b").distinct(), before[0]), "edges")
        after = _sum(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
