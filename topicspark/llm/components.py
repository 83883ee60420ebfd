"""Connected components of an edge table, by alternating star operations.

Each round links every node to the smallest one around it, first for its larger
neighbours, then for its smaller ones; the edges turn into stars around each
component's smallest node in a number of rounds that grows with the logarithm of
the longest path. Every step is a join or an aggregate; nothing but two numbers a
round reaches the driver. Each round's edges are written to the shared folder, so
that a lost executor does not start the chain anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

ROUNDS = 100


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node reached."""
    up, down = F.greatest(a, b), F.least(a, b)
    current = written(edges.where(F.col(a) != F.col(b)).select(up.alias("u"), down.alias("v")).distinct(), "edges")
    before = None
    for _ in range(ROUNDS):
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = now
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u != v").distinct(), "large")
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(smallest.select("u", F.col("m").alias("v")))
        current = written(small.distinct(), "edges")
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
