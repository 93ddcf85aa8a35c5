"""Connected components by alternating stars.

Each round replaces every edge by one to the least known neighbour; large stars and small
stars in turn reach a forest of stars in a number of rounds that grows with the logarithm
of the longest path. Only minima cross the shuffle, so a hub is never gathered in one row.
Each round is written to the shared folder, which ends its lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.plans.shared import materialize


def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """node, component (the least node of its component) for every node of an edge; nulls are no nodes."""
    x, y = F.greatest(a, b), F.least(a, b)
    cur = materialize(edges.filter(F.col(a) != F.col(b)).select(x.alias("x"), y.alias("y")).distinct(), "components")
    for _ in range(most_rounds):
        # large star: a node's larger neighbours go to the least of it and its neighbours
        both = cur.union(cur.select("y", "x"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("m", "x"))
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        # small star: a node's smaller neighbours, and itself, go to the least of them
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x")
        small = small.filter("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).union(least.select("x", F.col("m").alias("y"))).distinct()
        new = materialize(small, "components")
        # settled when no node has two parents and no parent has a parent
        parents = new.groupBy("x").agg(F.count("*").alias("n"))
        settled = parents.filter("n > 1").isEmpty() and new.alias("p").join(new.alias("q"), F.col("p.y") == F.col("q.x"), "left_semi").isEmpty()
        cur = new
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return cur.select(F.col("x").alias("node"), F.col("y").alias("component")).union(cur.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct())
