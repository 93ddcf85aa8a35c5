"""Neighbours and paths in the relationship graph.

edges(src, dst, relation, ...) is directed; an undirected relation has rows both ways. Every
hop is one equi-join of the frontier with the edges, written to the shared folder, so plans
don't grow with the number of hops and a lost executor repeats one hop at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.plans.shared import materialize


def undirected(edges: DataFrame) -> DataFrame:
    back = edges.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns])
    return edges.unionByName(back).distinct()


def of_relation(edges: DataFrame, relation: str | None) -> DataFrame:
    return edges if relation is None else edges.filter(F.col("relation") == relation)


def add_edges(edges: DataFrame, more: DataFrame, both_ways: bool = False) -> DataFrame:
    more = undirected(more) if both_ways else more
    return edges.unionByName(more, allowMissingColumns=True)


def neighbors(edges: DataFrame, nodes: DataFrame, relation: str | None = None, other_table: bool = True) -> DataFrame:
    """nodes: node -> origin, node, relation, weight of each neighbour, in other tables only by default ("table.column" names)."""
    out = of_relation(edges, relation).join(nodes.select(F.col("node").alias("src")).distinct(), "src")
    if other_table:
        out = out.filter(table_of("src") != table_of("dst"))
    return out.select(F.col("src").alias("origin"), F.col("dst").alias("node"), "relation", "weight")


def table_of(c: str):
    return F.substring_index(F.col(c), ".", 1)


def level_paths(edges: DataFrame, start: str, hops: int, mode: str = "level") -> DataFrame:
    """Paths from start of 1 to `hops` hops: node (the end), path, hops. A bag: equal-length paths to one node all count.

    mode "level" drops a step to any node that occurs on any path of the previous level;
    "simple" drops only steps to nodes of the path itself."""
    if mode not in ("level", "simple"):
        raise ValueError(mode)
    pairs = materialize(edges.select("src", "dst").distinct(), "graph-edges")
    now = pairs.filter(F.col("src") == start).select(F.array("src", "dst").alias("path"), F.col("dst").alias("node"))
    levels = []
    for hop in range(1, hops + 1):
        now = materialize(now, "graph-level")
        levels.append(now.withColumn("hops", F.lit(hop)))
        if hop == hops or now.isEmpty():
            break
        ahead = now.join(pairs, now["node"] == pairs["src"]).select("path", "dst")
        if mode == "level":
            ahead = ahead.join(now.select(F.explode("path").alias("dst")).distinct(), "dst", "left_anti")
        else:
            ahead = ahead.filter(~F.array_contains("path", F.col("dst")))
        now = ahead.select(F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("node"))
    return reduce(DataFrame.unionByName, levels).select("node", "path", "hops")


def neighborhood(edges: DataFrame, start: str, hops: int) -> DataFrame:
    return level_paths(edges, start, hops).select("node")


def find_paths(edges: DataFrame, start: str, target: str, most_hops: int = 3, mode: str = "level") -> DataFrame:
    return level_paths(edges, start, most_hops, mode).filter(F.col("node") == target).select("path", "hops")


def shortest_paths(edges: DataFrame, start: str, target: str, most_hops: int | None = None) -> DataFrame:
    """All paths of the least length: path, hops. Nodes are visited once, level by level, up to the level that reaches the
    target (or until none is left); paths are then read back along the steps between levels."""
    pairs = materialize(edges.select("src", "dst").distinct(), "graph-edges")
    seen = fringe = pairs.sparkSession.createDataFrame([(start,)], "node string")
    steps: list[DataFrame] = []
    while most_hops is None or len(steps) < most_hops:
        ahead = pairs.join(fringe, pairs["src"] == fringe["node"], "left_semi").join(seen.select(F.col("node").alias("dst")), "dst", "left_anti")
        steps.append(materialize(ahead.select("src", "dst"), "graph-steps"))
        fringe = steps[-1].select(F.col("dst").alias("node")).distinct()
        seen = seen.union(fringe)
        if steps[-1].isEmpty() or not steps[-1].filter(F.col("dst") == target).isEmpty():
            break
    paths = steps[-1].filter(F.col("dst") == target).select("src", F.array("src", "dst").alias("path")) if steps else pairs.select("src", F.array("src", "dst").alias("path")).limit(0)
    for step in reversed(steps[:-1]):
        paths = step.join(paths.withColumnRenamed("src", "at"), step["dst"] == F.col("at")).select("src", F.array_prepend("path", F.col("src")).alias("path"))
    return paths.select("path", (F.size("path") - 1).alias("hops"))


def count_walks(edges: DataFrame, start: str, target: str, most_hops: int = 5) -> DataFrame:
    """hops, n_walks: how many walks of each length lead from start to target. Counts are added up node by node, so
    the walks themselves are never made."""
    pairs = materialize(edges.select("src", "dst"), "graph-edges")
    at = pairs.sparkSession.createDataFrame([(start, 1)], "node string, n_walks long")
    levels = []
    for hops in range(1, most_hops + 1):
        step = pairs.join(at, pairs["src"] == at["node"]).groupBy(F.col("dst").alias("node")).agg(F.sum("n_walks").alias("n_walks"))
        at = materialize(step, "graph-walks")
        levels.append(at.filter(F.col("node") == target).select(F.lit(hops).alias("hops"), "n_walks"))
    return reduce(DataFrame.union, levels)


def traverse(edges: DataFrame, nodes: DataFrame, hops: int) -> DataFrame:
    """nodes: node -> node, hops (least) of everything reached within `hops`, the start included at 0."""
    pairs = materialize(edges.select("src", "dst").distinct(), "graph-edges")
    fringe = materialize(nodes.select("node").distinct().withColumn("hops", F.lit(0)), "graph-reached")
    seen = fringe
    for hop in range(1, hops + 1):
        step = fringe.join(pairs, fringe["node"] == pairs["src"]).select(F.col("dst").alias("node")).distinct()
        fringe = materialize(step.join(seen, "node", "left_anti").withColumn("hops", F.lit(hop)), "graph-reached")
        if fringe.isEmpty():
            break
        seen = seen.unionByName(fringe)
    return seen


def table_graph(edges: DataFrame) -> DataFrame:
    """Edges between tables with the column pairs that join them: t1, t2, joins array<struct<left, right>>."""
    both = edges.select(table_of("src").alias("t1"), table_of("dst").alias("t2"), F.struct(F.col("src").alias("left"), F.col("dst").alias("right")).alias("j")).filter("t1 <> t2")
    return both.groupBy("t1", "t2").agg(F.array_sort(F.collect_set("j")).alias("joins"))


def table_paths(edges: DataFrame, start: str, target: str, most_hops: int = 3) -> DataFrame:
    """Paths between tables that visit no table twice: tables, hops, n_ways (choices of column pairs along it)."""
    g = materialize(table_graph(edges), "table-graph")
    now = g.filter(F.col("t1") == start).select(F.array("t1", "t2").alias("tables"), F.col("t2").alias("at"), F.size("joins").cast("long").alias("n_ways"))
    levels = []
    for hop in range(1, most_hops + 1):
        now = materialize(now, "table-level")
        levels.append(now.filter(F.col("at") == target).select("tables", F.lit(hop).alias("hops"), "n_ways"))
        if hop == most_hops:
            break
        step = now.filter(F.col("at") != target).join(g, now["at"] == g["t1"]).filter(~F.array_contains("tables", F.col("t2")))
        now = step.select(F.array_append("tables", F.col("t2")).alias("tables"), F.col("t2").alias("at"), (F.col("n_ways") * F.size("joins")).alias("n_ways"))
    return reduce(DataFrame.unionByName, levels)


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("degree"))


def top_connected(edges: DataFrame, k: int) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "node").limit(k)


def pairs_of_relation(edges: DataFrame, relation: str) -> DataFrame:
    """Distinct unordered pairs."""
    own = of_relation(edges, relation)
    return own.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


#: bit of each relation in an edge's bitmap
BITS = {"SCHEMA_SIM": 1, "CONTENT_SIM": 2, "PKFK": 4, "INCLUSION_DEPENDENCY": 8}


def edge_bitmaps(edges: DataFrame) -> DataFrame:
    """src, dst, bits: the relations of each pair in one number."""
    bit = F.lit(0)
    for name, b in BITS.items():
        bit = F.when(F.col("relation") == name, b).otherwise(bit)
    return edges.groupBy("src", "dst").agg(F.bit_or(bit).alias("bits"))


def same_table(columns: DataFrame, nodes: DataFrame) -> DataFrame:
    """columns: node of every column -> the other columns of the nodes' tables: origin, node."""
    own = nodes.select(F.col("node").alias("origin"), table_of("node").alias("t"))
    return columns.select("node", table_of("node").alias("t")).join(own, "t").filter("node <> origin").select("origin", "node")


def synthetic_network(spark, nodes: int, per_table: int, edges: dict[str, int], seed: int = 1) -> DataFrame:
    """A random graph of columns with the given number of edges per relation, for benchmarks."""
    parts = []
    for k, (relation, n) in enumerate(sorted(edges.items())):
        pick = lambda s: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.lit(s), "id"), F.lit(nodes))  # noqa: E731, B023
        name = lambda c: F.concat(F.lit("t"), F.floor(c / per_table).cast("string"), F.lit(".c"), c.cast("string"))
        parts.append(spark.range(n).select(name(pick("a")).alias("src"), name(pick("b")).alias("dst"), F.lit(relation).alias("relation"), F.lit(1.0).alias("weight")))
    return reduce(DataFrame.unionByName, parts)
