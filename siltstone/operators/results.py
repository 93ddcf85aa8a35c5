"""Result sets of discovery queries: set algebra, lineage and ranking.

A result set holds hits(node, source, score) and lineage(src, dst, op). Operations are lazy
DataFrame plans; nothing is evaluated until the caller acts on hits or lineage.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import graph
from siltstone.plans.shared import materialize

FIELDS, TABLE = "fields", "table"
HITS, LINEAGE = "node string, source string, score double", "src string, dst string, op string"


@dataclass(frozen=True)
class ResultSet:
    hits: DataFrame
    lineage: DataFrame
    mode: str = FIELDS

    # ------------------------------------------------------------ set algebra

    def _alike(self, other: ResultSet) -> None:
        if self.mode != other.mode:
            raise ValueError(f"{self.mode} and {other.mode} results don't mix")

    def union(self, other: ResultSet) -> ResultSet:
        """By node; a node of both keeps its better score."""
        self._alike(other)
        hits = self.hits.unionByName(other.hits).groupBy("node").agg(F.first("source").alias("source"), F.max("score").alias("score"))
        return replace(self, hits=hits, lineage=self._both(other))

    def intersect(self, other: ResultSet) -> ResultSet:
        """By node; in table mode the hits of both sides whose tables coincide."""
        self._alike(other)
        if self.mode == TABLE:
            mine = self.hits.join(other.hits.select("source").distinct(), "source", "left_semi")
            theirs = other.hits.join(self.hits.select("source").distinct(), "source", "left_semi")
            hits = mine.unionByName(theirs).groupBy("node").agg(F.first("source").alias("source"), F.max("score").alias("score"))
        else:
            hits = self.hits.join(other.hits.select("node"), "node", "left_semi").select("node", "source", "score")
        return replace(self, hits=hits, lineage=self._both(other))

    def minus(self, other: ResultSet) -> ResultSet:
        self._alike(other)
        return replace(self, hits=self.hits.join(other.hits.select("node"), "node", "left_anti"), lineage=self._both(other))

    def _both(self, other: ResultSet) -> DataFrame:
        """Nodes that both lineages lead to are marked AND, as both sides vouch for them."""
        mine, theirs = self.lineage, other.lineage
        shared = mine.select("dst").distinct().join(theirs.select("dst").distinct(), "dst", "left_semi").withColumn("both", F.lit(True))
        every = mine.unionByName(theirs, allowMissingColumns=True)
        if "annotation" in every.columns:
            every = every.drop("annotation")
        return every.distinct().join(shared, "dst", "left").select("src", "dst", "op", F.when(F.col("both"), "AND").alias("annotation"))

    def as_fields(self) -> ResultSet:
        return replace(self, mode=FIELDS)

    def as_tables(self) -> ResultSet:
        return replace(self, mode=TABLE)

    def items(self) -> DataFrame:
        """Hits, or in table mode distinct tables."""
        return self.hits if self.mode == FIELDS else self.hits.select("source").distinct()

    # ------------------------------------------------------------ expansion

    def neighbors(self, edges: DataFrame, relation: str | None = None, columns: DataFrame | None = None) -> ResultSet:
        """Columns of other tables related to the hits (in table mode to any column of their tables, named in columns(node))."""
        nodes = self.hits.select("node")
        if self.mode == TABLE and columns is not None:
            nodes = columns.join(self.hits.select(F.col("source").alias("t")).distinct(), graph.table_of("node") == F.col("t")).select("node")
        found = graph.neighbors(edges, nodes, relation)
        hits = found.groupBy("node").agg(F.max("weight").alias("score")).select("node", graph.table_of("node").alias("source"), "score")
        steps = found.select(F.col("origin").alias("src"), F.col("node").alias("dst"), F.col("relation").alias("op"))
        return ResultSet(hits, self.lineage.unionByName(steps, allowMissingColumns=True).distinct(), self.mode)

    # ------------------------------------------------------------ lineage

    def origins(self) -> DataFrame:
        """Nodes that nothing leads to (two-cycles aside): node."""
        back = self.lineage.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
        one_way = self.lineage.select("src", "dst").join(back, ["src", "dst"], "left_anti")
        nodes = self.lineage.select(F.col("src").alias("node")).distinct()
        return nodes.join(one_way.select(F.col("dst").alias("node")), "node", "left_anti")

    def ends(self) -> DataFrame:
        nodes = self.lineage.select(F.col("dst").alias("node")).distinct()
        return nodes.join(self.lineage.select(F.col("src").alias("node")), "node", "left_anti")

    def reached(self) -> DataFrame:
        """origin, node: what each origin leads to, itself included; breadth first, until no pair is new."""
        steps = materialize(self.lineage.select("src", "dst").distinct(), "lineage")
        seen = new = materialize(self.origins().select(F.col("node").alias("origin"), "node"), "lineage-level")
        while not new.isEmpty():
            ahead = new.join(steps, new["node"] == steps["src"]).select("origin", F.col("dst").alias("node")).distinct()
            new = materialize(ahead.join(seen, ["origin", "node"], "left_anti"), "lineage-level")
            seen = seen.unionByName(new)
        return seen

    def lineage_paths(self, most_hops: int = 12) -> DataFrame:
        """All simple paths from origins: origin, node, path, ops, score (of the hits along it). There may be very many;
        an error is raised if some are longer than `most_hops`."""
        steps = materialize(self.lineage.select("src", "dst", "op").distinct(), "lineage")
        score = materialize(self.hits.select("node", "score"), "lineage-hits")
        now = self.origins().select(F.col("node").alias("origin"), "node", F.array("node").alias("path"), F.array().cast("array<string>").alias("ops"))
        out = None
        for _ in range(most_hops + 2):
            now = materialize(now, "lineage-level")
            if now.isEmpty():
                break
            out = now if out is None else out.unionByName(now)
            now = now.join(steps, now["node"] == steps["src"]).filter(~F.array_contains("path", F.col("dst")))
            now = now.select("origin", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"), F.array_append("ops", F.col("op")).alias("ops"))
        else:
            raise RuntimeError(f"lineage has paths of more than {most_hops} hops")
        out = now if out is None else out
        along = out.withColumn("_k", F.explode("path")).join(score.select(F.col("node").alias("_k"), "score"), "_k", "left")
        return along.groupBy("origin", "node", "path", "ops").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("score"))

    def why(self, node: str) -> DataFrame:
        """Origins that lead to the node."""
        return self.reached().filter(F.col("node") == node).select("origin").distinct()

    def how(self, node: str) -> DataFrame:
        """One line for each path to the node."""
        steps = F.zip_with(F.slice("path", 2, F.size("path")), F.col("ops"), lambda n, o: F.concat(F.lit(" -"), o, F.lit("-> "), n))
        return self.lineage_paths().filter(F.col("node") == node).select(F.concat(F.col("path")[0], F.array_join(steps, "")).alias("explanation"))

    # ------------------------------------------------------------ ranking

    def rank_certainty(self) -> DataFrame:
        """node, certainty: the largest sum of scores along a path to it."""
        best = self.lineage_paths().groupBy("node").agg(F.max("score").alias("certainty"))
        return self.hits.select("node").join(best, "node", "left").select("node", F.coalesce("certainty", F.lit(0.0)).alias("certainty"))

    def rank_coverage(self) -> DataFrame:
        """item, coverage: the share of origins that lead to a node (in table mode to any hit of the table)."""
        reach = self.reached()
        n = self.origins().agg(F.count("*").alias("n"))
        item = "node" if self.mode == FIELDS else "source"
        per = self.hits.select("node", "source").join(reach, "node").groupBy(F.col(item).alias("item")).agg(F.count_distinct("origin").alias("k"))
        return per.crossJoin(F.broadcast(n)).select("item", (F.col("k") / F.col("n")).alias("coverage"))  # n is one row


def from_search(found: DataFrame, query: str, op: str = "KW_LOOKUP") -> ResultSet:
    """found: source, column_name, score, as a search returns them; the query is the origin."""
    hits = found.select(F.concat_ws(".", "source", "column_name").alias("node"), "source", F.col("score").cast("double").alias("score"))
    return ResultSet(hits, hits.select(F.lit(f"?{query}").alias("src"), F.col("node").alias("dst"), F.lit(op).alias("op")))


def of_columns(spark: SparkSession, nodes: list[str]) -> ResultSet:
    """Named columns ("table.column") as a result set of their own origin."""
    hits = spark.createDataFrame([(n, n.split(".", 1)[0], 1.0) for n in nodes], HITS)
    return ResultSet(hits, spark.createDataFrame([], LINEAGE))


def of_tables(columns: DataFrame, tables: list[str]) -> ResultSet:
    """All columns of the tables; columns: node."""
    hits = columns.filter(graph.table_of("node").isin(tables)).select("node", graph.table_of("node").alias("source"), F.lit(1.0).alias("score"))
    return ResultSet(hits, hits.sparkSession.createDataFrame([], LINEAGE), TABLE)


def to_result_set(spark: SparkSession, x, columns: DataFrame) -> ResultSet:
    """A result set as it is, a column name, a table name, or a list of these."""
    if isinstance(x, ResultSet):
        return x
    if isinstance(x, str):
        return of_columns(spark, [x]) if "." in x else of_tables(columns, [x])
    out = None
    for part in x:
        one = to_result_set(spark, part, columns).as_fields()
        out = one if out is None else out.union(one)
    if out is None:
        return of_columns(spark, [])
    return out


def report(profiles: DataFrame, edges: DataFrame) -> DataFrame:
    """fact, n: tables, columns, columns of each type, pairs of each relation."""
    kinds = profiles.groupBy(F.concat(F.lit("columns of type "), "data_type").alias("fact")).agg(F.count("*").alias("n"))
    rel = edges.select("relation", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().groupBy(F.concat(F.lit("pairs of "), "relation").alias("fact")).agg(F.count("*").alias("n"))
    total = profiles.agg(F.count_distinct("source").alias("tables"), F.count("*").alias("columns")).select(F.inline(F.array(F.struct(F.lit("tables").alias("fact"), F.col("tables").alias("n")), F.struct(F.lit("columns").alias("fact"), F.col("columns").alias("n")))))
    return total.unionByName(kinds).unionByName(rel)
