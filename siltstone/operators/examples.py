"""Query by example: from example values to columns, groups of tables, join graphs and views.

Finding columns is one join of the examples with the value index. What follows is about
candidate columns and edges between them, some thousands of rows of metadata at most, so
join graphs are enumerated on the driver and each becomes one DataFrame plan.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations, product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import cells
from siltstone.operators.components import connected_components
from siltstone.operators.textsearch import edits_allowed
from siltstone.sources.catalog import Catalog


@dataclass(frozen=True)
class Example:
    attribute: str
    values: tuple[str, ...]


def candidate_columns(values: DataFrame, spec: Sequence[Example], fuzzy: bool = False) -> DataFrame:
    """position, source, column_name, n_examples, hit (CELL, ATTR or ATTR_CELL): the columns that hold every distinct
    example of a position, or, for a position without examples, those whose name fits the attribute."""
    spark = values.sparkSession
    wanted = [(k, v) for k, e in enumerate(spec) for v in {x.strip().lower() for x in e.values} if v]
    need = {k: sum(p == k for p, _ in wanted) for k in range(len(spec))}
    if fuzzy and wanted:
        # the user's examples are part of the expression: one pass over the values, no join
        fits = F.array(*[F.when(F.length("value").between(len(x) - edits_allowed(x), len(x) + edits_allowed(x)) & (F.levenshtein(F.col("value"), F.lit(x)) <= edits_allowed(x)), F.struct(F.lit(k).alias("position"), F.lit(x).alias("example"))) for k, x in wanted])
        hits = values.select("source", "column_name", F.explode(F.array_compact(fits)).alias("x")).select("source", "column_name", "x.position", "x.example")
    else:
        examples = spark.createDataFrame(wanted, "position int, example string")
        hits = values.join(examples, F.col("value") == F.col("example"))
    by_cell = hits.groupBy("position", "source", "column_name").agg(F.count_distinct("example").alias("n_examples"))
    names = values.select("source", "column_name").distinct()
    asked = spark.createDataFrame([(k, e.attribute.strip().lower()) for k, e in enumerate(spec) if e.attribute.strip()], "position int, attribute string")
    words = lambda c: F.array_sort(F.array_distinct(cells.name_terms(F.col(c))))
    all_words = F.size(F.array_except(words("attribute"), words("column_name"))) == 0
    by_name = names.join(F.broadcast(asked), all_words | (F.lower("column_name") == F.col("attribute"))).select("position", "source", "column_name", F.lit(True).alias("named"))
    both = by_cell.join(by_name, ["position", "source", "column_name"], "full").withColumn("n_examples", F.coalesce("n_examples", F.lit(0)))
    enough = F.element_at(F.create_map(*[F.lit(x) for k, n in need.items() for x in (k, n)]), F.col("position"))
    hit = F.when(F.col("named") & (F.col("n_examples") > 0), "ATTR_CELL").when(F.col("named"), "ATTR").otherwise("CELL")
    return both.filter(F.col("n_examples") >= enough).select("position", "source", "column_name", F.col("n_examples").cast("long").alias("n_examples"), hit.alias("hit"))


def candidates_or_fuzzy(values: DataFrame, spec: Sequence[Example], most: int = 50) -> DataFrame:
    """position, example, source, column_name, hit (EXACT or FUZZY): for each example the columns that hold it, or, where none
    does, those that hold a value within its edits; of each example the `most` columns with the most such cells."""
    from pyspark.sql import Window

    spark = values.sparkSession
    wanted = sorted({(k, v) for k, e in enumerate(spec) for v in (x.strip().lower() for x in e.values) if v})
    if not wanted:
        return spark.createDataFrame([], "position int, example string, source string, column_name string, hit string")
    one = lambda k, x: F.struct(F.lit(k).alias("position"), F.lit(x).alias("example"), F.levenshtein(F.col("value"), F.lit(x)).alias("d"))
    near = F.array_compact(F.array(*[F.when(F.length("value").between(len(x) - edits_allowed(x), len(x) + edits_allowed(x)) & (F.levenshtein(F.col("value"), F.lit(x)) <= edits_allowed(x)), one(k, x)) for k, x in wanted]))
    hits = values.select("source", "column_name", "cnt", F.explode(near).alias("x")).groupBy("x.position", "x.example", "source", "column_name").agg(F.sum("cnt").alias("n"), F.sum(F.when(F.col("x.d") == 0, F.col("cnt")).otherwise(0)).alias("same"))
    per = Window.partitionBy("position", "example")
    kept = hits.withColumn("exact", F.max("same").over(per) > 0).filter("not exact or same > 0").withColumn("m", F.when(F.col("exact"), F.col("same")).otherwise(F.col("n")))
    best = kept.withColumn("r", F.row_number().over(per.orderBy(F.desc("m"), "source", "column_name"))).filter(F.col("r") <= most)  # a row per column
    return best.select("position", "example", "source", "column_name", F.when(F.col("exact"), "EXACT").otherwise("FUZZY").alias("hit"))


def best_clusters(candidates: DataFrame, similar: DataFrame) -> DataFrame:
    """Candidates of a position that are similar to each other (similar: src, dst) form clusters, scored by their
    largest number of examples; only the best clusters stay."""
    from pyspark.sql import Window

    own = candidates.withColumn("node", F.concat_ws(".", "source", "column_name"))
    links = similar.select("src", "dst").join(own.select(F.col("node").alias("src"), F.col("position")), "src").join(own.select(F.col("node").alias("dst"), F.col("position").alias("p2")), "dst").filter("position = p2")
    key = lambda c: F.concat_ws("|", F.col("position").cast("string"), F.col(c))
    comp = connected_components(links.select(key("src").alias("a"), key("dst").alias("b")), "a", "b")
    labelled = own.withColumn("k", key("node")).join(comp.withColumnRenamed("node", "k"), "k", "left")
    scored = labelled.withColumn("cluster", F.coalesce("component", "k")).withColumn("score", F.max("n_examples").over(Window.partitionBy("position", "cluster")))
    best = scored.withColumn("best", F.max("score").over(Window.partitionBy("position"))).filter("score = best")
    return best.select("position", "source", "column_name", "n_examples", "hit", "cluster")


Column = tuple[str, str]  # table, column
Group = tuple[tuple[str, ...], list[tuple[Column, ...]]]


def candidate_groups(candidates: DataFrame, n_positions: int, most_tables: int = 2) -> list[Group]:
    """Sets of at most `most_tables` tables that offer a column for every position, fewest tables first, each with
    its choices of columns. Tables are extended position by position and sets that grow too large are dropped at once."""
    offers: dict[int, dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
    for r in candidates.select("position", "source", "column_name").distinct().collect():  # metadata
        offers[r.position][r.source].append(r.column_name)
    sets: dict[frozenset, None] = {frozenset(): None}
    for p in range(n_positions):
        sets = {grown: None for s in sets for t in sorted(offers[p]) if len(grown := s | {t}) <= most_tables}
    out = []
    for s in sorted((tuple(sorted(s)) for s in sets), key=lambda s: (len(s), s)):
        choices = [[(t, c) for t in s for c in sorted(offers[p].get(t, ()))] for p in range(n_positions)]
        options = [o for o in product(*choices) if {t for t, _ in o} == set(s)]
        if options:
            out.append((s, options))
    return out


Join = tuple[Column, Column]


@dataclass(frozen=True)
class JoinGraph:
    """Table joins in an order in which each one adds to what is joined already."""

    tables: tuple[str, ...]
    joins: tuple[Join, ...]

    @property
    def hops(self) -> int:
        return len(self.joins)


class JoinPaths:
    """Ways to join two tables, from edges between columns; results are kept for both directions."""

    def __init__(self, edges: Sequence[tuple[str, str]], most_hops: int = 1) -> None:
        self.steps: dict[str, set[Join]] = defaultdict(set)
        for a, b in edges:
            left, right = tuple(a.split(".", 1)), tuple(b.split(".", 1))
            if left[0] != right[0]:
                self.steps[left[0]].add((left, right))
                self.steps[right[0]].add((right, left))
        self.most_hops = most_hops
        self.known: dict[Join | tuple[str, str], list[tuple[Join, ...]]] = {}

    def between(self, a: str, b: str) -> list[tuple[Join, ...]]:
        if (a, b) not in self.known:
            found, level = [], [((), a, (a,))]
            for _ in range(self.most_hops):
                ahead = []
                for path, at, seen in level:
                    for step in sorted(self.steps[at]):
                        to = step[1][0]
                        if to == b:
                            found.append((*path, step))
                        elif to not in seen:
                            ahead.append(((*path, step), to, (*seen, to)))
                level = ahead
            self.known[a, b] = found
            self.known[b, a] = [tuple((r, l) for l, r in reversed(p)) for p in found]
        return self.known[a, b]


def join_graphs(tables: Sequence[str], paths: JoinPaths, chain: bool = True) -> Iterator[JoinGraph]:
    """Join graphs of a group: a chain over the sorted tables, or every tree over them."""
    tables = sorted(tables)
    if len(tables) == 1:
        yield JoinGraph(tuple(tables), ())
        return
    pairs = list(combinations(tables, 2))
    unjoinable = sum(not paths.between(a, b) for a, b in pairs)
    if unjoinable > len(pairs) - (len(tables) - 1):
        return
    trees = [list(zip(tables, tables[1:]))] if chain else [t for t in combinations(pairs, len(tables) - 1) if _connected(tables, t)]
    for tree in trees:
        for choice in product(*[paths.between(a, b) for a, b in tree]):
            ordered = _ordered(tables[0], [j for p in choice for j in p])
            if ordered is not None:
                yield JoinGraph(tuple(tables), ordered)


def _connected(tables: Sequence[str], tree) -> bool:
    reached = {tables[0]}
    for _ in tables:
        reached |= {x for e in tree for x in e if set(e) & reached}
    return reached == set(tables)


def _ordered(start: str, joins: list[Join]) -> tuple[Join, ...] | None:
    """Breadth first from start; a join into a table that is there already is dropped."""
    seen, out, rest = {start}, [], list(joins)
    while rest:
        for j in rest:
            l, r = j if j[0][0] in seen else (j[1], j[0])
            if l[0] in seen:
                rest.remove(j)
                if r[0] not in seen:
                    seen.add(r[0])
                    out.append((l, r))
                break
        else:
            return None
    return tuple(out)


def _side(catalog: Catalog, table: str, columns: set[str]) -> DataFrame:
    kinds = {f.name: f.dataType for f in catalog.tables[table].schema.fields}
    return catalog.tables[table].select(*[cells.normal(cells.cell_text(F.col(f"`{c}`"), kinds[c])).alias(f"{table}.{c}") for c in sorted(columns)])


def materialize_view(catalog: Catalog, graph: JoinGraph, columns: Sequence[Column]) -> DataFrame:
    """The inner equi-joins of the graph on normalised keys (missing keys match nothing), and the chosen columns.
    Only these and the keys are read."""
    needed: dict[str, set[str]] = defaultdict(set)
    for t, c in [*columns, *[x for j in graph.joins for x in j]]:
        needed[t].add(c)
    first = graph.joins[0][0][0] if graph.joins else graph.tables[0]
    out = _side(catalog, first, needed[first])
    for (lt, lc), (rt, rc) in graph.joins:
        out = out.join(_side(catalog, rt, needed[rt]), F.col(f"`{lt}.{lc}`") == F.col(f"`{rt}.{rc}`"))
    return out.select(*[F.col(f"`{t}.{c}`").alias(n) for (t, c), n in zip(columns, view_names(columns))])


def view_names(columns: Sequence[Column]) -> list[str]:
    """Column names without their tables, numbered where they clash."""
    seen: dict[str, int] = defaultdict(int)
    out = []
    for _, c in columns:
        seen[c] += 1
        out.append(c if seen[c] == 1 else f"{c}_{seen[c]}")
    return out


def views(catalog: Catalog, values: DataFrame, edges: DataFrame, spec: Sequence[Example], most_tables: int = 2, most_hops: int = 1, chain: bool = True) -> Iterator[tuple[JoinGraph, tuple[Column, ...], DataFrame]]:
    """The whole way from examples to lazy views, best groups first. edges: src, dst."""
    found = candidate_columns(values, spec)
    paths = JoinPaths([(r.src, r.dst) for r in edges.select("src", "dst").distinct().collect()], most_hops)  # metadata
    for tables, options in candidate_groups(found, len(spec), most_tables):
        for graph in join_graphs(tables, paths, chain):
            for columns in options:
                yield graph, columns, materialize_view(catalog, graph, columns)
