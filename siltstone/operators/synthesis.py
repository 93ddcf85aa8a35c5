"""View synthesis on demand: filters, consistent samples, ranked join graphs, view scores."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import cells
from siltstone.operators.examples import Example, JoinGraph, candidate_columns


def cell_filter(table: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose cell equals the value after normalisation."""
    kind = next(f.dataType for f in table.schema.fields if f.name == column)
    return table.filter(cells.normal(cells.cell_text(F.col(f"`{column}`"), kind)) == value.strip().lower())


def attribute_filter(values: DataFrame, attribute: str) -> DataFrame:
    return values.filter(F.lower("column_name").contains(attribute.strip().lower())).select("source", "column_name").distinct()


def value_filter(values: DataFrame, value: str) -> DataFrame:
    return values.filter(F.col("value") == value.strip().lower()).select("source", "column_name").distinct()


def joint_filter(values: DataFrame, attribute: str, value: str) -> DataFrame:
    """Columns that pass both."""
    return attribute_filter(values, attribute).join(value_filter(values, value), ["source", "column_name"], "left_semi")


def equi_join(a: DataFrame, b: DataFrame, left: str, right: str, suffix: str = "_y") -> DataFrame:
    """Inner join on normalised keys; missing keys match nothing; clashing names of b get the suffix."""
    clash = set(a.columns)
    b = b.toDF(*[c + suffix if c in clash else c for c in b.columns])
    right = right + suffix if right in clash else right
    key = lambda t, c: cells.normal(cells.cell_text(t[c], t.schema[c].dataType))
    return a.join(b, key(a, left) == key(b, right))


def fold_tree(tables: Mapping[str, DataFrame], hops: Sequence[tuple[tuple[str, str], tuple[str, str]]], suffix: str = "_x") -> DataFrame:
    """The join of a tree of tables, given by pairs of (table, column): the first table is the root, and each subtree is
    folded before its parent takes it in. Each join's suffix for clashing names is longer than the one before."""
    parents: dict[str, list[tuple[str, str, str]]] = {hops[0][0][0]: []}
    pending = list(hops)
    while pending:
        later = []
        for left, right in pending:
            known, new = (left, right) if left[0] in parents else (right, left)
            if known[0] not in parents:
                later.append((left, right))
            elif new[0] in parents:
                raise ValueError(f"a tree reaches {new[0]} once")
            else:
                parents[known[0]].append((known[1], *new))
                parents[new[0]] = []
        if len(later) == len(pending):
            raise ValueError(f"no path from {hops[0][0][0]} to {later[0][0][0]}")
        pending = later
    grown = 0

    def fold(table: str) -> DataFrame:
        nonlocal grown
        out = tables[table]
        for own, child, column in parents[table]:
            below = fold(child)
            grown += 1
            out = equi_join(out, below, own, column, suffix * grown)
        return out

    return fold(hops[0][0][0])


def join_size(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """n_rows: how many rows the join would have, without making them."""
    n = lambda t, c, k: t.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("key")).agg(F.count("*").alias(f"n{k}"))
    return n(a, left, 1).join(n(b, right, 2), "key").agg(F.coalesce(F.sum(F.col("n1") * F.col("n2")), F.lit(0)).alias("n_rows"))


def consistent_sample(a: DataFrame, b: DataFrame, left: str, right: str, n: int) -> DataFrame:
    """The join of one row per key over the n common-side keys of greatest hash, so that samples of joinable tables
    meet. Keys are sampled on the side with fewer of them."""
    ka, kb = (t.filter(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("key")).distinct() for t, c in ((a, left), (b, right)))
    fewer = ka if ka.count() <= kb.count() else kb
    chosen = fewer.withColumn("h", F.md5("key")).orderBy(F.desc("h")).limit(n).select("key")

    def one(t: DataFrame, c: str, s: str) -> DataFrame:
        own = t.withColumn("key", F.col(c).cast("string")).join(chosen, "key", "left_semi")
        whole = F.struct(*[F.col(x) for x in t.columns])
        return own.groupBy("key").agg(F.min(whole).alias(s))

    return one(a, left, "a").join(one(b, right, "b"), "key").select("key", *[F.col(f"a.{c}").alias(f"a_{c}") for c in a.columns], *[F.col(f"b.{c}").alias(f"b_{c}") for c in b.columns])


def materializable(tables: dict[str, DataFrame], graph: JoinGraph, filters: dict[str, tuple[str, str]]) -> bool:
    """Whether the join has a row once each table is filtered (table -> column, value)."""
    side = lambda t: cell_filter(tables[t], *filters[t]) if t in filters else tables[t]
    first = graph.joins[0][0][0] if graph.joins else graph.tables[0]
    norm = lambda t, d, c: cells.normal(cells.cell_text(d[c], d.schema[c].dataType)).alias(f"{t}.{c}")
    need = lambda t: sorted({c for j in graph.joins for x, c in j if x == t})
    pick = lambda t: (lambda d: d.select(*[norm(t, d, c) for c in need(t)], F.lit(1).alias(f"{t}._")))(side(t))
    out = pick(first)
    for (lt, lc), (rt, rc) in graph.joins:
        out = out.join(pick(rt), F.col(f"`{lt}.{lc}`") == F.col(f"`{rt}.{rc}`"))
    return not out.isEmpty()


def graph_score(hop_uniqueness: Sequence[float], n_tables: int) -> float:
    """Mean of the larger uniqueness of each hop, less for more tables."""
    if not hop_uniqueness:
        return 1.0
    return sum(hop_uniqueness) / len(hop_uniqueness) / (1 + log(1 + log(max(1, n_tables))))


def rank_graphs(graphs: Sequence[JoinGraph], uniqueness: DataFrame) -> list[tuple[float, JoinGraph]]:
    u = {(r.source, r.column_name): r.uniqueness for r in uniqueness.collect()}  # one row per column
    scored = [(graph_score([max(u.get(l, 0.0), u.get(r, 0.0)) for l, r in g.joins], len(g.tables)), g) for g in graphs]
    return sorted(scored, key=lambda x: (-x[0], x[1].hops, x[1].joins))


def explore(values: DataFrame, spec: Sequence[Example]) -> Iterator[tuple[str, ...]]:
    """Sets of tables that together serve every position of the specification, the widest table first: each table
    is taken as pivot and tables that add positions are joined to it until all are covered."""
    serves: dict[str, set[int]] = {}
    for r in candidate_columns(values, spec).select("position", "source").distinct().collect():  # metadata
        serves.setdefault(r.source, set()).add(r.position)
    order = sorted(serves, key=lambda t: (-len(serves[t]), t))
    every = set(range(len(spec)))
    seen: set[tuple[str, ...]] = set()
    for pivot in order:
        have, group = set(serves[pivot]), [pivot]
        for t in order:
            if have >= every:
                break
            if t != pivot and serves[t] - have:
                group.append(t)
                have |= serves[t]
        key = tuple(sorted(group))
        if have >= every and key not in seen:
            seen.add(key)
            yield key


def example_fit(view: DataFrame, examples: Sequence[Sequence[str]], n_tables: int) -> DataFrame:
    """row_score (sum over example rows of the best sum of token Jaccards in one row), column_score (sum over example
    cells of the best in its column) and score of a view against example rows; one pass over the view."""
    words = [cells.terms(F.lower(F.coalesce(cells.cell_text(F.col(f"`{f.name}`"), f.dataType), F.lit("")))) for f in view.schema.fields]
    given = lambda s: cells.terms(F.lit(s))
    cell = [[cells.jaccard(F.array_distinct(words[c]), F.array_distinct(given(x))) for c, x in enumerate(row)] for row in examples]
    best_rows = [F.max(sum(row[1:], row[0])) for row in cell]
    best_cells = [F.max(x) for row in cell for x in row]
    out = view.agg(sum(best_rows[1:], best_rows[0]).alias("row_score"), sum(best_cells[1:], best_cells[0]).alias("column_score"))
    fit = (0.5 * F.col("row_score") + 0.5 * F.col("column_score")) / (1 + log(1 + log(max(1, n_tables))))
    return out.select(F.round("row_score", 6).alias("row_score"), F.round("column_score", 6).alias("column_score"), F.round(fit, 6).alias("score"))


def codes(table: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column numbered in order: value, code. Numbers come from range totals and ranks
    within ranges, so no task orders a whole column."""
    from siltstone.operators.prefix import running_sums

    d = table.select(F.col(column).cast("string").alias("value")).filter("value is not null").distinct()
    lead = F.rpad(F.hex(F.substring(F.col("value").cast("binary"), 1, 7)), 14, "0")  # as a number, in the order of the texts
    ranked = d.select("value", F.lit(0).alias("g"), F.lit(1).alias("one"), F.conv(lead, 16, 10).cast("long").alias("k"))
    return running_sums(ranked, ["g"], "k", ["one"], then=["value"]).select("value", (F.col("cum_one") - 1).alias("code"))


def column_correlation(pairs: DataFrame, a: str, b: str) -> Column:
    """Pearson correlation of two numeric columns; null with under two distinct values on a side."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = (F.when(both, F.col(c).cast("double")) for c in (a, b))
    return F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.corr(x, y))


def path_correlation(hops: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """hop, correlation: for each hop of a join path the correlation of two columns of the table it passes through;
    1 for the same column."""
    out = None
    for k, (table, a, b) in enumerate(hops):
        c = F.lit(1.0) if a == b else F.round(column_correlation(table, a, b), 6)
        row = table.agg(c.alias("correlation")).select(F.lit(k).alias("hop"), "correlation")
        out = row if out is None else out.union(row)
    return out


def noise_columns(truth: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """n_inside, n_outside: distinct values of a similar column that the true column has and lacks."""
    t, o = truth.select(column).distinct(), other.select(column).distinct()
    inside = o.join(t, column, "left_semi").agg(F.count("*").alias("n_inside"))
    outside = o.join(t, column, "left_anti").agg(F.count("*").alias("n_outside"))
    return inside.crossJoin(F.broadcast(outside))  # one row each


def sample_per_key(table: DataFrame, key: str, n: int = 1) -> DataFrame:
    """n rows of each key, the ones of least content hash."""
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in table.columns]))
    by = Window.partitionBy(key).orderBy(h)
    return table.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= n).drop("_r")
