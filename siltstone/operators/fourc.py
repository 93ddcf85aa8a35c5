"""Four relations between views: compatible, contained, contradictory, complementary.

All views of one schema (the same column names in any order) are laid out in one table of
distinct normalised rows; rows with a missing cell are dropped. Views are compared through
what they have in common: the views that hold a row, or a value of a candidate key, are
gathered (at most as many as there are views), equal patterns are counted, and only distinct
patterns are expanded to pairs of views. So nothing grows with the square of the rows, and a
key value that very many rows share is two strings (its least and its greatest row).
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import cells
from siltstone.operators.values import co_occurrence
from siltstone.plans.shared import materialize

SEP = "\x1f"


def schema_group(view: DataFrame) -> str:
    return ",".join(sorted(view.columns))


def curated(view: DataFrame) -> DataFrame:
    """Normalised text cells; no missing cells, no repeated rows; columns in order of name."""
    kinds = {f.name: f.dataType for f in view.schema.fields}
    out = view.select(*[cells.normal(cells.cell_text(F.col(f"`{c}`"), kinds[c])).alias(c) for c in sorted(view.columns)])
    return out.dropna().distinct()


def layout(views: Mapping[str, DataFrame]) -> DataFrame:
    """schema, view, cells map<string,string>, row: every distinct row of every view, written to the shared folder."""
    parts = []
    for name in sorted(views):
        v = curated(views[name])
        pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in v.columns]), F.array(*[F.col(f"`{c}`") for c in v.columns]))
        row = F.concat_ws(SEP, *[F.col(f"`{c}`") for c in v.columns])
        parts.append(v.select(F.lit(schema_group(v)).alias("schema"), F.lit(name).alias("view"), pairs.alias("cells"), row.alias("row")))
    return materialize(reduce(DataFrame.union, parts), "view-rows")


def row_pairs(rows: DataFrame) -> DataFrame:
    """schema, view1, view2 (view1 < view2), overlap, n1, n2: views of one schema that share a row."""
    sizes = rows.groupBy("schema", "view").agg(F.count("*").alias("n"))
    owner = F.struct("schema", "view")
    pairs = co_occurrence(rows.select(owner.alias("v"), "schema", "row"), ["schema", "row"], "v")
    flat = pairs.select(F.col("a.schema").alias("schema"), F.col("a.view").alias("view1"), F.col("b.view").alias("view2"), "overlap")
    one, two = (sizes.select("schema", F.col("view").alias(f"view{k}"), F.col("n").alias(f"n{k}")) for k in (1, 2))
    return flat.join(one, ["schema", "view1"]).join(two, ["schema", "view2"])


def compatible(pairs: DataFrame) -> DataFrame:
    """pairs: row_pairs. Views with the same rows."""
    return pairs.filter("overlap = n1 and overlap = n2").select("view1", "view2")


def contained(pairs: DataFrame) -> DataFrame:
    """container, inside: proper subsets."""
    a = pairs.filter("overlap = n1 and n1 < n2").select(F.col("view2").alias("container"), F.col("view1").alias("inside"))
    return a.union(pairs.filter("overlap = n2 and n2 < n1").select(F.col("view1"), F.col("view2")))


def fingerprints(rows: DataFrame) -> DataFrame:
    """view, n, total, mix: equal for views with equal rows, whatever their order."""
    h = F.xxhash64("row")
    return rows.groupBy("schema", "view").agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("total"), F.bit_xor(h).alias("mix"))


def key_columns(view: DataFrame, most: int = 2) -> list[tuple[str, ...]]:
    """Combinations that may be keys: of non-floating columns, never all columns of the view."""
    names = sorted(f.name for f in view.schema.fields if not isinstance(f.dataType, cells.FLOATING))
    top = min(most, len(view.columns) - 1)
    return [c for k in range(1, top + 1) for c in combinations(names, k)]


def keyed(rows: DataFrame, views: Mapping[str, DataFrame], most: int = 2) -> DataFrame:
    """schema, view, key, value, lo, hi: for each value of each possible key its least and greatest row, and n rows."""
    parts = []
    for name in sorted(views):
        combos = key_columns(views[name], most)
        if not combos:
            continue
        keys = F.array(*[F.struct(F.lit("+".join(c)).alias("key"), F.concat_ws(SEP, *[F.col("cells")[x] for x in c]).alias("value")) for c in combos])
        parts.append(rows.filter(F.col("view") == name).select("schema", "view", "row", F.inline(keys)))
    out = reduce(DataFrame.union, parts).groupBy("schema", "view", "key", "value")
    return materialize(out.agg(F.min("row").alias("lo"), F.max("row").alias("hi"), F.count("*").alias("n")), "view-keys")


def candidate_keys(keys: DataFrame, least: float = 0.9, eps: float = 1e-8) -> DataFrame:
    """view, key, strength: the keys of largest distinct / rows, if that is at least `least`."""
    s = keys.groupBy("view", "key").agg((F.count("*") / F.sum("n")).alias("strength"))
    best = F.max("strength").over(Window.partitionBy("view"))
    return s.withColumn("best", best).filter((F.col("strength") >= least - eps) & (F.col("strength") >= F.col("best") - eps)).select("view", "key", "strength")


def key_conflicts(keys: DataFrame, candidates: DataFrame) -> DataFrame:
    """view1, view2, key, n_values: pairs with different rows for a value of a key that is a candidate in both."""
    own = keys.join(candidates.select("view", "key"), ["view", "key"], "left_semi")
    # the row of each view at a value as a number: equal rows have equal numbers, -1 stands for several rows
    held = own.groupBy("schema", "key", "value").agg(F.array_sort(F.collect_list(F.struct("view", "lo", "hi"))).alias("held")).filter(F.size("held") > 1)
    rows = F.array_distinct(F.transform("held", lambda x: x["lo"]))
    pattern = F.transform("held", lambda x: F.struct(x["view"].alias("view"), F.when(x["lo"] == x["hi"], F.array_position(rows, x["lo"])).otherwise(F.lit(-1)).alias("c")))
    patterns = held.select("key", pattern.alias("p")).groupBy("key", "p").agg(F.count("*").alias("n"))
    one = patterns.select("key", "p", "n", F.posexplode("p").alias("i", "x"))
    two = one.select("key", "n", "x", F.explode(F.slice("p", F.col("i") + 2, F.size("p"))).alias("y"))
    clash = two.filter((F.col("x.c") != F.col("y.c")) | (F.col("x.c") == -1))
    return clash.groupBy(F.col("x.view").alias("view1"), F.col("y.view").alias("view2"), "key").agg(F.sum("n").alias("n_values"))


def conflict_values(keys: DataFrame, view1: str, view2: str, key: str) -> DataFrame:
    """The values of a key at which two views differ: value."""
    own = keys.filter(F.col("key") == key)
    side = lambda v, k: own.filter(F.col("view") == v).select("value", F.col("lo").alias(f"lo{k}"), F.col("hi").alias(f"hi{k}"))
    both = side(view1, 1).join(side(view2, 2), "value")
    return both.filter("not (lo1 = hi1 and lo2 = hi2 and lo1 = lo2)").select("value")


def conflict_rows(rows: DataFrame, keys: DataFrame, view1: str, view2: str, key: str) -> DataFrame:
    """The rows of both views at those values: value, view, row."""
    at = F.concat_ws(SEP, *[F.col("cells")[c] for c in key.split("+")])
    own = rows.filter(F.col("view").isin(view1, view2)).withColumn("value", at)
    return own.join(conflict_values(keys, view1, view2, key), "value", "left_semi").select("value", "view", "row")


def complementary(pairs: DataFrame, candidates: DataFrame, conflicts: DataFrame) -> DataFrame:
    """view1, view2, key: pairs that share a row and don't differ at any value of the key."""
    shared = pairs.select("view1", "view2")
    one, two = (candidates.select(F.col("view").alias(f"view{k}"), "key") for k in (1, 2))
    return shared.join(one, "view1").join(two, ["view2", "key"]).join(conflicts, ["view1", "view2", "key"], "left_anti").select("view1", "view2", "key")


def classify(views: Mapping[str, DataFrame], least: float = 0.9, most: int = 2) -> dict[str, DataFrame]:
    """All four relations, and edges(view1, view2, relation, keys, n_values) with one label per pair: compatible and
    contained win; contradictory and complementary (on different keys) may both hold."""
    rows = layout(views)
    pairs = materialize(row_pairs(rows), "view-pairs")
    keys = keyed(rows, views, most)
    cand = materialize(candidate_keys(keys, least), "view-candidates")
    conflicts = materialize(key_conflicts(keys, cand), "view-conflicts")
    same, inside, comp = compatible(pairs), contained(pairs), complementary(pairs, cand, conflicts)
    strong = same.withColumn("relation", F.lit("compatible")).union(inside.select(F.least("container", "inside"), F.greatest("container", "inside"), F.lit("contained")))
    text = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ";")
    con = conflicts.groupBy("view1", "view2").agg(text("key").alias("con_keys"), F.sum("n_values").alias("n_values"))
    com = comp.groupBy("view1", "view2").agg(text("key").alias("com_keys"))
    weak = con.join(com, ["view1", "view2"], "full").join(strong, ["view1", "view2"], "left_anti")
    label = F.when(F.col("con_keys").isNotNull() & F.col("com_keys").isNotNull(), "contradictory/complementary").when(F.col("con_keys").isNotNull(), "contradictory").otherwise("complementary")
    weak = weak.select("view1", "view2", label.alias("relation"), F.concat_ws("|", "con_keys", "com_keys").alias("keys"), F.coalesce("n_values", F.lit(0)).alias("n_values"))
    edges = strong.select("view1", "view2", "relation", F.lit("").alias("keys"), F.lit(0).cast("long").alias("n_values")).unionByName(weak)
    return {"rows": rows, "pairs": pairs, "keys": keys, "candidates": cand, "conflicts": conflicts, "compatible": same, "contained": inside, "complementary": comp, "edges": edges}


def distill(views: Mapping[str, DataFrame], least: float = 0.9, most: int = 2, union: bool = True) -> dict[str, DataFrame]:
    """The views that remain: one of equal ones, no contained ones, and complementary ones without any contradiction
    united in pairs, each used once, in order of name. Relations between views are metadata and decided on the driver."""
    c = classify(views, least, most)
    dropped: set[str] = set()
    for r in sorted((r.view1, r.view2) for r in c["compatible"].collect()):
        if r[0] not in dropped:
            dropped.add(r[1])
    dropped |= {r.inside for r in c["contained"].collect()}
    left = {n: v for n, v in views.items() if n not in dropped}
    if not union:
        return left
    bad = {x for r in c["conflicts"].select("view1", "view2").distinct().collect() for x in (r.view1, r.view2) if r.view1 in left and r.view2 in left}
    used: set[str] = set()
    out = dict(left)
    for a, b in sorted({(r.view1, r.view2) for r in c["complementary"].select("view1", "view2").distinct().collect()}):
        if a in left and b in left and not {a, b} & (used | bad):
            used |= {a, b}
            out[f"{a}+{b}"] = curated(views[a]).unionByName(curated(views[b])).distinct()
            del out[a], out[b]
    return out


# ---------------------------------------------------------------- predicates on a pair


def equivalent(a: DataFrame, b: DataFrame) -> str:
    """"" if equal as bags, else what differs first: schema, size or rows."""
    if sorted(a.columns) != sorted(b.columns):
        return "schema"
    b = b.select(*a.columns)
    if a.count() != b.count():
        return "size"
    return "" if a.exceptAll(b).isEmpty() else "rows"


def key_matches(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """side (left, right, both), n: key values of two views, by a full join on the key."""
    one = curated(a).select(F.col(key).alias("k")).distinct().withColumn("l", F.lit(1))
    two = curated(b).select(F.col(key).alias("k")).distinct().withColumn("r", F.lit(1))
    side = F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("both")
    return one.join(two, "k", "full").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def inconsistent_cells(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """column, n: at how many key values (held once on both sides) a column differs."""
    one, two = curated(a), curated(b)
    rest = [c for c in one.columns if c != key]
    single = lambda v: v.groupBy(key).agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in rest]).filter("n = 1").drop("n")
    both = single(one).alias("a").join(single(two).alias("b"), key)
    counts = both.agg(*[F.count_if(F.col(f"a.{c}") != F.col(f"b.{c}")).alias(c) for c in rest])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in rest])))


def differing_cells(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, column, one, two: the cells to highlight when two views are laid side by side, at key values held once on both."""
    one, two = curated(a), curated(b)
    rest = [c for c in one.columns if c != key and c in two.columns]
    single = lambda v: v.groupBy(key).agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in rest]).filter("n = 1").drop("n")
    both = single(one).alias("a").join(single(two).alias("b"), key)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a.`{c}`").alias("one"), F.col(f"b.`{c}`").alias("two")) for c in rest])
    return both.select(F.col(key).alias("key"), F.inline(pairs)).filter("one <> two")


def repeated_projections(projections: Mapping[str, DataFrame]) -> DataFrame:
    """projection, same_as: those with the rows of one earlier in order of name, so that a join path through them brings
    nothing new. Projections are compared by fingerprints of their rows: one row per projection is shuffled."""
    prints = fingerprints(layout(projections)).groupBy("schema", "n", "total", "mix").agg(F.sort_array(F.collect_list("view")).alias("same"))
    return prints.select(F.explode(F.slice("same", 2, F.size("same"))).alias("projection"), F.col("same")[0].alias("same_as"))
