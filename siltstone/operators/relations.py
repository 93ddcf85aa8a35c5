"""Edges between columns: similar content, containment, inclusion, keys, names, numeric overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators import textsearch
from siltstone.operators.prefix import running_sums
from siltstone.plans.shared import materialize

CONTENT_SIM, SCHEMA_SIM, INCLUSION, PKFK, COMMON_NAME, NUMERIC_OVERLAP = "CONTENT_SIM", "SCHEMA_SIM", "INCLUSION_DEPENDENCY", "PKFK", "COMMON_NAME", "NUMERIC_OVERLAP"
PAIR = ["source1", "column_name1", "source2", "column_name2"]


def content_similar(pairs: DataFrame, least: float = 0.7, least_distinct: int = 1) -> DataFrame:
    """pairs: values.similarities."""
    return pairs.filter((F.col("jaccard") >= least) & (F.col("n1") >= least_distinct) & (F.col("n2") >= least_distinct))


def contained(pairs: DataFrame, least: float = 0.7) -> DataFrame:
    return pairs.filter(F.col("containment") >= least)


def join_cardinality(pairs: DataFrame) -> DataFrame:
    one = lambda c: F.when(F.col(c) == 1, "1").otherwise("N")
    return pairs.withColumn("join_card", F.concat_ws("-", one("most1"), one("most2")))


def _directed(pairs: DataFrame) -> DataFrame:
    """Each pair both ways, so that side 1 can be asked for something."""
    flip = {**{c: (c[:-1] + ("2" if c[-1] == "1" else "1")) for c in pairs.columns if c[-1] in "12"}}
    back = pairs.select(*[F.col(flip.get(c, c)).alias(c) for c in pairs.columns])
    return pairs.unionByName(back)


def inclusions(pairs: DataFrame) -> DataFrame:
    """Side 1's values all occur in side 2."""
    return _directed(pairs).filter(F.col("overlap") == F.col("n1"))


def keys(pairs: DataFrame, least_uniqueness: float = 0.5, least_jaccard: float = 0.7, numeric: Column | None = None) -> DataFrame:
    """Foreign key (side 1) to primary key (side 2): values of side 1 included in side 2 (or, where `numeric`
    is false of the pair, similar content), and side 2 nearly unique; weight: the larger uniqueness."""
    both = _directed(pairs).withColumns({"u1": F.col("n1") / F.col("filled1"), "u2": F.col("n2") / F.col("filled2")})
    included = F.col("overlap") == F.col("n1")
    fits = included if numeric is None else F.when(numeric, included).otherwise(F.col("jaccard") >= least_jaccard)
    return both.filter(fits & (F.col("u2") > least_uniqueness)).withColumn("weight", F.greatest("u1", "u2"))


def common_names(names: DataFrame, pattern: str) -> DataFrame:
    """names: source, column_name. All pairs of columns whose name fits the pattern, each once."""
    own = names.filter(F.ilike(F.col("column_name"), F.lit(pattern))).select("source", "column_name").distinct()
    two = own.select(F.col("source").alias("source2"), F.col("column_name").alias("column_name2"))
    one = own.select(F.col("source").alias("source1"), F.col("column_name").alias("column_name1"))
    return one.join(two, F.struct("source1", "column_name1") < F.struct("source2", "column_name2"))


def schema_similar(values: DataFrame, least: float = 0.3) -> DataFrame:
    return textsearch.cosine_pairs(textsearch.tfidf(textsearch.name_postings(values), ["source", "column_name"]), ["source", "column_name"], least).filter("source1 <> source2")


def text_similar(values: DataFrame, least: float = 0.3) -> DataFrame:
    """Cosine of the TF-IDF vectors of the columns' words."""
    return textsearch.cosine_pairs(textsearch.tfidf(textsearch.postings(values), ["source", "column_name"]), ["source", "column_name"], least).filter("source1 <> source2")


def entity_similar(entities: DataFrame, least: float = 0.3) -> DataFrame:
    """entities: source, column_name, term, tf, from a recogniser of the caller's."""
    return textsearch.cosine_pairs(textsearch.tfidf(entities, ["source", "column_name"]), ["source", "column_name"], least)


def numeric_overlaps(profiles: DataFrame, least: float = 0.85) -> DataFrame:
    """Columns whose interval [median - iqr, median + iqr] covers `least` of the other's. An interval join on a
    grid: every interval is entered in the cells of its own binary scale, and pairs meet in the coarser one's cells."""
    own = profiles.filter("iqr > 0").select("source", "column_name", (F.col("median") - F.col("iqr")).alias("lo"), (F.col("median") + F.col("iqr")).alias("hi"))
    own = materialize(own.withColumn("scale", F.ceil(F.log2(F.col("hi") - F.col("lo"))).cast("int")), "intervals")
    scales = own.select(F.col("scale").alias("level")).distinct()
    # an interval covers two cells of its own scale at most, and at most two of any coarser one
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    grid = own.join(scales, F.col("level") >= F.col("scale")).withColumn("cell", F.explode(F.sequence(at("lo"), at("hi"))))
    wide = grid.filter("level = scale").select(*[F.col(c).alias(f"{c}1") for c in ("source", "column_name", "lo", "hi")], "level", "cell")
    all_ = grid.select(*[F.col(c).alias(f"{c}2") for c in ("source", "column_name", "lo", "hi", "scale")], "level", "cell")
    pairs = wide.join(all_, ["level", "cell"]).filter("source1 <> source2").select("source1", "column_name1", "lo1", "hi1", "source2", "column_name2", "lo2", "hi2").distinct()
    flip = pairs.select(*[F.col(c[:-1] + ("2" if c[-1] == "1" else "1")).alias(c) for c in pairs.columns])
    both = pairs.union(flip).distinct()
    l, r, a, b = (F.col(c) for c in ("lo1", "hi1", "lo2", "hi2"))
    width = r - l
    overlap = F.when((a >= l) & (b <= r), (b - a) / width).when((a >= l) & (a <= r), (r - a) / width).when((b >= l) & (b <= r), (b - l) / width).otherwise(0.0)
    return both.withColumn("overlap", F.round(overlap, 6)).filter(F.col("overlap") >= least).select(*PAIR, "overlap")


def ks_statistics(values: DataFrame, pairs: list[tuple[tuple[str, str], tuple[str, str]]], ranges: int = 64) -> DataFrame:
    """Largest distance between the distribution functions of each pair of numeric columns."""
    spark = values.sparkSession
    rows = [(k, s, *c) for k, p in enumerate(pairs) for s, c in enumerate(p)]
    sides = spark.createDataFrame(rows, "pair int, side int, source string, column_name string")
    asked = sorted({c for p in pairs for c in p})
    mine = F.lit(False)
    for source, column in asked:
        mine = mine | ((F.col("source") == source) & (F.col("column_name") == column))
    x = values.filter(mine).select("source", "column_name", F.col("value").try_cast("double").alias("x"), "cnt").filter("x is not null")
    own = x.join(F.broadcast(sides), ["source", "column_name"]).groupBy("pair", "x").agg(F.sum(F.when(F.col("side") == 0, F.col("cnt")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("side") == 1, F.col("cnt")).otherwise(0)).alias("n2"))
    own = materialize(own, "numbers")
    cum = running_sums(own, ["pair"], "x", ["n1", "n2"], ranges)
    total = own.groupBy("pair").agg(F.sum("n1").alias("t1"), F.sum("n2").alias("t2"))
    d = cum.join(F.broadcast(total), "pair").groupBy("pair").agg(F.max(F.abs(F.col("cum_n1") / F.col("t1") - F.col("cum_n2") / F.col("t2"))).alias("ks"))
    names = sides.filter("side = 0").select("pair", F.col("source").alias("source1"), F.col("column_name").alias("column_name1")).join(sides.filter("side = 1").select("pair", F.col("source").alias("source2"), F.col("column_name").alias("column_name2")), "pair")
    return d.join(names, "pair").select(*PAIR, F.round("ks", 6).alias("ks"))


def gap_clusters(points: DataFrame, x: str, eps: float, least: int = 2) -> DataFrame:
    """DBSCAN in one dimension over column statistics: neighbours at most eps apart chain into clusters; clusters
    of fewer than `least` points are noise (cluster -1). points holds one row per column, so one window orders it."""
    order = Window.orderBy(x, *[c for c in points.columns if c != x])
    step = F.when(F.col(x) - F.lag(x).over(order) <= eps, 0).otherwise(1)
    chained = points.withColumn("_new", step).withColumn("_c", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count("*").over(Window.partitionBy("_c"))
    return chained.withColumn("cluster", F.when(size >= least, F.col("_c")).otherwise(F.lit(-1))).drop("_new", "_c")


def dense_clusters(points: DataFrame, key: str, dims: list[str], eps: float, least: int = 2) -> DataFrame:
    """DBSCAN in several dimensions: a grid of width eps pairs neighbours, core points that touch are components,
    and a border point joins the least core component it touches: key, cluster (its least core key; null: noise)."""
    from itertools import product

    from siltstone.operators.components import connected_components

    cell = [F.floor(F.col(d) / eps).cast("long") for d in dims]
    points = materialize(points.select(key, *dims), "points")
    own = points.select(F.col(key).alias("k"), *[F.col(d).alias(f"d{i}") for i, d in enumerate(dims)], *[c.alias(f"g{i}") for i, c in enumerate(cell)])
    shifts = F.array(*[F.struct(*[F.lit(s).alias(f"s{i}") for i, s in enumerate(x)]) for x in product((-1, 0, 1), repeat=len(dims))])
    near = own.withColumn("s", F.explode(shifts)).select(F.col("k").alias("k2"), *[F.col(f"d{i}").alias(f"e{i}") for i in range(len(dims))], *[(F.col(f"g{i}") + F.col(f"s.s{i}")).alias(f"g{i}") for i in range(len(dims))])
    distance = sum(((F.col(f"d{i}") - F.col(f"e{i}")) ** 2 for i in range(len(dims))), F.lit(0.0))
    pairs = own.join(near, [f"g{i}" for i in range(len(dims))]).filter(distance <= eps * eps).select("k", "k2")
    pairs = materialize(pairs, "point-pairs")
    core = pairs.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("k")
    touching = pairs.join(core, "k").join(core.withColumnRenamed("k", "k2"), "k2")
    comp = connected_components(touching.filter("k < k2"), "k", "k2")
    labels = core.join(comp, core["k"] == comp["node"], "left").select("k", F.coalesce("component", "k").alias("c"))
    border = pairs.join(labels.withColumnRenamed("k", "k2"), "k2").groupBy("k").agg(F.min("c").alias("c"))
    out = points.select(F.col(key).alias("k")).join(labels.withColumnRenamed("c", "own"), "k", "left").join(border, "k", "left")
    return out.select(F.col("k").alias(key), F.coalesce("own", "c").alias("cluster"))


def as_edges(pairs: DataFrame, relation: str, weight: str, both_ways: bool = True) -> DataFrame:
    """src, dst ("table.column"), relation, weight, js, jc, join_card."""
    name = lambda k: F.concat_ws(".", f"source{k}", f"column_name{k}")
    opt = lambda c, t: (F.col(c) if c in pairs.columns else F.lit(None)).cast(t)
    rest = [F.lit(relation).alias("relation"), F.col(weight).cast("double").alias("weight"), opt("jaccard", "double").alias("js"), opt("containment", "double").alias("jc"), opt("join_card", "string").alias("join_card")]
    out = pairs.select(name(1).alias("src"), name(2).alias("dst"), *rest)
    return out.union(pairs.select(name(2), name(1), *rest)) if both_ways else out
