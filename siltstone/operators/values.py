"""The value index of a catalog, and what columns have in common.

values(nid, source, column_name, value, cnt) holds every distinct normalised cell of every
column. Which columns share values is computed by patterns: the columns that hold a value
are gathered (at most as many as there are columns), equal sets of columns are counted, and
only distinct sets are expanded into pairs, weighted by their number of values. So pairs
never grow with the data, however popular a value is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import cells
from siltstone.plans.shared import materialize, spread
from siltstone.sources.catalog import Catalog


def column_values(catalog: Catalog, keep=None) -> DataFrame:
    """keep(Attribute) -> bool chooses columns; all scalar ones by default. Cells are counted in coded form (numbers and
    times as whole numbers), and only distinct ones become text. Names are metadata and go to all tasks."""
    chosen = [a for a in catalog.attributes() if keep is None or keep(a)]
    parts = []
    for source, table in catalog.tables.items():
        own = [a for a in chosen if a.source == source]
        if own:
            pairs = F.array(*[F.struct(F.lit(a.nid).cast("long").alias("nid"), *cells.raw(F.col(f"`{a.column_name}`"), a.kind)) for a in own])
            parts.append(spread(table.select(*[F.col(f"`{a.column_name}`") for a in own])).select(F.inline(pairs)))
    spark = next(iter(catalog.tables.values())).sparkSession
    names = spark.createDataFrame([(a.nid, a.source, a.column_name, cells.code_kind(a.kind)) for a in chosen], "nid long, source string, column_name string, how int")
    cells_of = reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], "nid long, i long, x double, s string")
    i, text = cells.coded(F.col("i"), F.col("x"), F.col("s"))
    own = cells_of.select("nid", i.alias("i"), text.alias("s")).filter(F.col("i").isNotNull() | F.col("s").isNotNull())
    every = own.groupBy("nid", "i", "s").agg(F.count("*").alias("cnt"))  # one shuffle for all tables
    value = cells.decoded(F.col("i"), F.col("s"), F.col("how"))
    return every.join(F.broadcast(names), "nid").select("nid", "source", "column_name", value.alias("value"), "cnt")


def co_occurrence(index: DataFrame, item: list[str], owner: str) -> DataFrame:
    """index: distinct (item, owner) -> a, b (a < b), overlap: the items that both owners hold."""
    sets = index.groupBy(*item).agg(F.array_sort(F.collect_list(owner)).alias("owners")).filter(F.size("owners") > 1)
    patterns = sets.groupBy("owners").agg(F.count("*").alias("n"))
    one = patterns.select(F.posexplode("owners").alias("i", "a"), "owners", "n")
    pairs = one.select("a", "n", F.explode(F.slice("owners", F.col("i") + 2, F.size("owners"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("overlap"))


#: rows that one task holds in memory at a time
PART = 1 << 20


def shared_values(values: DataFrame, nids: list[int], rows: int) -> DataFrame:
    """a, b (a < b), overlap: the number of values that both columns hold. Like co_occurrence, with the columns of a value as
    bits of whole numbers (nids are all columns): neither lists nor sorts. Values are dealt to parts of PART rows."""
    words = [nids[k : k + 63] for k in range(0, len(nids), 63)]
    bits = values.sparkSession.createDataFrame([(n, *[1 << w.index(n) if n in w else 0 for w in words]) for n in nids], "nid long" + "".join(f", w{k} long" for k in range(len(words))))
    names = [f"w{k}" for k in range(len(words))]
    if not names:
        return bits.select(F.col("nid").alias("a"), F.col("nid").alias("b"), F.lit(0).cast("long").alias("overlap"))
    dealt = values.select("nid", "value").repartition(max(1, -(-rows // PART)), "value").join(F.broadcast(bits), "nid")
    sets = dealt.groupBy("value").agg(*[F.bit_or(w).alias(w) for w in names])
    several = sum((F.bit_count(w) for w in names), F.lit(0)) > 1
    patterns = sets.filter(several).groupBy(*names).agg(F.count("*").alias("n"))

    def of_word(name: str, members: list[int]) -> Column:
        known = F.array(*[F.struct(F.lit(n).cast("long").alias("nid"), F.lit(1 << k).cast("long").alias("bit")) for k, n in enumerate(members)])
        return F.transform(F.filter(known, lambda x: x["bit"].bitwiseAND(F.col(name)) != 0), lambda x: x["nid"])

    owners = patterns.select(F.concat(*[of_word(c, w) for c, w in zip(names, words)]).alias("owners"), "n")
    one = owners.select(F.posexplode("owners").alias("i", "a"), "owners", "n")
    pairs = one.select("a", "n", F.explode(F.slice("owners", F.col("i") + 2, F.size("owners"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("overlap"))


def similarities(values: DataFrame, written: bool = False, sizes_of: DataFrame | None = None) -> DataFrame:
    """One row per pair of columns of different tables that share a value: names, sizes, overlap, jaccard, containment.
    The index is written to the shared folder (unless it is `written` already), as sizes and overlaps both read it.
    sizes_of: the whole index, where values are a part of it."""
    values = values if written else materialize(values, "values")
    sizes = (values if sizes_of is None else sizes_of).groupBy("nid", "source", "column_name").agg(F.count("*").alias("n"), F.sum("cnt").alias("filled"), F.max("cnt").alias("most"))
    sizes = materialize(sizes, "sizes")  # a row per column
    side = lambda s: sizes.select(*[F.col(c).alias(f"{c}{s}") for c in sizes.columns])
    known = {r.nid: r.n for r in sizes.select("nid", "n").collect()}  # metadata
    pairs = shared_values(values, sorted(known), sum(known.values()))
    both = pairs.join(F.broadcast(side("1")), F.col("a") == F.col("nid1")).join(F.broadcast(side("2")), F.col("b") == F.col("nid2")).filter("source1 <> source2")
    # the side that sorts first is side 1
    swap = F.struct("source1", "column_name1") > F.struct("source2", "column_name2")
    pick = lambda c: [F.when(swap, F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(f"{c}1"), F.when(swap, F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(f"{c}2")]
    both = both.select("overlap", *[x for c in sizes.columns for x in pick(c)])
    return both.withColumns({"jaccard": jaccard(), "containment": F.greatest(F.col("overlap") / F.col("n1"), F.col("overlap") / F.col("n2"))})


def jaccard() -> Column:
    return F.col("overlap") / (F.col("n1") + F.col("n2") - F.col("overlap"))
