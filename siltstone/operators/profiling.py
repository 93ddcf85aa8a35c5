"""Column profiles: one aggregation over the cells of all tables computes every statistic.

Rows are laid out as cells (column id, number, text) where they are scanned and aggregated
there; what is shuffled is one row per task and column, and the plan has a handful of
aggregates however many columns there are. Every statistic is mergeable. Distinct counts
are HyperLogLog estimates and quantiles percentile_approx; `with_exact_distinct` and
`with_exact_quantiles` put exact ones in their place, which cost a shuffle of the distinct
values but never gather a column in one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import cells
from siltstone.plans.shared import spread
from siltstone.sources.catalog import Attribute, Catalog


@dataclass(frozen=True)
class ProfileConfig:
    """Which analyzers run."""

    cardinality: bool = True
    range: bool = True
    quantiles: bool = True
    semantic: bool = True
    #: 2**log2_k counters per distinct sketch (12: 1.6 % error); quantile ranks are off by 1 / accuracy at most
    log2_k: int = 12
    accuracy: int = 10_000
    abs_quantiles: bool = False


FIELDS = "nid long, db string, source string, column_name string, data_type string, total long, non_null long, non_empty long, unique_values long, min_value double, max_value double, avg_value double, std_dev double, q25 double, median double, q75 double, iqr double, semantic_type string, granularity string"


def _scrub(c: Column) -> Column:
    """NaN and infinities become 0."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def _cells(catalog: Catalog, attributes: list[Attribute], make) -> DataFrame:
    """nid and the fields of make(column, kind) of every cell."""
    parts = []
    for source, table in catalog.tables.items():
        names = [F.col(f"`{a.column_name}`") for a in attributes if a.source == source]
        own = [F.struct(F.lit(a.nid).cast("long").alias("nid"), *make(F.col(f"`{a.column_name}`"), a.kind)) for a in attributes if a.source == source]
        if own:
            parts.append(spread(table.select(*names)).select(F.inline(F.array(*own))))
    return reduce(DataFrame.union, parts)


def _names(catalog: Catalog, attributes: list[Attribute]) -> DataFrame:
    spark = next(iter(catalog.tables.values())).sparkSession
    rows = [(a.nid, catalog.db, a.source, a.column_name, "N" if isinstance(a.kind, cells.NUMERIC) else "T") for a in attributes]
    return spark.createDataFrame(rows, "nid long, db string, source string, column_name string, data_type string")


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def semantic_struct(text: Column, majority: float = 0.5) -> Column:
    """Semantic type and granularity: the first pattern found in more than `majority` of the filled cells of squeezed text."""
    t, hit = F.when(text != "", text), None
    for kind, granularity, pattern in cells.SEMANTIC_PATTERNS:
        value = F.struct(F.lit(kind).alias("type"), F.lit(granularity).alias("granularity"))
        often = F.count_if(t.rlike(pattern)) > majority * F.count(t)
        hit = F.when(often, value) if hit is None else hit.when(often, value)
    return hit.otherwise(F.struct(F.lit("NONE").alias("type"), F.lit(None).cast("string").alias("granularity")))


def profile(catalog: Catalog, config: ProfileConfig = ProfileConfig(), keep=None) -> DataFrame:
    """One row per column of every table (FIELDS); what an analyzer that is off would fill is null. keep(Attribute) chooses columns."""
    chosen = [a for a in catalog.attributes() if keep is None or keep(a)]

    def make(c: Column, kind: T.DataType) -> list[Column]:
        number = isinstance(kind, cells.NUMERIC)
        text = cells.cell_text(c, kind) if config.cardinality or not number else F.lit(None).cast("string")
        return [(c.cast("double") if number else F.lit(None).cast("double")).alias("x"), text.alias("t"), F.lit(number).alias("number"), c.isNotNull().alias("there")]

    x, out = F.col("x"), {}
    out["total"], out["non_null"] = F.count("*"), F.count_if("there")
    out["non_empty"] = F.count_if(F.when(F.col("number"), x != 0).otherwise(cells.normal(F.col("t")).isNotNull()))
    if config.cardinality:
        out["unique_values"] = F.hll_sketch_estimate(F.hll_sketch_agg("t", F.lit(config.log2_k)))
    if config.range:
        out |= {"min_value": _scrub(F.min("x")), "max_value": _scrub(F.max("x")), "avg_value": _scrub(F.avg("x")), "std_dev": _scrub(F.stddev_pop("x"))}
    if config.quantiles:
        out["q"] = F.percentile_approx(F.abs(x) if config.abs_quantiles else x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(config.accuracy))
    every = _cells(catalog, chosen, make).groupBy("nid").agg(*[c.alias(n) for n, c in out.items()]).join(_names(catalog, chosen), "nid")
    if config.quantiles:
        every = every.withColumns({"q25": F.col("q")[0], "median": F.col("q")[1], "q75": F.col("q")[2], "iqr": F.col("q")[2] - F.col("q")[0]})
    if config.semantic:
        every = every.join(semantic_types(catalog).select("nid", "semantic_type", "granularity"), "nid", "left")
    fields = [f.split() for f in FIELDS.split(", ")]
    return every.select(*[(F.col(n) if n in every.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def with_exact_distinct(profiles: DataFrame, values: DataFrame) -> DataFrame:
    """unique_values counted from the value index instead of estimated."""
    n = values.groupBy("nid").agg(F.count("*").alias("n"))
    return profiles.join(n, "nid", "left").withColumn("unique_values", F.coalesce("n", F.lit(0))).drop("n")


def number_counts(catalog: Catalog) -> DataFrame:
    """nid, x, cnt: distinct numbers of the numeric columns."""
    chosen = [a for a in catalog.attributes() if isinstance(a.kind, cells.NUMERIC)]
    every = _cells(catalog, chosen, lambda c, _: [c.cast("double").alias("x")])
    return every.filter(F.col("x").isNotNull() & ~F.isnan("x")).groupBy("nid", "x").agg(F.count("*").alias("cnt"))


def exact_quantiles(counts: DataFrame, shares: dict[str, float]) -> DataFrame:
    """counts: nid, x, cnt -> nid and for each name the least x at or below which that share of the rows lies."""
    from siltstone.operators.prefix import running_sums

    total = counts.groupBy("nid").agg(F.sum("cnt").alias("total"))
    cum = running_sums(counts, ["nid"], "x", ["cnt"]).join(total, "nid")
    return cum.groupBy("nid").agg(*[F.min(F.when(F.col("cum_cnt") >= F.ceil(F.lit(p) * F.col("total")), F.col("x"))).alias(name) for name, p in shares.items()])


def catalog_quantiles(catalog: Catalog, shares: dict[str, float], accuracy: int = 10_000, keep=None) -> DataFrame:
    """nid and, as exact_quantiles gives it, each quantile of every numeric column (null where it has no number), in two
    passes. The first brackets each quantile by sketches of a rank a little lower and a little higher; the second counts the
    numbers between brackets, and value by value those within: some 4 in `accuracy` of a column's rows for each quantile.
    Counts show whether a bracket holds its quantile; columns with one that doesn't are counted whole."""
    spark = next(iter(catalog.tables.values())).sparkSession
    chosen = [a for a in catalog.attributes() if isinstance(a.kind, cells.NUMERIC) and (keep is None or keep(a))]
    order = sorted(shares, key=lambda n: shares[n])
    schema = "nid long" + "".join(f", {n} double" for n in shares)
    if not chosen:
        return spark.createDataFrame([], schema)
    number = lambda c: F.when(~F.isnan(c.cast("double")), c.cast("double"))
    ranks = [F.lit(min(1.0, max(0.0, shares[n] + d / accuracy))) for n in order for d in (-2, 2)]
    first = _cells(catalog, chosen, lambda c, _: [number(c).alias("x")]).groupBy("nid").agg(F.count("x").alias("total"), F.percentile_approx("x", F.array(*ranks), F.lit(accuracy)).alias("b")).collect()  # a row per column
    brackets = {r.nid: list(zip(r.b[::2], r.b[1::2])) for r in first if r.total}

    found = {}
    if brackets:
        ends = [(f"lo{k}", f"hi{k}") for k in range(len(order))]
        known = spark.createDataFrame([(n, *[x for e in b for x in e]) for n, b in brackets.items()], "nid long" + "".join(f", {lo} double, {hi} double" for lo, hi in ends))  # metadata
        own = _cells(catalog, [a for a in chosen if a.nid in brackets], lambda c, _: [c.cast("double").alias("x")]).filter("x is not null and not isnan(x)").join(F.broadcast(known), "nid")
        # a number within a bracket stands for itself, one between brackets for the lower end of the next
        inside = reduce(lambda a, b: a | b, [F.col("x").between(F.col(lo), F.col(hi)) for lo, hi in ends])
        own = own.withColumn("inside", inside)
        at = F.when(F.col("inside"), F.col("x"))
        for lo, _ in ends:
            at = at.when(F.col("x") < F.col(lo), F.col(lo))
        counts = own.select("nid", at.alias("x"), "inside").filter("x is not null").groupBy("nid", "x", "inside").agg(F.count("*").alias("cnt"))
        totals = F.broadcast(spark.createDataFrame([(r.nid, r.total) for r in first], "nid long, total long"))  # metadata
        cum = counts.withColumn("cum", F.sum("cnt").over(Window.partitionBy("nid").orderBy("x", "inside"))).join(totals, "nid")
        least = [F.min(F.when(F.col("cum") >= F.ceil(F.lit(p) * F.col("total")), F.struct("x", "inside"))).alias(n) for n, p in shares.items()]
        found = {r.nid: r for r in cum.groupBy("nid").agg(*least).collect()}  # a row per column
    missed = [n for n in brackets if n not in found or not all(found[n][k] and found[n][k].inside for k in shares)]
    rows = [(r.nid, *(found[r.nid][k].x if r.nid in found else None for k in shares)) for r in first if r.nid not in missed]
    out = spark.createDataFrame(rows, schema)
    return out.unionByName(exact_quantiles(number_counts(catalog).filter(F.col("nid").isin(missed)), shares)) if missed else out


def quantiles_of(catalog: Catalog) -> DataFrame:
    """nid, source, column_name, q25, median, q75, iqr of numeric columns, exact."""
    q = catalog_quantiles(catalog, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return q.join(F.broadcast(_names(catalog, list(catalog.attributes()))), "nid").select("nid", "source", "column_name", "q25", "median", "q75", (F.col("q75") - F.col("q25")).alias("iqr"))


def with_exact_quantiles(profiles: DataFrame, counts: DataFrame) -> DataFrame:
    q = exact_quantiles(counts, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return profiles.drop("q25", "median", "q75", "iqr").join(q, "nid", "left").withColumn("iqr", F.col("q75") - F.col("q25"))


def distinct_sketches(catalog: Catalog, log2_k: int = 12) -> DataFrame:
    """nid, sketch: mergeable HLL sketches, for profiles that grow (streaming/incremental.py)."""
    every = _cells(catalog, list(catalog.attributes()), lambda c, kind: [cells.cell_text(c, kind).alias("t")])
    return every.groupBy("nid").agg(F.hll_sketch_agg("t", F.lit(log2_k)).alias("sketch"))


def _per_text_column(catalog: Catalog, make, every: bool = False, prepare=F.trim) -> DataFrame:
    """make(text column) gives an aggregate struct; one row per text or time column (or every column)."""
    chosen = [a for a in catalog.attributes() if every or isinstance(a.kind, (T.StringType, *cells.TEMPORAL))]
    texts = _cells(catalog, chosen, lambda c, kind: [cells.cell_text(c, kind).alias("t")]).select("nid", prepare(F.col("t")).alias("t"))
    return texts.groupBy("nid").agg(make(F.col("t")).alias("x")).join(_names(catalog, chosen), "nid").select("nid", "source", "column_name", "x.*")


def semantic_types(catalog: Catalog, majority: float = 0.5) -> DataFrame:
    return _per_text_column(catalog, lambda t: semantic_struct(t, majority), prepare=_squeezed).withColumnRenamed("type", "semantic_type")


def infer_types(catalog: Catalog) -> DataFrame:
    """INT, FLOAT or STRING for every column read as text: blanks and nan don't count, one other text makes it STRING."""

    def make(text: Column) -> Column:
        t = F.when(~F.lower(text).isin("", "nan"), text)
        number, whole = F.count_if(t.rlike(cells.NUMBER)), F.count_if(t.rlike(cells.INTEGER))
        kind = F.when((F.count(t) == 0) | (number < F.count(t)), "STRING").when(whole < number, "FLOAT").otherwise("INT")
        return F.struct(kind.alias("inferred"), F.count(t).alias("filled"))

    return _per_text_column(catalog, make, every=True).withColumn("data_type", F.when(F.col("inferred") == "STRING", "T").otherwise("N"))


def cleanliness(catalog: Catalog) -> DataFrame:
    """Per column: total cells, missing ones (null, blank or a word for it), untidy ones (outer or repeated white space), and
    the share of those that are neither; columns of empty tables give no row."""

    def make(text: Column) -> Column:
        total, missing = F.count(F.lit(1)), F.count_if(cells.normal(text).isNull())
        untidy = F.count_if(cells.normal(text).isNotNull() & (text != _squeezed(text)))
        return F.struct(total.alias("total"), missing.alias("missing"), untidy.alias("untidy"), F.round(1 - (missing + untidy) / total, 6).alias("clean"))

    return _per_text_column(catalog, make, every=True, prepare=lambda t: t)


def cast_cells(catalog: Catalog) -> DataFrame:
    """How many cells of each column parse as numbers (commas dropped, others skipped), and their sum."""
    return _per_text_column(catalog, lambda t: F.struct(F.count(cells.number(t)).alias("n_numbers"), F.coalesce(F.sum(cells.number(t)), F.lit(0.0)).alias("sum_numbers")), every=True)


def skeletons(values: DataFrame, keep: int = 1) -> DataFrame:
    """The `keep` commonest structures of each text column: source, column_name, skeleton, n, rank."""
    n = values.groupBy("source", "column_name", cells.skeleton(F.col("value")).alias("skeleton")).agg(F.sum("cnt").alias("n"))
    by = Window.partitionBy("source", "column_name").orderBy(F.desc("n"), "skeleton")
    return n.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= keep)


#: structures (of values in lower case) that have a name
LABELS: list[tuple[str, str]] = [("date and time", "9-9-9 9:9:9"), ("date", "9/9/9"), ("decimal", "9.9"), ("integer", "9"), ("identifier", "a#9"), ("word", "a"), ("words", "a a")]


def label_columns(values: DataFrame, threshold: float = 0.5, labels: list[tuple[str, str]] = LABELS) -> DataFrame:
    """The label whose structure most cells have, if at least `threshold` of them do: source, column_name, label, score."""
    spark = values.sparkSession
    known = spark.createDataFrame([(k, *x) for k, x in enumerate(labels)], "position int, label string, skeleton string")
    every = values.groupBy("source", "column_name", cells.skeleton(F.col("value")).alias("skeleton")).agg(F.sum("cnt").alias("n"))
    total = every.groupBy("source", "column_name").agg(F.sum("n").alias("total"))
    scored = every.join(known, "skeleton").join(total, ["source", "column_name"]).withColumn("score", F.col("n") / F.col("total")).filter(F.col("score") >= threshold)
    by = Window.partitionBy("source", "column_name").orderBy(F.desc("score"), "position")
    return scored.withColumn("r", F.row_number().over(by)).filter("r = 1").select("source", "column_name", "label", "score")


def uniqueness(values: DataFrame) -> DataFrame:
    """distinct / filled cells of each column, and whether it is its table's likeliest key."""
    u = values.groupBy("source", "column_name").agg((F.count("*") / F.sum("cnt")).alias("uniqueness"))
    by = Window.partitionBy("source").orderBy(F.desc("uniqueness"), "column_name")
    return u.withColumn("likely_key", F.row_number().over(by) == 1)


# ---------------------------------------------------------------- the profile index


def profiles_of_table(profiles: DataFrame, source: str, columns: list[str] | None = None) -> DataFrame:
    found = profiles.filter(F.col("source") == source)
    return found.select(*columns) if columns else found


def profiles_by_ids(profiles: DataFrame, nids: list[int]) -> DataFrame:
    return profiles.filter(F.col("nid").isin(nids))


def profiles_like(profiles: DataFrame, attribute: str, pattern: str) -> DataFrame:
    return profiles.filter(F.ilike(F.col(attribute), F.lit(pattern)))


def add_profiles(profiles: DataFrame, more: DataFrame) -> DataFrame:
    """Missing fields become null."""
    return profiles.unionByName(more, allowMissingColumns=True)


def comparable(profiles: DataFrame, least: int = 10) -> DataFrame:
    """Text columns with enough distinct values to be compared by signature."""
    return profiles.filter((F.col("data_type") == "T") & (F.col("unique_values") >= least))


def numeric_signatures(profiles: DataFrame) -> DataFrame:
    return profiles.filter(F.col("data_type") == "N").select("source", "column_name", "median", "iqr", "min_value", "max_value")


def text_signatures(postings: DataFrame) -> DataFrame:
    """Terms that characterise a column: longer than 3, more frequent than 3, without digits."""
    return postings.filter((F.length("term") > 3) & (F.col("tf") > 3) & ~F.col("term").rlike("[0-9]"))
