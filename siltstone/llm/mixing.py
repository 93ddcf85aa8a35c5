"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

A source with weight w and S words may give at most `epochs` * S words. The mix holds
`share` times all words. Targets are min(epochs * S, level * w) for the one level that
makes them add up: sources are sorted by the level at which each saturates, and the first
prefix of saturated sources whose remaining level lies below the next saturation point is
the fixed point of clamping and resharing. If all saturate, targets are the caps.

Sampling is whole and fractional: every document of a source is repeated floor(rate)
times; the rest of the source's target is filled with whole documents in the order of a
seeded hash, and the document at the boundary gives its first words only. So a source's
taken words equal floor(target), no document exceeds `epochs` repetitions, and reruns
agree. The hash is of id and text, so that repeated or null ids spread over all ranges too. The order needs no sort of a whole source: documents fall into 65,536 equal hash
ranges, prefix sums of range totals say where each range starts, and only the documents
of one range of one source are ordered among themselves.

Defined results: null text has size 0; the null source is a source and sorts last; a
source of size 0 has target 0; an empty table gives an empty result; rows with equal ids
are ordered by size. Only the three named columns are looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.plans.shared import materialize

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """sizes: source, source_size -> source, source_size, target. One row per source goes through one window."""
    # UTF-8 order is code point order, which Spark's binary string order is
    order = Window.orderBy(F.col("source").isNull(), "source")
    k = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (k + 1).cast("int"))
    caps = sizes.withColumn("w", w).withColumn("cap", F.col("source_size").cast("double") * epochs)
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    filled = (
        caps.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("total", F.sum("source_size").over(whole).cast("double") * F.lit(share))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("left"))
        .withColumn("open", F.col("level") * F.col("w") <= F.col("cap"))
        .withColumn("at", F.row_number().over(by))
    )
    first = F.min(F.when(F.col("open"), F.col("at"))).over(whole)
    level = F.max(F.when(F.col("at") == F.col("first"), F.col("level"))).over(whole)
    target = F.when(F.col("first").isNull() | (F.col("at") < F.col("first")), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("w")))
    return filled.withColumn("first", first).withColumn("final", level).select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: int = 17, carry: Sequence[str] = ()) -> DataFrame:
    """id, size, source_size, target, taken for every row; carry: further columns to keep."""
    size = F.when(docs[text_col].isNull(), 0).otherwise(F.regexp_count(docs[text_col], F.lit(WORD))).cast("long")
    rows = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), size.alias("size"), F.md5(F.coalesce(docs[text_col], F.lit(""))).alias("digest"), F.struct(F.lit(0).alias("_"), *[docs[c].alias(f"c{k}") for k, c in enumerate(carry)]).alias("row"))
    rows = rows.withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), "digest")))
    rows = rows.withColumn("s", F.concat(F.col("source").isNull().cast("string"), F.coalesce("source", F.lit("")))).withColumn("fine", F.substring("key", 1, 4))
    # a source's documents by hash range; the hot source is spread over all ranges
    fine = rows.groupBy("s", "fine").agg(F.first("source").alias("source"), F.sum("size").alias("range_size"))
    fine = materialize(fine, "mix-ranges").withColumn("coarse", F.substring("fine", 1, 2))  # read twice; texts are not counted again
    coarse = fine.groupBy("s", "coarse").agg(F.first("source").alias("source"), F.sum("range_size").alias("size"))
    targets = source_targets(coarse.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.floor("target").cast("long") - F.col("whole") * F.col("source_size"))

    def prefix(value: str, by: list[str], order: str):
        return F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    # where each range starts within its source: windows of 256 rows at most
    coarse = coarse.withColumn("coarse_start", prefix("size", ["s"], "coarse")).alias("a").join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("s", "coarse", "coarse_start", "source_size", "target", "whole", "rest")
    plan = fine.withColumn("fine_start", prefix("range_size", ["s", "coarse"], "fine")).join(coarse, ["s", "coarse"]).select("s", "fine", (F.col("coarse_start") + F.col("fine_start")).alias("start"), "source_size", "target", "whole", "rest")
    before = F.col("start") + F.coalesce(F.sum("size").over(Window.partitionBy("s", "fine").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    out = rows.join(plan, ["s", "fine"]).withColumn("before", before).withColumn("taken", F.col("whole") * F.col("size") + extra)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", *[F.col(f"row.c{k}").alias(c) for k, c in enumerate(carry)])


def oracle_sql(weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: int = 17) -> str:
    """DuckDB SQL for mix(documents)."""
    w = "CASE " + " ".join(f"WHEN k = {i} THEN {float(x)}::DOUBLE" for i, x in enumerate(weights)) + " END"
    return rf"""
WITH d AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
c AS (SELECT *, source_size::DOUBLE * {epochs} AS cap,
             {w} AS w
      FROM (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} AS k FROM s)),
f AS (SELECT *, row_number() OVER o AS pos,
        ((sum(source_size) OVER ())::DOUBLE * {share}
          - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level
      FROM c WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
g AS (SELECT *, min(CASE WHEN level * w <= cap THEN pos END) OVER () AS first FROM f),
h AS (SELECT *, max(CASE WHEN pos = first THEN level END) OVER () AS final FROM g),
t AS (SELECT source, source_size,
        CASE WHEN first IS NULL OR pos < first THEN cap ELSE least(cap, final * w) END AS target FROM h),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END::BIGINT AS whole FROM t),
p AS (SELECT d.doc_id, d.size, u.source_size, u.target, u.whole,
        floor(u.target)::BIGINT - u.whole * u.source_size AS rest,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM p"""
