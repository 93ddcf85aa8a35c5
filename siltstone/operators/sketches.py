"""MinHash signatures of columns, banding, and one-permutation hashing.

Hashes are reduced to 31 bits, so a * h + b stays below 2**63 and no expression overflows.
Permutations are drawn from a seed and applied where the words are; only minima are
shuffled, as one row per task and column.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import cells
from siltstone.operators.values import co_occurrence

PRIME = 2**31 - 1


def permutations(k: int, seed: int = 1) -> list[tuple[int, int]]:
    r = random.Random(seed)
    return [(r.randrange(1, PRIME), r.randrange(PRIME)) for _ in range(k)]


def words_of(values: DataFrame) -> DataFrame:
    return values.select("source", "column_name", F.explode(cells.terms(F.col("value"))).alias("word")).distinct()


def signatures(values: DataFrame, k: int = 128, seed: int = 1) -> DataFrame:
    """source, column_name, signature array<long> of length k over the column's words: k minima of one pass, of which
    each task shuffles one row per column."""
    words = values.select("source", "column_name", F.explode(cells.terms(F.col("value"))).alias("word"))
    hashed = words.select("source", "column_name", F.pmod(F.xxhash64("word"), F.lit(PRIME)).alias("h"))
    least = [F.min(F.pmod(F.lit(a).cast("long") * F.col("h") + F.lit(b), F.lit(PRIME))).alias(f"m{i}") for i, (a, b) in enumerate(permutations(k, seed))]
    return hashed.groupBy("source", "column_name").agg(*least).select("source", "column_name", F.array(*[F.col(f"m{i}") for i in range(k)]).alias("signature"))


def one_permutation(values: DataFrame, buckets: int = 512) -> DataFrame:
    """The same with one permutation: the least hash of each bucket, empty buckets filled from the next one (rotation)."""
    h = F.pmod(F.xxhash64("word"), F.lit(PRIME))
    least = words_of(values).select("source", "column_name", F.pmod(h, F.lit(buckets)).cast("int").alias("i"), h.alias("h")).groupBy("source", "column_name", "i").agg(F.min("h").alias("v"))
    own = least.groupBy("source", "column_name").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"))
    keys = F.array_sort(F.map_keys("m"))
    at = lambda i: F.coalesce(F.get(F.filter(keys, lambda k: k >= i), F.lit(0)), F.get(keys, F.lit(0)))
    return own.select("source", "column_name", F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.element_at("m", at(i))).alias("signature"))


def estimate(a, b):
    """Share of equal positions of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)


def band_candidates(sig: DataFrame, bands: int, rows: int) -> DataFrame:
    """Pairs of columns of different tables that agree on a whole band, each once. Sets of columns that meet
    in a bucket are expanded once however many bands they share."""
    key = F.concat_ws("\x1f", "source", "column_name")
    part = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda j: F.struct(j.alias("band"), F.xxhash64(F.slice("signature", j * rows + 1, rows)).alias("h")))
    index = sig.select(key.alias("column"), F.explode(part).alias("x")).select("column", "x.band", "x.h")
    pairs = co_occurrence(index, ["band", "h"], "column")
    side = lambda c, k: F.split(c, "\x1f")[k]
    out = pairs.select(side("a", 0).alias("source1"), side("a", 1).alias("column_name1"), side("b", 0).alias("source2"), side("b", 1).alias("column_name2"), F.col("overlap").alias("bands"))
    return out.filter("source1 <> source2")


def similar_columns(sig: DataFrame, candidates: DataFrame, least: float) -> DataFrame:
    """candidates whose signatures agree in `least` of their positions or more, with that estimate."""
    one = sig.select(F.col("source").alias("source1"), F.col("column_name").alias("column_name1"), F.col("signature").alias("s1"))
    two = sig.select(F.col("source").alias("source2"), F.col("column_name").alias("column_name2"), F.col("signature").alias("s2"))
    both = candidates.join(one, ["source1", "column_name1"]).join(two, ["source2", "column_name2"])
    return both.withColumn("estimate", F.round(estimate(F.col("s1"), F.col("s2")), 6)).drop("s1", "s2").filter(F.col("estimate") >= least)


def banding(threshold: float, k: int) -> tuple[int, int]:
    """(bands, rows) with the least sum of the areas of false positives and negatives of 1 - (1 - s**r)**b."""
    best = None
    grid = [i / 200 for i in range(201)]
    for r in range(1, k + 1):
        for b in {k // r} | set(range(1, min(k // r, 64) + 1)):
            p = [1 - (1 - s**r) ** b for s in grid]
            cost = sum(x for s, x in zip(grid, p) if s < threshold) + sum(1 - x for s, x in zip(grid, p) if s >= threshold)
            if best is None or cost < best[0]:
                best = cost, b, r
    return best[1], best[2]
