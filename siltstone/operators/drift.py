"""Which columns changed between two snapshots of a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.sketches import estimate

KEYS = ["source", "column_name"]


def column_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """source, column_name, n_old, n_new, overlap, jaccard of the distinct values; old, new: value indexes. One shuffle
    by value counts both sides, so no pair of values is ever made."""
    side = lambda v, k: v.select(*KEYS, "value", F.lit(k).alias("side"))
    held = side(old, 1).unionByName(side(new, 2)).groupBy(*KEYS, "value").agg(F.bit_or("side").alias("sides"))
    n = held.groupBy(*KEYS).agg(F.count_if(F.col("sides") != 2).alias("n_old"), F.count_if(F.col("sides") != 1).alias("n_new"), F.count_if(F.col("sides") == 3).alias("overlap"))
    return n.withColumn("jaccard", F.round(F.col("overlap") / (F.col("n_old") + F.col("n_new") - F.col("overlap")), 6))


def changed(drift: DataFrame, threshold: float) -> DataFrame:
    return drift.filter(F.col("jaccard") < threshold).select(*KEYS)


def estimated_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """The same from MinHash signatures: source, column_name, estimate."""
    both = old.select(*KEYS, F.col("signature").alias("a")).join(new.select(*KEYS, F.col("signature").alias("b")), KEYS)
    return both.select(*KEYS, estimate(F.col("a"), F.col("b")).alias("estimate"))


def detection_quality(found: DataFrame, truth: DataFrame) -> DataFrame:
    """precision, recall, f1 of changed columns."""
    from siltstone.operators.ontology import precision_recall

    q = precision_recall(found, truth, KEYS)
    total = F.col("precision") + F.col("recall")
    return q.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))
