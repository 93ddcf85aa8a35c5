"""Profiles of a table that grows: each micro-batch adds mergeable partial profiles.

State is a folder of Parquet, one sub-folder per batch id, so a batch that is repeated after
a failure overwrites its own part; the profile is the merge of all parts, and `compact`
folds them into one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from siltstone.functions import cells
from siltstone.sources.catalog import column_id

PARTS = "nid long, source string, column_name string, total long, non_null long, min_value double, max_value double, sum_value double, sum_squares double, sketch binary"


def partial(db: str, source: str, table: DataFrame, log2_k: int = 12) -> DataFrame:
    """One row per column with what can be merged."""
    parts = []
    for f in table.schema.fields:
        if not isinstance(f.dataType, cells.SCALAR):
            continue
        c = F.col(f"`{f.name}`")
        x = c.cast("double") if isinstance(f.dataType, cells.NUMERIC) else F.lit(None).cast("double")
        parts.append(F.struct(F.lit(column_id(db, source, f.name)).cast("long").alias("nid"), F.lit(source).alias("source"), F.lit(f.name).alias("column_name"), F.count("*").alias("total"), F.count(c).alias("non_null"), F.min(x).alias("min_value"), F.max(x).alias("max_value"), F.sum(x).alias("sum_value"), F.sum(x * x).alias("sum_squares"), F.hll_sketch_agg(cells.cell_text(c, f.dataType), F.lit(log2_k)).alias("sketch")))
    row = table.agg(*[p.alias(f"p{k}") for k, p in enumerate(parts)])
    return row.select(F.inline(F.array(*[f"p{k}" for k in range(len(parts))])))


def merge(parts: DataFrame) -> DataFrame:
    keys = ["nid", "source", "column_name"]
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("total", "non_null")], F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), F.sum("sum_value").alias("sum_value"), F.sum("sum_squares").alias("sum_squares"), F.hll_union_agg("sketch").alias("sketch"))


def finish(merged: DataFrame) -> DataFrame:
    """Mean, deviation and distinct estimate from merged parts."""
    mean = F.col("sum_value") / F.col("non_null")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("sum_squares") / F.col("non_null") - mean * mean))
    return merged.select("nid", "source", "column_name", "total", "non_null", "min_value", "max_value", F.when(F.col("non_null") > 0, mean).alias("avg_value"), F.when(F.col("non_null") > 0, spread).alias("std_dev"), F.hll_sketch_estimate("sketch").alias("unique_values"))


def profile_stream(stream: DataFrame, db: str, source: str, state: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keeps the profile of everything that arrives on the stream."""

    def add(batch: DataFrame, batch_id: int) -> None:
        partial(db, source, batch).write.mode("overwrite").parquet(f"{state}/source={source}/batch={batch_id}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, state: str) -> DataFrame:
    schema = T._parse_datatype_string(PARTS)
    parts = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(state)
    return finish(merge(parts))


def compact(spark: SparkSession, state: str, into: str) -> None:
    merge(spark.read.schema(T._parse_datatype_string(PARTS)).option("recursiveFileLookup", "true").parquet(state)).write.mode("overwrite").parquet(f"{into}/compacted")


def merge_signatures(parts: list[DataFrame]) -> DataFrame:
    """MinHash signatures of a union are the least of each position: source, column_name, signature."""
    every = reduce(DataFrame.unionByName, parts).select("source", "column_name", F.posexplode("signature").alias("i", "v"))
    least = every.groupBy("source", "column_name", "i").agg(F.min("v").alias("v"))
    return least.groupBy("source", "column_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("signature"))
