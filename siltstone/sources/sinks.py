"""Where profiles, postings, views and graphs go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ("parquet", "json", "csv", "noop")


def store(table: DataFrame, path: str | None, fmt: str = "parquet", rows_per_file: int = 0, mode: str = "overwrite") -> None:
    """noop computes and discards; rows_per_file rolls output files."""
    if fmt not in FORMATS:
        raise ValueError(f"{fmt}: one of {FORMATS}")
    writer = table.write.mode(mode).format(fmt).option("maxRecordsPerFile", rows_per_file)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save() if fmt == "noop" else writer.save(path)


def store_view(view: DataFrame, path: str, plan: dict) -> None:
    """The view as CSV below path/data and how it was made as one JSON row below path/plan."""
    import json

    store(view, f"{path}/data", "csv")
    spark = view.sparkSession
    spark.createDataFrame([(json.dumps(plan, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/plan")


def edge_list(edges: DataFrame, path: str) -> None:
    store(edges.select("src", "dst", "relation", "weight"), path, "csv")


def triples(edges: DataFrame, base: str = "urn:column:") -> DataFrame:
    """N-Triples lines of the relationship graph."""
    name = lambda c: F.concat(F.lit(f"<{base}"), F.url_encode(F.col(c).cast("string")), F.lit(">"))
    return edges.select(F.concat_ws(" ", name("src"), F.concat(F.lit(f"<{base}relation/"), F.lower("relation"), F.lit(">")), name("dst"), F.lit(".")).alias("triple"))


def property_graph(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    """Node and relationship files with the headers that property-graph importers read."""
    store(nodes.select(F.col("nid").alias("nid:ID"), "source", "column_name"), f"{path}/nodes", "csv")
    store(edges.select(F.col("src").alias(":START_ID"), F.col("dst").alias(":END_ID"), F.col("relation").alias(":TYPE"), "weight"), f"{path}/relationships", "csv")
