"""Annotations on columns, comments on annotations, and searches over them. Tables only grow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WARNING, INSIGHT, QUESTION = "WARNING", "INSIGHT", "QUESTION"
ANNOTATIONS = "id string, author string, text string, kind string, source_node string, target_node string, relation string, tags array<string>"
COMMENTS = "id string, annotation_id string, author string, text string"
#: relations and what they are called from the target's side
INVERSE = {"MEANS_SAME": "MEANS_SAME", "MEANS_DIFF": "MEANS_DIFF", "SUBCLASS": "SUPERCLASS", "SUPERCLASS": "SUBCLASS", "MEMBER": "CONTAINER", "CONTAINER": "MEMBER"}


def empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], ANNOTATIONS), spark.createDataFrame([], COMMENTS)


def annotate(notes: DataFrame, rows: Sequence[tuple]) -> DataFrame:
    """rows: (author, text, kind, source node, target node or None, relation or None, tags); the id is a hash of these."""
    for r in rows:
        if r[2] not in (WARNING, INSIGHT, QUESTION):
            raise ValueError(r[2])
        if (r[4] is None) != (r[5] is None) or (r[5] is not None and r[5] not in INVERSE):
            raise ValueError(f"relation {r[5]} with target {r[4]}")
    new = notes.sparkSession.createDataFrame([tuple(r) for r in rows], "author string, text string, kind string, source_node string, target_node string, relation string, tags array<string>")
    key = F.md5(F.concat_ws("\x1f", "author", "text", "kind", "source_node", F.coalesce("target_node", F.lit("")), F.coalesce("relation", F.lit(""))))
    return notes.unionByName(new.withColumn("id", key))


def comment(comments: DataFrame, rows: Sequence[tuple[str, str, str]]) -> DataFrame:
    """rows: (annotation id, author, text)."""
    new = comments.sparkSession.createDataFrame(list(rows), "annotation_id string, author string, text string")
    return comments.unionByName(new.withColumn("id", F.md5(F.concat_ws("\x1f", "annotation_id", "author", "text"))))


def add_tags(notes: DataFrame, note_id: str, tags: Sequence[str]) -> DataFrame:
    more = F.array_union("tags", F.array(*[F.lit(t) for t in tags]))
    return notes.withColumn("tags", F.when(F.col("id") == note_id, more).otherwise(F.col("tags")))


def of_node(notes: DataFrame, node: str) -> DataFrame:
    return notes.filter((F.col("source_node") == node) | (F.col("target_node") == node))


def related(notes: DataFrame, node: str, relation: str) -> DataFrame:
    """node, id: what the node has this relation to, from either side."""
    out = notes.filter((F.col("source_node") == node) & (F.col("relation") == relation)).select(F.col("target_node").alias("node"), "id")
    back = notes.filter((F.col("target_node") == node) & (F.col("relation") == INVERSE[relation])).select(F.col("source_node").alias("node"), "id")
    return out.unionByName(back).distinct()


def search_notes(notes: DataFrame, comments: DataFrame, keyword: str) -> DataFrame:
    """id of annotations whose text, tags or comments have the keyword."""
    k = keyword.lower()
    own = notes.filter(F.lower("text").contains(k) | F.exists("tags", lambda t: F.lower(t).contains(k))).select("id")
    return own.union(comments.filter(F.lower("text").contains(k)).select("annotation_id")).distinct()


def relation_edges(notes: DataFrame) -> DataFrame:
    """src, dst, relation, weight of annotations that relate two nodes, both ways under their names."""
    inverse = F.create_map(*[F.lit(x) for kv in INVERSE.items() for x in kv])
    own = notes.filter("relation is not null").select(F.col("source_node").alias("src"), F.col("target_node").alias("dst"), "relation", F.lit(1.0).alias("weight"))
    return own.union(own.select("dst", "src", inverse[F.col("relation")], "weight")).distinct()
