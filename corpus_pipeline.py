"""A training corpus in five stages: language, exact copies, near copies, benchmark leaks, mixture.

Each stage takes (spark, docs, sf_dir), where docs is its predecessor's output written as
Parquet and read again, and returns a DataFrame; all but the last return the columns of
docs. Nulls in any column, empty texts, repeated rows, empty tables and extra columns pass
through as the stages' operators define.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, exact_dedup, langid, mixing, similar
from siltstone.plans.shared import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that no learned language explains better than a model of no language; those without a letter too."""
    return langid.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash and vantage-point trees at the radius of a Jaccard similarity of 0.8 on five-word shingles; op7's query keeps its own contract."""
    return similar.drop_similar(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents of which words are taken, with size, source_size, target and taken."""
    carry = [c for c in docs.columns if c != "doc_id"]
    added = {c: f"mix_{c}" if c in carry else c for c in ("size", "source_size", "target", "taken")}
    out = mixing.mix(docs, carry=carry)
    names = ["doc_id", *added.values(), *carry]
    return out.toDF(*names).filter(F.col(added["taken"]) > 0).select("doc_id", *carry, *added.values())


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]

#: the stages' models and fingerprints have no SQL form; tests/llm/test_pipeline.py holds a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
