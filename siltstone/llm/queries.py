"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import chat, decontaminate, exact_dedup, html_text, langid, mixing, pii, secret_scan, simhash, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.label_copies(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_probe(_table(spark, sf_dir, "conversations"))
    return chat.format_conversations(rows, full=False).drop("n_tokens", "n_loss_tokens")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incremental scan, beginning with a ledger of its own, so that a run does not depend on earlier ones."""
    return secret_scan.scan_versions(_table(spark, sf_dir, "documents"), secret_scan.new_ledger(spark))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_url_filter": op2_url_filter,
        "op3_mixing": op3_mixing,
        "op4_html_text": op4_html_text,
        "op5_decontaminate": op5_decontaminate,
        "op6_pii": op6_pii,
        "op7_simhash": op7_simhash,
        "op8_chat": op8_chat,
        "op9_langid": op9_langid,
        "op10_secret_scan": op10_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.ORACLE_SQL,
        "op3_mixing": mixing.oracle_sql(),
        "op8_chat": chat.ORACLE_SQL,
        "op10_secret_scan": secret_scan.oracle_sql(),
    }
