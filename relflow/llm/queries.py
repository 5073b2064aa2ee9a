"""The registered queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relflow.llm.chat import format_chats
from relflow.llm.decontaminate import contamination, items_digest
from relflow.llm.language_model import pseudo_likelihood
from relflow.llm.neardup import near_duplicates
from relflow.llm.pieces import encode_pieces
from relflow.llm.quality import quality_scores
from relflow.llm.rules import quality_rules
from relflow.llm.secrets import scan_blobs, secret_scan
from relflow.llm.sql import SQL
from relflow.llm.tokencount import token_counts
from relflow.llm.toxicity import toxicity_scores
from relflow.sources.scratch import scratch


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_decontamination(spark: SparkSession, d: str) -> DataFrame:
    out = contamination(table(spark, d, "documents"), table(spark, d, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", items_digest(F.col("items")).alias("items_sha256"), "contaminated")


def op2_toxicity(spark: SparkSession, d: str) -> DataFrame:
    out = toxicity_scores(table(spark, d, "documents"), table(spark, d, "labels"), keep=["doc_id"], spans=False)
    return out.select("doc_id", "held_out", "score", "predicted")


def op3_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality_rules(table(spark, d, "documents"), keep=["doc_id"], with_text=False)


def op4_lm_scoring(spark: SparkSession, d: str) -> DataFrame:
    return pseudo_likelihood(table(spark, d, "documents"), keep=["doc_id"])


def op5_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates(table(spark, d, "documents"))


def op6_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    return encode_pieces(table(spark, d, "documents"), keep=["doc_id"], with_ids=False)


def op7_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    out = quality_scores(table(spark, d, "documents"), table(spark, d, "labels"), keep=["doc_id"])
    return out.select("doc_id", "held_out", "score", "predicted")


def op8_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts(table(spark, d, "documents"), keep=["doc_id"])


def op9_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    docs, ledger = table(spark, d, "documents"), scratch(spark, "ledger")
    # a second pass over the same ledger finds every blob known and scans nothing
    scan_blobs(docs, ledger)
    return secret_scan(docs, ledger=ledger)


def op10_chat_formatting(spark: SparkSession, d: str) -> DataFrame:
    return format_chats(table(spark, d, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_toxicity, op3_quality_rules, op4_lm_scoring, op5_near_duplicates, op6_sentencepiece,
        op7_quality_classifier, op8_token_counts, op9_secret_scan, op10_chat_formatting,
    )
}

__all__ = ["QUERIES", "SQL"]
