"""The corpus pipeline: each stage works on all that the one before kept, written and read again.

ORACLE_SQL is None: the classifier, the similarity join and the tokenizer are
beyond SQL.  tests/llm/test_pipeline.py holds the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relflow.llm.decontaminate import contamination
from relflow.llm.neardup import near_duplicates
from relflow.llm.pieces import encode_pieces
from relflow.llm.quality import quality_scores
from relflow.llm.secrets import redact
from relflow.sources.scratch import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality_scores(docs, labels, score="__score", predicted="__predicted", held=None)
    return scored.where("__predicted = 1").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id; rows without an id stay.

    Rows are told apart by id and text, so unlike texts that share an id all stay.
    """
    found = near_duplicates(docs, key="__key", group="__group").where(F.col("kept") & F.col("doc_id").isNotNull())
    # rows without words have no group and are alike only if their texts are equal
    alone = F.when(F.col("__group").isNull(), F.col("__key"))
    least = found.groupBy("doc_id", "__group", alone.alias("__alone")).agg(F.min("__key").alias("__key")).select("doc_id", "__key")
    known = docs.where("doc_id is not null").withColumn("__key", F.xxhash64(F.col("text").cast("string")))
    stay = known.join(least, ["doc_id", "__key"], "left_semi").dropDuplicates(["doc_id", "__key"])
    return docs.where("doc_id is null").unionByName(stay.select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of any benchmark item; a single one is enough for a document to go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    # columns by number, so that none has the name of a result
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    found = contamination(numbered, benchmark, text=f"c{docs.columns.index('text')}").where("n_hit = 0")
    return found.select(*numbered.columns).toDF(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced; n_chars follows the text."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's text, and the digests of ids and decoded text."""
    return encode_pieces(docs, keep=["doc_id"]).drop("decoded")


STAGES = [("quality classifier", quality), ("near-duplicates", near_dedup), ("decontamination", decontaminate), ("secrets", secrets), ("sentencepiece", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs


ORACLE_SQL = None
