"""Strings of Spark that aren't UTF-8: read as replacement characters by all operators that count them."""

import gc

import pyarrow as pa
import pytest

from relflow.llm.batches import BATCH_BYTES, annotate, bound_batches
from relflow.llm.pieces import PieceCache, encode_pieces
from relflow.llm.rules import quality_rules
from relflow.llm.tokencount import token_counts


@pytest.fixture(scope="module")
def broken(spark):
    return spark.sql("select 1L as doc_id, cast(unhex('6120ff2062c328') as string) as text union all select 2L, 'plain words'")


def test_rules(broken):
    got = {r["doc_id"]: r for r in quality_rules(broken).collect()}
    assert (got[1]["n_words"], got[1]["word_chars"], got[2]["n_words"]) == (3, len("a\ufffdb\ufffd("), 2)


def test_pieces(broken, spark):
    got = {r["doc_id"]: r for r in encode_pieces(broken).collect()}
    same = encode_pieces(spark.createDataFrame([("a \ufffd b\ufffd(",)], "text string")).first()
    assert got[1]["ids"] == same["ids"] and got[1]["decoded"] == same["decoded"]


def test_token_counts(broken, spark):
    got = {r["doc_id"]: r for r in token_counts(broken).collect()}
    same = token_counts(spark.createDataFrame([("a \ufffd b\ufffd(",)], "text string")).first()
    assert got[1]["n_bytes"] == 7 and got[1]["n_tokens"] == same["n_tokens"]


def test_batches_are_bounded_by_bytes(spark):
    """Long texts come to workers in batches of some megabytes, however few rows that is."""
    seen = spark.range(0, 60, 1, 1).selectExpr("id", "repeat('word ', 100000) as text")
    bound_batches(spark)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    rows = [r["n"] for r in seen.mapInArrow(sizes, "n bigint").collect()]
    assert sum(rows) == 60 and max(rows) <= BATCH_BYTES // 500_000 + 1


def test_a_cache_goes_when_another_operator_runs(spark):
    """Workers live on from stage to stage; each would hold the sentencepiece cache meanwhile."""
    docs = spark.range(0, 64, 1, 16).selectExpr("id", "concat('some words ', id) as text")
    assert encode_pieces(docs, keep=["id"]).count() == 64 and encode_pieces(docs).agg({"n_tokens": "sum"}).first()[0] > 0

    def maker():
        return lambda texts: {"n": [sum(isinstance(x, PieceCache) for x in gc.get_objects())] * len(texts)}

    assert annotate(docs, "text", lambda: maker(), "n int").agg({"n": "max"}).first()[0] == 0
