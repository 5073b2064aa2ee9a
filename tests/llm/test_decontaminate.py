import hashlib
import re

import pytest

from relflow.llm.decontaminate import contamination
from relflow.llm.queries import op1_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - 7, 1 if w else 0)):
            windows.setdefault(tuple(w[k : k + 8]), set()).add(i)
    lengths = {len(k) for k in windows}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= {i for i in x if i is not None}
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=repr)


DOCS = "doc_id bigint, text string"
ITEMS = "item_id bigint, text string"


def ran(spark, docs, items, **more):
    from pyspark.sql import functions as F

    from relflow.llm.decontaminate import items_digest

    out = contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), keep=["doc_id"], **more)
    out = out.select("doc_id", "n_words", "n_hit", "n_items", items_digest(F.col("items")), "contaminated")
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_real_tables(spark, small):
    import pandas as pd

    items = pd.read_parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = list(zip(small.doc_id.tolist(), small.text.tolist(), strict=True))
    got = sorted((tuple(r) for r in op1_decontamination(spark, "/root/testdata/sf0.001").collect()), key=repr)
    want = brute(docs, list(zip(items.item_id.tolist(), items.text.tolist(), strict=True)))
    assert got == want
    assert any(r[3] for r in want)


ITEM = "The quick brown fox jumps over the lazy dog again and again"
CASES = [
    (1, "x " + ITEM.upper() + " y"), (2, "quick-brown fox, jumps over; the lazy dog!"), (3, "brown fox jumps over the lazy dog"),
    (4, None), (5, ""), (6, "hello world tiny"), (7, "tiny tiny hello"), (8, "a a a a a a a a a a a a"), (None, ITEM + " " + ITEM),
    (9, "été Zürich 42 is a nice warm place to be"), (9, "été Zürich 42 is a nice warm place to be"), (10, "one two three"),
]
BENCH = [
    (1, ITEM), (2, "prefix " + ITEM), (3, "hello world"), (4, "tiny"), (5, None), (6, "  "), (7, "a a a a a a a a a"),
    (8, "été zürich 42 is a nice warm place"), (None, "one two three"), (4, "tiny"), (10, "hello"),
]


def test_cases(spark):
    assert ran(spark, CASES, BENCH) == brute(CASES, BENCH)


def test_blocks_give_the_same(spark):
    assert ran(spark, CASES, BENCH, block_bytes=40) == brute(CASES, BENCH)


@pytest.mark.parametrize("k", [1, 2, 6, 8])
def test_every_gram_size(spark, k):
    assert ran(spark, CASES, BENCH, k=k) == brute(CASES, BENCH)


def test_empty_tables(spark, empty, odd, odd_rows):
    none = spark.createDataFrame([], ITEMS)
    assert contamination(empty, none).count() == 0
    out = contamination(odd, none)
    assert out.count() == len(odd_rows) and out.where("n_items > 0").count() == 0
    assert out.columns == ["doc_id", "text", "score", "kept", "n_words", "spans", "items", "n_hit", "n_items", "contaminated"]
