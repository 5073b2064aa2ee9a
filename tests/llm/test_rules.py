import re

import pandas as pd

from relflow.llm.queries import op3_quality_rules
from relflow.llm.rules import Rules, judge_line, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    rep = {j for x in at.values() if len(x) > 1 for i in x for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(rep) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep), failed


def test_base_counts(spark, small, odd, odd_rows):
    got = {r["doc_id"]: r for r in op3_quality_rules(spark, "/root/testdata/sf0.001").collect()}
    for i, t in zip(small.doc_id, small.text, strict=True):
        assert tuple(got[i])[1:7] == brute(t)
        assert not (got[i]["base_failed"] and got[i]["kept"])
    rows = quality_rules(odd).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(r["text"])


def test_repeats_of_tables_of_rows(spark):
    texts = ["x y z " * 30, "a b c d e f g h " * 2 + "q", "l\nl\nl\n\n\nm\nl", "t1 t2 t3 t4 t5 t6 t7 t8 u t1 t2 t3 t4 t5 t6 t7 t8"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    for r in quality_rules(df).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(r["text"])


def test_clean_documents_stay(spark, small, labels):
    got = quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    fair = got[~got.base_failed]
    assert fair[fair.quality == 1].kept.mean() > 0.99
    assert fair[fair.quality == 0].kept.mean() < 0.1


def test_lines(spark):
    judge = lambda s: judge_line(s.encode(), len(s.split()), Rules())
    assert judge("Home | News | Sport | About | Contact") == "navigation"
    assert judge("BUY!! NOW!! CHEAP!! STUFF!!") == "punctuation"
    assert judge("We use cookies. Accept cookies to go on.") == "boilerplate"
    assert judge("$$$ ### *** %%%") == "punctuation"
    assert judge("This is a sentence that anyone could have written.") is None
    text = "Home | News | Sport | About | Contact\n" + "A plain line of words that says a thing or two.\n" * 1 + "Another line which says yet another thing here, and more of it."
    out = quality_rules(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert out["clean_text"] == text.split("\n", 1)[1] and out["kept"] and out["n_lost_words"] == 9


def test_empty_table(empty):
    assert quality_rules(empty).count() == 0
