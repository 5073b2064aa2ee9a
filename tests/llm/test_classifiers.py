import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from relflow.llm.quality import quality_scores
from relflow.llm.queries import op2_toxicity, op7_quality_classifier
from relflow.llm.toxicity import LevenshteinAutomaton, Trie, fit, intersect, maker, toxicity_scores

SF = "/root/testdata/sf0.01"


def auc(y, s):
    r, n1 = pd.Series(s).rank().to_numpy(), int(y.sum())
    return (r[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize(("query", "label", "sf", "least"), [(op7_quality_classifier, "quality", "sf0.01", 0.97), (op2_toxicity, "toxic", "sf0.1", 0.95)])
def test_held_out_accuracy(spark, query, label, sf, least):
    d = f"/root/testdata/{sf}"
    got = query(spark, d).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    m = got[got.held_out].merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id")
    y = m[label].to_numpy()
    assert auc(y, m.score) > least
    assert (m.predicted == y).mean() > 0.95


@pytest.mark.parametrize(("op", "label"), [(quality_scores, "quality"), (toxicity_scores, "toxic")])
def test_odd_rows_and_labels(spark, odd, odd_rows, empty, op, label):
    none = spark.createDataFrame([], f"doc_id bigint, {label} int")
    rows = op(odd, none).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(not r["held_out"] for r in rows if r["doc_id"] is None)
    some = spark.createDataFrame([(None, 1), (2, None), (3, 7), (5, 1), (5, 0), (10, 1)], f"doc_id bigint, {label} int")
    assert len(op(odd, some).collect()) == len(odd_rows)
    assert op(empty, some).count() == 0


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    held = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i in labels.doc_id])
    flipped = labels.assign(quality=np.where(held, 1 - labels.quality, labels.quality), toxic=np.where(held, 1 - labels.toxic, labels.toxic))
    for op in (quality_scores, toxicity_scores):
        a = op(docs, spark.createDataFrame(labels), keep=["doc_id"]).toPandas().sort_values("doc_id")
        b = op(docs, spark.createDataFrame(flipped), keep=["doc_id"]).toPandas().sort_values("doc_id")
        assert (a.score.to_numpy() == b.score.to_numpy()).all()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), new[j] + 1, row[j + 1] + 1))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=7), st.lists(st.text("abc", min_size=1, max_size=7), min_size=1, max_size=8, unique=True), st.integers(0, 2))
def test_automaton_and_trie_against_distances(word, terms, edits):
    got = dict(intersect(Trie(terms), LevenshteinAutomaton(word, edits)))
    assert got == {i: d for i, t in enumerate(terms) if (d := distance(word, t)) <= edits}


def test_misspelling_and_quotation():
    abuse = [b"you are an idiot and a fool %d" % i for i in range(20)] + [b"what a worthless thing you are %d" % i for i in range(20)]
    model = fit([*abuse, *[b"a fine day for you and a walk %d" % i for i in range(40)]], [1] * 40 + [0] * 40)
    assert {"idiot", "worthless"} <= set(model.terms)
    out = maker(lambda: model, 0.7, True)()([b"you idi0t", b"you worthles one", b'he said the word "idiot" is an insult', b"nothing here", b""])
    assert out["predicted"].tolist() == [1, 1, 0, 0, 0]
    assert out["hits"][0] == ["1:idiot:1"]


def test_samples_are_drawn_from_usable_texts(spark):
    from relflow.llm.samples import training_texts

    ids = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 3 != 1]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id bigint, quality int")
    some = ids[:12]
    docs = spark.createDataFrame([(i, f"text {i} " + "long " * 20_000) for i in some] + [(i, None) for i in ids[12:40]], "doc_id bigint, text string")
    texts, y = training_texts(docs, labels, "quality", per_label=4)
    # texts of 100 KB: two of each label are in the budget of 4 * 60 KB
    assert sorted(y) == [0, 0, 1, 1]
    assert all(len(t) > 60_000 for t in texts)
    short = spark.createDataFrame([(i, f"text {i}") for i in some], "doc_id bigint, text string")
    assert sorted(training_texts(short, labels, "quality", per_label=4)[1]) == [0] * 4 + [1] * 4
