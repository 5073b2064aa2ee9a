"""The stages against brute force, each on its own input."""

import corpus_pipeline
import pandas as pd
import sentencepiece

import public_tokenizers
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_neardup import brute as near
from tests.llm.test_secrets import brute as secret_counts

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.toPandas()
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        after = docs.toPandas()
        rows = list(zip(before.doc_id.tolist(), before.text.tolist(), strict=True))
        if name == "quality classifier":
            known = labels[labels.doc_id.isin(before.doc_id)]
            assert known[known.quality == 1].doc_id.isin(after.doc_id).mean() > 0.97
            assert known[known.quality == 0].doc_id.isin(after.doc_id).mean() < 0.05
        elif name == "near-duplicates":
            assert sorted(after.doc_id) == [d for d, _, _, kept in near(rows) if kept]
        elif name == "decontamination":
            want = contaminated(rows, list(zip(items.item_id.tolist(), items.text.tolist(), strict=True)))
            assert sorted(after.doc_id) == sorted(r[0] for r in want if not r[2])
            assert len(after) < len(before)
        elif name == "secrets":
            assert sorted(after.doc_id) == sorted(before.doc_id)
            assert all(secret_counts(t)[:3] == (0, 0, 0) for t in after.text)
            assert (after.text.str.len() == after.n_chars).all()
            same = after.merge(before, on="doc_id")
            for a, b in zip(same.text_x, same.text_y, strict=True):
                assert (a == b) == (secret_counts(b)[:3] == (0, 0, 0))
        else:
            sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            ids = dict(zip(after.doc_id, after.ids, strict=True))
            assert sorted(ids) == sorted(before.doc_id)
            assert all(list(ids[d]) == sp.encode(t) for d, t in rows)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    ran = corpus_pipeline.run(spark, SF).toPandas().sort_values("doc_id")
    assert ran.ids_sha256.tolist() == docs.toPandas().sort_values("doc_id").ids_sha256.tolist()


def test_null_ids_and_repeats(spark):
    long = "a text of a few words that stays as it is here"
    docs = spark.createDataFrame([(None, "one", None, None, None), (None, long, "en", "s", 1), (1, long, "en", "s", 1), (1, long, "en", "s", 1), (2, None, "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "None", "None"]
    assert corpus_pipeline.secrets(spark, docs, SF).count() == 5
    assert corpus_pipeline.decontaminate(spark, docs, SF).count() == 5


def test_a_passage_of_one_item_is_enough(spark):
    item = pd.read_parquet(f"{SF}/benchmark.parquet").text[0]
    passage = " ".join(item.split()[:10])
    rows = [(1, f"some words before {passage} and some after"), (2, "some words before " + " ".join(item.split()[:5]) + " and some after"), (3, None), (4, passage.upper())]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, n_hit string, n_items bigint")
    out = corpus_pipeline.decontaminate(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.collect()) == [(2, rows[1][1], "en", "s", 1), (3, None, "en", "s", 1)]


def test_clashing_ids(spark):
    a, b = "a text of a few words that stays as it is here", "some other passage with nothing in common at all but its number"
    rows = [(1, a), (2, a), (2, b), (3, "one more unlike text under this id"), (3, "and yet another that shares no words"), (3, "and yet another that shares no words"), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()]
    assert sorted(kept, key=str) == sorted({r for r in rows if r != (2, a)}, key=str)
