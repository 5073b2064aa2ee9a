import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from relflow.llm.pieces import PieceCache, PieceModel, encode_pieces
from relflow.llm.tokencount import frequent_lengths, token_counts

RNG = random.Random(3)
ALPHABET = "  \n\t ab cdeTHE'sll1234.,!?-_▁éß中文مر\U0001f600  ​\u0085\x1c\x00ﬁ"
RANDOM = ["".join(RNG.choice(ALPHABET) for _ in range(RNG.randint(1, 60))) for _ in range(400)]
TEXTS = [
    *RANDOM, "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "it's  we'll  you've", "   lead and trail   ",
    "͸՘ unassigned", "\U000323b0 new", "<s>x</s><unk>", "a" * 500, " " * 50 + "x", "1234567890" * 9,
]


@pytest.fixture(scope="module")
def docs(spark, small):
    rows = list(enumerate([*TEXTS, *small.text.tolist()]))
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_pieces_equal_the_library(docs):
    rows, df = docs
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in encode_pieces(df).collect()}
    for i, t in rows:
        ids = sp.encode(t)
        assert got[i]["ids"] == ids, t
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids))))
        assert got[i]["decoded"] == sp.decode(ids)
        assert got[i]["decoded_sha256"] == sha(sp.decode(ids))


def test_counts_equal_the_library(docs):
    rows, df = docs
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in token_counts(df, limit=30).collect()}
    for i, t in rows:
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len(t.encode()), n > 30), t


@pytest.mark.parametrize("op", [encode_pieces, token_counts])
def test_odd_rows(odd, odd_rows, empty, op):
    out = op(odd)
    assert out.columns[:5] == ["doc_id", "text", "score", "n_words", "kept"]
    rows = out.collect()
    assert len(rows) == len(odd_rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    assert op(empty).count() == 0


def test_miss_caches_turn_over(spark, monkeypatch):
    from relflow.llm import pieces, tokencount

    path = public_tokenizers.path("piece_bpe_32k.model")
    cache = pieces.PieceCache(pieces.PieceModel(path))
    monkeypatch.setattr(pieces, "CACHE", 3)
    first = [cache(pieces.chunks_of(t)) for t in RANDOM]
    assert first == [cache(pieces.chunks_of(t)) for t in RANDOM]
    monkeypatch.setattr(tokencount, "CACHE", 3)
    counts = tokencount.Counts(public_tokenizers.path("byte_bpe_50k.json"))
    p = [x for t in RANDOM for x in counts.pretokens(t)[0]]
    assert counts.lookup({}, p) == {x: n for x, n in zip(p, counts.lengths(p), strict=True)}
    assert [counts.lookup({}, [x])[x] for x in p[:50]] == counts.lengths(p[:50])


def test_the_table_holds_the_commonest_pretokens_of_all_texts(spark, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    # the commonest word stands in the last rows only, beyond any prefix of the table
    rows = [(i, f"word{i} only") for i in range(600)] + [(1000 + i, "x lateword lateword") for i in range(600)] + [(3000, None), (3001, "y" * 100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    table = frequent_lengths(df, "text", path)
    tok = Tokenizer.from_file(path)
    assert {" lateword", " only", "x"} <= table.keys() and "y" * 100 not in table
    assert all(n == len(tok.encode(p, add_special_tokens=False).ids) for p, n in table.items())
    assert frequent_lengths(empty, "text", path) == {" ": 1}


def test_the_table_with_idle_merge_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string").coalesce(1)
        assert frequent_lengths(df, "text", public_tokenizers.path("byte_bpe_50k.json")).keys() == {" ", "a", " b"}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_chunks_that_do_not_decode_to_themselves_are_not_kept(monkeypatch):
    cache = PieceCache(PieceModel(public_tokenizers.path("piece_bpe_32k.model")))
    whole = cache.model.decode_ids
    monkeypatch.setattr(cache.model, "decode_ids", lambda ids: "?" if whole(ids) == " odd" else whole(ids))
    for _ in range(2):
        found, backs = cache([" odd", " even", " odd"])
        assert backs == {" odd": "?"} and found[0] == found[2] and cache.young.keys() == {" even"}
