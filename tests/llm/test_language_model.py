import math
import random

import numpy as np
import pytest

from relflow.llm import language_model
from relflow.llm.language_model import (
    BYTES, DIM, KNOWN, MARKS, MOST, RATE, SIDE, Network, Speller, averaged, bounded, log_probs, maker, marks_of, padded, pseudo_likelihood,
    row_of, size_of, spelling, spelling_learner, step, text_learner, vocabulary_of, windows_of, word_counts,
)

SF = "/root/testdata/sf0.001"


def naive(net, tokens, i):
    """The log-probability of token i from its neighbours, one number at a time."""
    pad, n = net.size - 1, len(net.classes)
    near = [tokens[i + s] if 0 <= i + s < len(tokens) else pad for s in (-2, -1, 1, 2)]
    h = [math.tanh(float(net.hidden[d]) + sum(float(net.near[t][j * DIM + d]) for j, t in enumerate(near))) for d in range(DIM)]
    logit = lambda w: min(MOST, sum(float(a) * b for a, b in zip(w[:-1], h, strict=True)) + float(w[-1]))

    def log_soft(table, k):
        z = [logit(w) for w in table]
        return z[k] - math.log(sum(map(math.exp, z)))

    return log_soft(net.classes, tokens[i] % n) + log_soft(net.words[tokens[i] % n], tokens[i] // n)


def rough(size):
    """A network whose weights all differ."""
    net = Network.start(size)
    rng = np.random.default_rng(5)
    net.load((net.vector() + rng.normal(0, 0.3, net.vector().size)).astype(np.float32))
    c, w = np.arange(size, net.words.shape[0] * net.words.shape[1]) % len(net.classes), np.arange(size, net.words.shape[0] * net.words.shape[1]) // len(net.classes)
    net.words[c, w] = [0] * DIM + [-30]
    return net


def test_scores_equal_a_naive_model():
    vocabulary = {b"the": 0, b"of": 1, b"and": 2}
    net, speller = rough(size_of(vocabulary)), rough(BYTES)
    texts = [b"The cat of the moon and qqqqqqqqqqqqqqqqqqqqq", None, b"of", "zürich and ▁ the the".encode(), b" "]
    out = maker(lambda: (vocabulary, net, speller))()(texts)
    for text, n, log, mean in zip(texts, out["n_tokens"], out["log_prob"], out["mean_log_prob"], strict=True):
        words = (text or b"").lower().split()
        tokens = [vocabulary.get(w, len(vocabulary) + int(marks_of([w])[0])) for w in words]
        want, count = sum(naive(net, tokens, i) for i in range(len(tokens))), len(tokens)
        for w in words:
            if w not in vocabulary:
                want += sum(naive(speller, list(w), i) for i in range(len(w)))
                count += len(w)
        assert n == count and log == pytest.approx(want, abs=1e-3)
        assert mean is None if not count else mean == pytest.approx(want / count, abs=1e-4)


def test_conditional_probabilities_sum_to_one():
    for size in (size_of({}), BYTES, 1000, 2025):
        net, total = rough(size), 0.0
        for t in range(size):
            row, at = padded(np.array([3, t, 5]), np.array([0, 3]), size - 1)
            total += math.exp(log_probs(net, row, at[1:2])[0])
        assert total == pytest.approx(1, abs=1e-3)


@pytest.mark.parametrize("weighted", [False, True])
def test_a_step_follows_the_gradient(weighted, monkeypatch):
    import relflow.llm.language_model as lm

    monkeypatch.setattr(lm, "CLIP", np.inf)
    size, rng = 40, random.Random(2)
    net = rough(size)
    tokens, off = [rng.randrange(size - 1) for _ in range(60)], np.array([0, 20, 21, 60])
    row, at = padded(np.array(tokens), off, size - 1)
    at = at[5:50]
    weight = np.array([rng.randrange(1, 9) for _ in at]) if weighted else None
    loss = lambda: -float((log_probs(net, row, at) * (1 if weight is None else weight)).sum())
    before, start = net.vector().copy(), loss()
    step(net, row, at, weight)
    moved = (net.vector() - before) / -RATE * math.sqrt(len(at) if weight is None else weight.sum())
    net.load(before)
    assert start == pytest.approx(loss())
    for i in rng.sample(range(len(before)), 60):
        values = []
        for e in (1e-2, -1e-2):
            v = before.copy()
            v[i] += e
            net.load(v)
            values.append(loss())
        assert moved[i] == pytest.approx((values[0] - values[1]) / 2e-2, abs=0.05, rel=0.05)


def test_padding_keeps_texts_apart():
    row, at = padded(np.array([1, 2, 3]), np.array([0, 2, 2, 3]), 9)
    assert row.tolist() == [9, 9, 1, 2, 9, 9, 9, 9, 3, 9, 9] and row[at].tolist() == [1, 2, 3] and SIDE == 2
    assert list(bounded([b"aa", b"bbb", b"c", b"dddddd"], 5)) == [(0, 2), (2, 3), (3, 4)] and not list(bounded([], 5))


def test_marks_and_spelling():
    assert set(marks_of([bytes([97 + k % 26]) * n for n in range(1, 40) for k in range(26)]).tolist()) == set(range(MARKS))
    row, at, off = spelling([b"ab", b"c"])
    assert row[at].tolist() == [97, 98, 99] and off.tolist() == [0, 2, 3]
    again, places = row_of(windows_of(row, at))
    assert again[places].tolist() == [97, 98, 99] and again[:5].tolist() == [256, 256, 97, 98, 256]


def test_windows_that_clash_in_the_table(monkeypatch):
    import relflow.llm.language_model as lm

    net, rng = rough(BYTES), random.Random(6)
    words = [bytes(rng.randrange(256) for _ in range(rng.randrange(1, 9))) for _ in range(200)] * 2
    want = Speller(net)(words)
    monkeypatch.setattr(lm, "SLOTS", 4)
    few = Speller(net)
    assert np.allclose(few(words), want) and np.allclose(few(words[::-1]), want[::-1]) and few([]).tolist() == []


def test_counts_and_vocabulary(spark):
    docs = spark.createDataFrame([("A b a",), (None,), ("",), ("b ü c",)], "text string")
    assert {(bytes(r["w"]).decode(), r["n"]) for r in word_counts(docs, "text").collect()} == {("a", 2), ("b", 2), ("ü", 1), ("c", 1)}
    # words that are common enough all count, however many there are; others only among the KNOWN commonest
    many = spark.createDataFrame([(" ".join(f"v{i}" for i in range(KNOWN + 500)),)] * 8, "text string")
    counts = word_counts(many, "text")
    assert len(vocabulary_of(counts, 0)) == KNOWN + 500
    few = vocabulary_of(counts, 10**6)
    assert sorted(few) == sorted(sorted(f"v{i}".encode() for i in range(KNOWN + 500))[:KNOWN]) and sorted(few.values()) == list(range(KNOWN))


def test_copies_are_averaged_by_their_targets(spark):
    texts = [("a b a c " * 40,), ("d e " * 10,), ("a d x " * 300,), (None,)]
    vocabulary = {w: i for i, w in enumerate((b"a", b"b", b"c", b"d", b"e"))}
    source = spark.createDataFrame(texts, "t string").selectExpr("cast(t as binary) as t").repartitionByRange(3, "t")
    want, total = 0.0, 0
    for part in source.rdd.glom().collect():
        net, learn, seen = Network.start(size_of(vocabulary)), text_learner(vocabulary), 0
        if rows := [bytes(r["t"]) if r["t"] is not None else None for r in part]:
            seen += learn(net, [rows])
        want, total = want + seen * net.vector().astype(np.float64), total + seen
    got = averaged(source, size_of(vocabulary), lambda: text_learner(vocabulary))
    assert total == 160 + 20 + 900 and np.allclose(got.vector(), want / total, atol=1e-6)


def test_every_position_trains(spark):
    docs = spark.createDataFrame([("a b",), ("c",), ("a b c d",), (None,)] * 30, "text string")
    vocabulary = vocabulary_of(word_counts(docs, "text"), 0)
    net, start = averaged(docs.selectExpr("cast(text as binary) as t"), size_of(vocabulary), lambda: text_learner(vocabulary)), Network.start(size_of(vocabulary))
    row, at = padded(np.array([vocabulary[w] for w in (b"a", b"b", b"c", b"d")]), np.array([0, 4]), net.size - 1)
    assert (log_probs(net, row, at) > log_probs(start, row, at)).all()
    # a word that occurs n times weighs as much as n words
    one, many = Network.start(BYTES), Network.start(BYTES)
    learn = spelling_learner({b"known": 0})
    assert learn(one, [[b"abc", b"known"], [3, 7]]) + learn(one, []) == 9
    learn = spelling_learner({})
    assert learn(many, [[b"abc"] * 3, [1] * 3]) + learn(many, []) == 9
    assert np.allclose(one.vector(), many.vector(), atol=1e-6)


def test_likelier_texts_score_higher(spark, odd, odd_rows, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rng = random.Random(1)
    text = max((r["text"] for r in docs.collect()), key=len).split()
    rng.shuffle(text)
    strange = spark.createDataFrame([(-1, " ".join("".join(rng.choice("qxzjkvw") for _ in range(6)) for _ in range(300))), (-2, " ".join(text))], "doc_id bigint, text string")
    got = pseudo_likelihood(docs.unionByName(strange), keep=["doc_id"]).toPandas().set_index("doc_id")
    real = got[(got.index >= 0) & (got.n_tokens >= 200)].mean_log_prob
    assert got.loc[-1].mean_log_prob < real.median() > -np.log(BYTES)
    assert np.isclose(got.log_prob / got.n_tokens, got.mean_log_prob).all()
    rows = pseudo_likelihood(odd).collect()
    assert len(rows) == len(odd_rows) and all(r["mean_log_prob"] is None for r in rows if not r["n_tokens"])
    assert pseudo_likelihood(empty).count() == 0


def test_rare_words_are_told_apart(spark):
    # two words of one mark that are outside the vocabulary, in the same place
    common = " ".join(f"w{i} w{i}" for i in range(KNOWN))
    docs = spark.createDataFrame([(0, common), (1, "w1 abcdez w2"), (2, "w1 qxjkvz w2")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["log_prob"] for r in pseudo_likelihood(docs, keep=["doc_id"]).collect()}
    assert np.ptp(marks_of([b"abcdez", b"qxjkvz"])) == 0 and abs(got[1] - got[2]) > 1e-3


def test_texts_are_scored_in_large_batches(monkeypatch):
    """A text of several training batches is scored in few calls, with the result of many."""
    vocabulary = {b"w%d" % i: i for i in range(50)}
    net, speller = Network.start(size_of(vocabulary)), Network.start(BYTES)
    text = b" ".join(b"w%d" % (i * i % 53) for i in range(3 * language_model.BATCH))
    calls, whole = [], language_model.log_probs
    monkeypatch.setattr(language_model, "log_probs", lambda n, row, at: calls.append(n is net) or whole(n, row, at))
    run = language_model.maker(lambda: (vocabulary, net, speller))()
    large, few = run([text])["log_prob"][0], sum(calls)
    monkeypatch.setattr(language_model, "SCORED", 1_000)
    assert few == 1 and np.isclose(large, run([text])["log_prob"][0], rtol=1e-6)


def test_a_step_sums_few_runs(monkeypatch):
    """A sum over runs of rows takes a call for each run and column, which was a quarter of a step: what tokens learn is counted instead."""
    calls = []

    class Add:
        @staticmethod
        def reduceat(x, at, axis):
            calls.append(len(at) * x.shape[1])
            return np.add.reduceat(x, at, axis=axis)

    class Counted:
        add = Add

        def __getattr__(self, name):
            return getattr(np, name)

    size = 2000
    net, (row, at) = Network.start(size), padded(np.arange(size - 1), np.array([0, size - 1]), size - 1)
    before = net.near.copy()
    monkeypatch.setattr(language_model, "np", Counted())
    step(net, row, at)
    assert (net.near[:-1] != before[:-1]).any(1).all() and sum(calls) < size * 2 * SIDE * DIM / 2
