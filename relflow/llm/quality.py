"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors, one for each hashed word, character
n-gram and pair of adjacent words; a softmax layer reads it.  Trained by numpy
stochastic gradient descent on a bounded sample of labelled rows.  For scoring
the readout is folded into the vectors, so a bucket is one number to workers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relflow.functions.lambdas import quoted
from relflow.llm.batches import WordTable, annotate, flat, hash_words, mix, offsets, per_text, release
from relflow.llm.samples import PER_LABEL, held_out, training_texts

BUCKETS, DIM = 1 << 17, 16
EPOCHS, RATE, SEED = 6, 1.0, 7
NGRAMS = (3, 4)
#: Pairs of equal neighbours share this bucket, so that repetition is one feature.
SAME = 0

_U = np.uint64


@dataclass(frozen=True)
class QualityModel:
    """A folded number for each bucket, and the bias, both as log-odds of label 1; ``prior`` if nothing was learned."""

    weights: np.ndarray | None
    bias: float
    prior: float


def ngram_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, word numbers) of the word itself and its character n-grams, for each word."""
    framed = b" ".join([b"<" + w + b">" for w in words])
    data = np.frombuffer(framed, np.uint8).astype(_U)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 3
    owner = np.repeat(np.arange(len(words)), sizes)[: len(data)]
    buckets, owners = [(hash_words(words) % _U(BUCKETS - 1)).astype(np.int64) + 1], [np.arange(len(words))]
    for n in NGRAMS:
        m = len(data) - n + 1
        if m <= 0:
            continue
        code, ok = np.full(m, n, _U), np.ones(m, bool)
        for j in range(n):
            b = data[j : j + m]
            code = code * _U(257) + b
            ok &= b != 32
        buckets.append((mix(code[ok]) % _U(BUCKETS - 1)).astype(np.int64) + 1)
        owners.append(owner[:m][ok])
    return np.concatenate(buckets), np.concatenate(owners)


def pair_buckets(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, positions) of adjacent words of one text."""
    if len(h) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = np.ones(len(h) - 1, bool)
    ends = off[1:-1]
    inside[ends[(ends > 0) & (ends < len(h))] - 1] = False
    at = np.flatnonzero(inside)
    b = (mix(h[at] * _U(31) + h[at + 1]) % _U(BUCKETS - 1)).astype(np.int64) + 1
    return np.where(h[at] == h[at + 1], SAME, b), at


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def fit(texts: list[bytes], labels: list[int], epochs: int = EPOCHS) -> QualityModel:
    y = np.array(labels, np.int64)
    prior = float(y.mean()) if len(y) else 0.5
    if len(set(labels)) < 2:
        return QualityModel(None, 0.0, prior)
    rng = np.random.default_rng(SEED)
    bags = []
    for t in texts:
        words = words_of(t)
        if not words:
            bags.append((np.empty(0, np.int64), np.empty(0, np.float32)))
            continue
        b, _ = ngram_buckets(words)
        p, _ = pair_buckets(hash_words(words), np.array([0, len(words)]))
        ids, n = np.unique(np.concatenate([b, p]), return_counts=True)
        bags.append((ids, (n / n.sum()).astype(np.float32)))
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    readout = np.zeros((DIM, 2), np.float32)
    bias = np.zeros(2, np.float32)
    # the labels weigh alike, however rare one is in the sample
    weight = np.where(y == 1, 0.5 / prior, 0.5 / (1 - prior))
    steps = epochs * len(bags)
    for k in range(steps):
        if k % len(bags) == 0:
            order = rng.permutation(len(bags))
        i = order[k % len(bags)]
        ids, part = bags[i]
        rate = RATE * (1 - k / steps)
        hidden = part @ vectors[ids]
        z = hidden @ readout + bias
        z = np.exp(z - z.max())
        error = z / z.sum()
        error[y[i]] -= 1
        error *= weight[i]
        back = readout @ error
        readout -= rate * np.outer(hidden, error)
        bias -= rate * 0.1 * error
        # a bucket learns in proportion to its part of the text, scaled as if texts had about a hundred features
        vectors[ids] -= (rate * 100 * part)[:, None] * back[None, :]
    folded = vectors @ (readout[:, 1] - readout[:, 0])
    return QualityModel(folded.astype(np.float32), float(bias[1] - bias[0]), prior)


def maker(get: Callable[[], QualityModel], threshold: float, names: tuple[str, str]) -> Callable[[], Callable]:
    def make() -> Callable:
        model = get()

        def compute(words: list[bytes]) -> np.ndarray:
            """For each word: its hash's two halves exactly, the sum of its features, their number."""
            out = np.zeros(len(words), [("h", _U), ("s", np.float32), ("n", np.float32)])
            if words:
                b, owner = ngram_buckets(words)
                out["h"] = hash_words(words)
                out["s"] = np.bincount(owner, model.weights[b], len(words))
                out["n"] = np.bincount(owner, minlength=len(words))
            return out

        table = WordTable(compute)

        def scores(texts: list) -> np.ndarray:
            if model.weights is None:
                return np.full(len(texts), model.prior)
            words = [words_of(t) for t in texts]
            off = offsets(words)
            rows = table(flat(words))
            b, at = pair_buckets(rows["h"], off)
            total, n = rows["s"].astype(np.float64), rows["n"].astype(np.float64)
            total[at] += model.weights[b]
            n[at] += 1
            logit = per_text(total, off) / np.maximum(per_text(n, off), 1) + model.bias
            return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))

        def run(texts: list) -> dict:
            s = scores(texts)
            return {names[0]: s, names[1]: (s >= threshold).astype(np.int32)}

        return run

    return make


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", keep: list[str] | None = None, threshold: float = 0.5, per_label: int = PER_LABEL, score: str = "score", predicted: str = "predicted", held: str | None = "held_out") -> DataFrame:
    """Score (0 to 1, higher: label 1 likelier), prediction and held-out flag of each whole text.

    Learns from ``per_label`` rows of each label at most, never from held-out
    ones, and from the text alone.  Null and empty texts get the score of the
    bias.  Without rows of both labels every score is the share of label 1
    (0.5 without any).  A null id is not held out.  Repeated rows are scored
    each, very long texts whole (in the sample they count against its budget of
    bytes); other columns stay, except those named as the results.  No shuffle
    of texts.
    """
    texts, y = training_texts(docs, labels, label, doc_id, text, per_label)
    shared = docs.sparkSession.sparkContext.broadcast(fit(texts, y))
    del texts, y
    release()
    out = annotate(docs, text, maker(lambda: shared.value, threshold, (score, predicted)), f"{score} double, {predicted} int", keep)
    return out.withColumn(held, held_out(F.col(quoted(doc_id)))) if held else out
