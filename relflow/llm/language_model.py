"""Masked pseudo-likelihood with bidirectional window networks, trained in numpy.

A text is a row of tokens: words of a vocabulary, and for any other word a mark
(its length and the kind of its last letter).  A word behind a mark is spelled,
and its bytes are tokens, too.  Every token is predicted from those on both of
its sides: a mark or a vocabulary word from the words around it, a byte from the
bytes around it in its word.  Position-wise embeddings are summed, squashed, and
read by a two-level softmax (a class, then a token of the class).  A document's
score is the sum of these conditional log-probabilities.

Vocabulary and spelling come from counts of all words of the corpus; the
vocabulary grows with it.  Each task trains a copy of a network on its own rows,
and the copies are averaged, weighted by their targets.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat
from math import ceil, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relflow.llm.batches import WordTable, annotate, bound_batches, held, lower_words, mix, offsets, per_text, slices, text_of
from relflow.sources.scratch import written

#: The least number of words in the vocabulary of a corpus that has so many.
KNOWN = 1_000
#: A corpus of n bytes also gives its vocabulary all words that occur sqrt(n) / RARE times.
RARE = 5
#: Marks of other words: lengths told apart, and kinds of last byte.
LENGTHS, ENDS = 16, 4
MARKS = LENGTHS * ENDS
#: Tokens of the spelling network: the bytes and the end of a word.
BYTES = 257
SIDE, DIM = 2, 16
#: Targets of one step, and the rate and bound of a step.
BATCH, RATE, CLIP, SEED = 4_096, 0.3, 0.25, 11
#: Places that are scored at once; every class is one product, so a larger batch has fewer calls a place.
SCORED = 16_384
#: Slots of a worker's table of bytes among their neighbours, and words of its other table.
SLOTS, TABLE = 1 << 20, 600_000
#: Logits stay under this, so that exponentials are finite; and the logit of places that no token has.
MOST, NEVER = 60.0, -30.0
#: Rows in which parameters travel, and partial sums that are formed before the last.
CHUNK, SALTS = 4_096, 32


@dataclass
class Network:
    """``near``: for each token one embedding a side and distance; outputs for classes and for tokens in their class.

    The last token is the padding around a row of tokens.  The last column of an
    output is its bias.
    """

    near: np.ndarray
    hidden: np.ndarray
    classes: np.ndarray
    words: np.ndarray

    @staticmethod
    def start(size: int) -> Network:
        """A network of ``size`` tokens, the padding among them."""
        rng = np.random.default_rng(SEED)
        small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        n = isqrt(size - 1) + 1
        net = Network(small(size, 2 * SIDE * DIM), np.zeros(DIM, np.float32), small(n, DIM + 1), small(n, ceil(size / n), DIM + 1))
        c, w = place(np.arange(size, net.words.shape[0] * net.words.shape[1]), n)
        net.words[c, w] = [0] * DIM + [NEVER]
        return net

    @property
    def size(self) -> int:
        return len(self.near)

    def parts(self) -> list[np.ndarray]:
        return [self.near, self.hidden, self.classes, self.words]

    def vector(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def load(self, v: np.ndarray) -> Network:
        at = 0
        for p in self.parts():
            p[...] = v[at : at + p.size].reshape(p.shape)
            at += p.size
        return self


def place(token: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(class, number in the class): common words stand spread over all classes."""
    return token % classes, token // classes


def padded(ids: np.ndarray, off: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts with SIDE pads before, between and after them, and where the tokens stand in that."""
    at = np.arange(len(ids)) + SIDE * (1 + np.repeat(np.arange(len(off) - 1), np.diff(off)))
    out = np.full(len(ids) + SIDE * len(off), pad, np.int32)
    out[at] = ids
    return out, at


_SHIFTS = [*range(-SIDE, 0), *range(1, SIDE + 1)]


def squashed(net: Network, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hidden values, with a column of ones, at the places ``at`` of a padded row of tokens; ``at`` rises."""
    low = int(at[0]) - SIDE
    near = net.near.take(row[low : int(at[-1]) + SIDE + 1], 0)
    h = np.ones((len(at), DIM + 1), np.float32)
    total = near[SIDE + _SHIFTS[0] : len(near) - SIDE + _SHIFTS[0], :DIM] + net.hidden
    for j, shift in enumerate(_SHIFTS[1:], 1):
        total += near[SIDE + shift : SIDE + shift + len(total), j * DIM : (j + 1) * DIM]
    np.tanh(total, out=total)
    h[:, :DIM] = total if len(total) == len(at) else total[at - at[0]]
    return h


def _weights(z: np.ndarray) -> np.ndarray:
    """Exponentials of logits, in place."""
    np.minimum(z, MOST, out=z)
    return np.exp(z, out=z)


def _sorted(c: np.ndarray, w: np.ndarray, net: Network) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of their class and place, where each class begins, and where each target begins."""
    key = c * net.words.shape[1] + w
    order = np.argsort(key.astype(np.uint16) if net.words.shape[0] * net.words.shape[1] <= 1 << 16 else key, kind="stable")
    key = key[order]
    runs = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return order, np.concatenate([[0], np.cumsum(np.bincount(c, minlength=len(net.classes)))]), runs


def log_probs(net: Network, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log-probability of each token at the places ``at`` of a padded row, from its neighbours."""
    h = squashed(net, row, at)
    c, w = place(row[at], len(net.classes))
    order, cuts, _ = _sorted(c, w, net)
    h, c, w = h.take(order, 0), c[order], w[order]
    # logits of the tokens, and sums by products, which are faster than sums of short rows
    own = np.minimum(np.einsum("ij,ij->i", h, net.words.reshape(-1, DIM + 1).take(c * net.words.shape[1] + w, 0)), MOST)
    out = np.minimum(np.einsum("ij,ij->i", h, net.classes.take(c, 0)), MOST) + own
    total = _weights(h @ net.classes.T) @ np.ones(len(net.classes), np.float32)
    inner, ones = np.empty_like(total), np.ones(net.words.shape[1], np.float32)
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = cuts[k], cuts[k + 1]
        np.matmul(_weights(h[a:b] @ net.words[k].T), ones, out=inner[a:b])
    # apart, as the product of two sums may be too large
    out -= np.log(total) + np.log(inner)
    back = np.empty(len(out))
    back[order] = out
    return back


def step(net: Network, row: np.ndarray, at: np.ndarray, weight: np.ndarray | None = None) -> None:
    """One step of stochastic gradient descent on the targets at ``at``; ``weight`` tells how often each of them occurs."""
    h = squashed(net, row, at)
    c, w = place(row[at], len(net.classes))
    order, cuts, runs = _sorted(c, w, net)
    h, c, w = h.take(order, 0), c[order], w[order]
    share = None if weight is None else weight[order].astype(np.float32)
    heavy = h if share is None else h * share[:, None]
    scale = np.float32(1 / np.sqrt(len(at) if share is None else share.sum()))
    # with e the unnormalised probabilities, the gradient of a logit is e / sum(e), less one at the target;
    # a column of ones gives the sums of e with the product that is needed anyway
    one = 1 if share is None else share[:, None]
    e = _weights(h @ net.classes.T)
    both = e @ np.concatenate([net.classes, np.ones((len(net.classes), 1), np.float32)], 1)
    own = one / both[:, DIM + 1 :]
    some = np.flatnonzero(np.diff(cuts))
    grad = e.T @ (h * own)
    grad[some] -= np.add.reduceat(heavy, cuts[some], axis=0)
    back = both[:, : DIM + 1] * own
    inner = np.zeros_like(net.words)
    summing = np.concatenate([net.words, np.ones((*net.words.shape[:2], 1), np.float32)], 2)
    e = np.empty((len(h), net.words.shape[1]), np.float32)
    spans = [(k, slice(*cuts[k : k + 2].tolist())) for k in some.tolist()]
    for k, span in spans:
        np.matmul(h[span], net.words[k].T, out=e[span])
    _weights(e)
    for k, span in spans:
        np.matmul(e[span], summing[k], out=both[span])
    own = one / both[:, DIM + 1 :]
    back += both[:, : DIM + 1] * own
    scaled = h * own
    for k, span in spans:
        np.matmul(e[span].T, scaled[span], out=inner[k])
    taken = net.classes.take(c, 0) + net.words.reshape(-1, DIM + 1).take(c * net.words.shape[1] + w, 0)
    back -= taken if share is None else taken * one
    inner[c[runs], w[runs]] -= np.add.reduceat(heavy, runs, axis=0)
    net.words -= RATE * np.clip(inner * scale, -CLIP, CLIP)
    net.classes -= RATE * np.clip(grad * scale, -CLIP, CLIP)
    back = back[:, :DIM] * (1 - h[:, :DIM] ** 2)
    net.hidden -= RATE * np.clip(back.sum(0) * scale, -CLIP, CLIP)
    # each token of the row learns from the targets around it
    low = int(at[0]) - SIDE
    tokens = row[low : int(at[-1]) + SIDE + 1]
    whole = np.zeros((len(tokens) - 2 * SIDE, DIM))
    whole[at[order] - at[0]] = back
    found, number = numbers_of(tokens, net.size)
    # one sum for each token and dimension, by counting: sums of runs of rows take one call a run and column
    cell = number[:, None] * DIM + np.arange(DIM)
    spread = np.empty((len(found), 2 * SIDE * DIM), np.float32)
    for j, shift in enumerate(_SHIFTS):
        near = cell[SIDE + shift : SIDE + shift + len(whole)]
        spread[:, j * DIM : (j + 1) * DIM] = np.bincount(near.ravel(), whole.ravel(), len(found) * DIM).reshape(-1, DIM)
    net.near[found] -= RATE * np.clip(spread * scale, -CLIP, CLIP)


def numbers_of(tokens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different tokens, of ``size`` that there are, and each token's number among them."""
    order = np.argsort(tokens.astype(np.uint16) if size <= 1 << 16 else tokens, kind="stable")
    inside = tokens[order]
    new = np.concatenate([[True], inside[1:] != inside[:-1]])
    number = np.empty(len(tokens), np.int64)
    number[order] = np.cumsum(new) - 1
    return inside[new], number


# words and spelling ---------------------------------------------------------
def marks_of(words: list[bytes]) -> np.ndarray:
    """The marks, from 0, of words that the vocabulary lacks."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    last = np.frombuffer(b"".join(words), np.uint8)[np.cumsum(n) - 1]
    return (np.minimum(n, LENGTHS) - 1) * ENDS + last % ENDS


def size_of(vocabulary: dict[bytes, int]) -> int:
    """The number of tokens: words, marks and the padding."""
    return len(vocabulary) + MARKS + 1


def spelling(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(padded row, places of the bytes, offsets) of words as rows of bytes."""
    off = offsets(words)
    row, at = padded(np.frombuffer(b"".join(words), np.uint8).astype(np.int32), off, BYTES - 1)
    return row, at, off


def windows_of(row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place a number made of its byte and those around it."""
    code = np.zeros(len(at), np.int64)
    for shift in range(-SIDE, SIDE + 1):
        code = code * BYTES + row[at + shift]
    return code


def bounded(words: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Runs of words of ``most`` bytes, or of one word."""
    start = total = 0
    for i, w in enumerate(words):
        if i > start and total + len(w) > most:
            yield start, i
            start, total = i, 0
        total += len(w)
    if words:
        yield start, len(words)


def row_of(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A padded row of tokens in which the middle of each window stands between its neighbours, and these places."""
    width = 2 * SIDE + 1
    digits = [windows // BYTES ** (width - 1 - j) % BYTES for j in range(width)]
    return np.stack(digits, 1).astype(np.int32).ravel(), np.arange(len(windows)) * width + SIDE


class Speller:
    """Log-probabilities of spelled words; windows that have been seen stay in a table of SLOTS slots."""

    def __init__(self, net: Network):
        self.net = net
        self.keys, self.logs = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, np.float32)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """The summed log-probability of each word's bytes from the bytes around them."""
        row, at, off = spelling(words)
        windows = windows_of(row, at)
        slot = (mix(windows.view(np.uint64)) & np.uint64(SLOTS - 1)).astype(np.int64)
        out = self.logs[slot]
        missing = np.flatnonzero(self.keys[slot] != windows)
        if len(missing):
            new, first, where = np.unique(windows[missing], return_index=True, return_inverse=True)
            logs = np.empty(len(new), np.float32)
            for a in range(0, len(new), SCORED):
                logs[a : a + SCORED] = log_probs(self.net, *row_of(new[a : a + SCORED]))
            out[missing] = logs[where]
            self.keys[slot[missing[first]]], self.logs[slot[missing[first]]] = new, logs
        return per_text(out.astype(np.float64), off)


_NUMBERED = [("id", np.int32), ("n", np.int32), ("log", np.float32)]


def numbered(vocabulary: dict[bytes, int], spell: Callable[[list], np.ndarray] | None = None) -> Callable[[list], np.ndarray]:
    """For each of a list of new words: its token, the number of tokens it comes to, and its spelling's log-probability."""

    def compute(words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words), _NUMBERED)
        out["id"] = known = np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int32, len(words))
        out["n"] = 1
        other = np.flatnonzero(known < 0)
        if len(other):
            theirs = [words[i] for i in other.tolist()]
            out["id"][other] = len(vocabulary) + marks_of(theirs)
            out["n"][other] += np.fromiter(map(len, theirs), np.int32, len(theirs))
            if spell:
                out["log"][other] = spell(theirs)
        return out

    return compute


# training -------------------------------------------------------------------
def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(w, n): how often each word of the whole corpus occurs; summed in the tasks and then over them."""
    bound_batches(docs.sparkSession)
    source = docs.select(text_of(docs, text).alias("t"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = defaultdict(int)

        def hand_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["w", "n"])

        for batch in batches:
            for part in slices(batch, 0):
                words, numbers, _ = lower_words(part.column(0).to_pylist())
                for w, n in zip(words, np.bincount(numbers, minlength=len(words)).tolist(), strict=True):
                    held[w] += n
                if len(held) > 400_000:
                    yield hand_on()
                    held.clear()
        yield hand_on()

    return source.mapInArrow(run, "w binary, n bigint").groupBy("w").agg(F.sum("n").alias("n"))


def vocabulary_of(counts: DataFrame, size: int) -> dict[bytes, int]:
    """Words by count and then by word: the KNOWN commonest, and all that occur sqrt(size) / RARE times; ``size`` in bytes.

    The vocabulary grows with the corpus, with RARE * sqrt(size) / 2 words at the
    most.  The driver gets these rows only.
    """
    least = max(2, isqrt(size) // RARE)
    best = [*counts.orderBy(F.col("n").desc(), F.col("w").asc()).limit(KNOWN).collect(), *counts.where(F.col("n") >= least).collect()]
    return {w: i for i, (_, w) in enumerate(sorted({(-r["n"], bytes(r["w"])) for r in best}))}


def averaged(source: DataFrame, size: int, learn: Callable[[], Callable[[Network, list], int]]) -> Network:
    """A network of ``size`` tokens: the mean of the copies that tasks train on their rows of ``source``, weighted by their targets.

    ``learn()`` runs once a task; what it returns gets a network and the columns
    of a batch (with no columns at the end), and returns the number of targets
    that it has trained on.  Without any the first weights stay.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, seen, learned = Network.start(size), 0, learn()
        for batch in batches:
            for part in slices(batch, 0):
                seen += learned(net, [c.to_pylist() for c in part.columns])
        seen += learned(net, [])
        if seen:
            v = net.vector().astype(np.float64) * seen
            salt = int(v[:64].sum() * 1e6) % SALTS
            for k in range(0, len(v), CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([k // CHUNK], pa.int32()), pa.array([salt], pa.int32()), pa.array([float(seen)]), pa.array([v[k : k + CHUNK].tobytes()], pa.binary())], names=["chunk", "salt", "n", "v"])

    kind = "chunk int, salt int, n double, v binary"
    sums = source.mapInArrow(run, kind).groupBy("chunk", "salt").applyInPandas(_summed, kind).groupBy("chunk").applyInPandas(_summed, kind)
    rows = sorted(sums.collect(), key=lambda r: r["chunk"])
    net = Network.start(size)
    return net.load(np.concatenate([np.frombuffer(bytes(r["v"])) / r["n"] for r in rows]).astype(np.float32)) if rows else net


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(rows["v"].iloc[0]) // 8)
    for v in rows["v"]:
        total += np.frombuffer(v)
    return pd.DataFrame({"chunk": rows["chunk"][:1], "salt": rows["salt"][:1], "n": [rows["n"].sum()], "v": [total.tobytes()]})


def text_learner(vocabulary: dict[bytes, int], table: WordTable | None = None) -> Callable[[Network, list], int]:
    """Trains a network on every position of the texts that it gets."""
    table = table or WordTable(numbered(vocabulary), TABLE)

    def learn(net: Network, columns: list) -> int:
        if not columns:
            return 0
        words, numbers, off = lower_words(columns[0])
        if not words:
            return 0
        row, at = padded(table(words)["id"][numbers], off, net.size - 1)
        for a in range(0, len(at), BATCH):
            step(net, row, at[a : a + BATCH])
        return len(at)

    return learn


def spelling_learner(vocabulary: dict[bytes, int]) -> Callable[[Network, list], int]:
    """Trains a network on every byte of the words that the vocabulary lacks; a word counts as often as it occurs."""

    def learn(net: Network, columns: list) -> int:
        other = [(w, n) for w, n in zip(*columns, strict=True) if w not in vocabulary] if columns else []
        words, counts, seen = [w for w, _ in other], np.array([n for _, n in other], np.float64), 0
        for lo, hi in bounded(words, BATCH):
            row, at, off = spelling(words[lo:hi])
            weight = np.repeat(counts[lo:hi], np.diff(off))
            for a in range(0, len(at), BATCH):
                step(net, row, at[a : a + BATCH], weight[a : a + BATCH])
            seen += int(weight.sum())
        return seen

    return learn


# scoring --------------------------------------------------------------------
def maker(get: Callable[[], tuple[dict, Network, Network]], key: str | None = None) -> Callable[[], Callable]:
    def make() -> Callable:
        vocabulary, net, speller = get()
        fresh = lambda: WordTable(numbered(vocabulary, Speller(speller)), TABLE)
        table = held(key, fresh) if key else fresh()

        def run(texts: list) -> dict:
            words, numbers, off = lower_words(texts)
            logs, n = np.zeros(len(numbers)), np.zeros(len(numbers), np.int64)
            if words:
                info = table(words)[numbers]
                row, at = padded(info["id"], off, net.size - 1)
                for a in range(0, len(at), SCORED):
                    logs[a : a + SCORED] = log_probs(net, row, at[a : a + SCORED])
                logs += info["log"]
                n = info["n"].astype(np.int64)
            total, n = per_text(logs, off), per_text(n, off)
            return {"n_tokens": n, "log_prob": total, "mean_log_prob": [t / k if k else None for t, k in zip(total.tolist(), n.tolist(), strict=True)]}

        return run

    return make


def pseudo_likelihood(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``n_tokens``, ``log_prob`` (summed over tokens) and ``mean_log_prob`` of each whole text.

    Vocabulary and networks come from all of ``docs``: every position of every text
    is a training target.  A word of the vocabulary is one token; any other word is
    a mark and its bytes.  Null and empty texts have no tokens, log_prob 0 and no
    mean.  A very long text is scored in one piece.  Repeated rows score alike;
    other columns stay, except those named as the results.  An empty table gives an
    empty table.  The networks, and so the scores, depend on how the input is split
    into tasks, since each task trains a copy on its rows.
    """
    spark, key = docs.sparkSession, uuid.uuid4().hex
    size = docs.select(F.sum(F.octet_length(text_of(docs, text))).alias("n")).first()["n"] or 0
    counts = written(word_counts(docs, text), "words")
    vocabulary = vocabulary_of(counts, size)
    shared = spark.sparkContext.broadcast(vocabulary)
    speller = averaged(counts.select("w", "n"), BYTES, lambda: spelling_learner(shared.value))
    table = lambda: held(key, lambda: WordTable(numbered(shared.value), TABLE))
    net = averaged(docs.select(text_of(docs, text).alias("t")), size_of(vocabulary), lambda: text_learner(shared.value, table()))
    model = spark.sparkContext.broadcast((vocabulary, net, speller))
    return annotate(docs, text, maker(lambda: model.value, f"{key}-scores"), "n_tokens bigint, log_prob double, mean_log_prob double", keep)
