"""Toxicity: misspelled lexicon terms in their context.

Levenshtein automata of a text's words are intersected with a trie of lexicon
terms.  A term is a word, or a stem that inflected forms begin with.  A window
of words around each hit tells quotation from abuse; the summed evidence of a
text goes through a logistic model.  Lexicon and weights are learned from a
bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relflow.functions.lambdas import quoted
from relflow.llm.batches import WordTable, annotate, flat, offsets
from relflow.llm.samples import PER_LABEL, held_out, training_texts

#: Words on either side of a hit that are its context.
WINDOW = 8
#: Terms of the learned lexicon at most, and the least texts of label 1 that hold one.
TERMS, MIN_TEXTS = 200, 4
#: A term's share of texts with label 1, both labels weighed alike, must reach this.
PRECISION = 0.9
#: Part of the texts with label 1 that a term must add, or part of the commonest word's texts that a word must hold.
GAIN, ALIKE = 0.015, 0.4
#: Letters of a stem; a text must hold two words of a stem to count for it.
STEM, STEM_TWICE = range(3, 11), 2
#: A term is searched with one edit from this length on, with two from the other.
ONE_EDIT, TWO_EDITS = 5, 10

#: Words and marks that surround a quoted or discussed term, and words that address someone.
REPORTING = frozenset("said says say called calls wrote writes quote quoted quotes word words term terms title titled means meaning reported according insult insults slur dit dite mot mots sagte wort dijo palabra".split())
ADDRESS = frozenset("you your you're youre u ur yourself tu toi te vous votre du dich dir ihr euch tú ti usted eres".split())
QUOTES = "\"'`«»“”„‘’"

_STRIP = ".,;:!?()[]{}<>*_~…-" + QUOTES


class Trie:
    """Terms by letters; a node's number says which term ends there."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        self.terms = terms
        for i, t in enumerate(terms):
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = i


class LevenshteinAutomaton:
    """Accepts the strings within ``edits`` insertions, deletions and substitutions of a word.

    A state is the set of (position, errors) as a row of least errors by position.
    """

    def __init__(self, word: str, edits: int):
        self.word, self.edits = word, edits

    def start(self) -> tuple[int, ...]:
        return tuple(min(i, self.edits + 1) for i in range(len(self.word) + 1))

    def step(self, state: tuple[int, ...], c: str) -> tuple[int, ...]:
        most = self.edits + 1
        row = [min(state[0] + 1, most)]
        for i, w in enumerate(self.word):
            row.append(min(state[i] + (w != c), row[i] + 1, state[i + 1] + 1, most))
        return tuple(row)

    def accepts(self, state: tuple[int, ...]) -> bool:
        return state[-1] <= self.edits

    def alive(self, state: tuple[int, ...]) -> bool:
        return min(state) <= self.edits


def intersect(trie: Trie, automaton: LevenshteinAutomaton) -> Iterator[tuple[int, int]]:
    """(term number, edits) of the trie's terms that the automaton accepts."""
    stack = [(trie.root, automaton.start())]
    while stack:
        node, state = stack.pop()
        for c, child in node.items():
            if c == "":
                if automaton.accepts(state):
                    yield child, state[-1]
            elif automaton.alive(new := automaton.step(state, c)):
                stack.append((child, new))


class Lexicon:
    """The best term for a word, if any; stems are written with a star.

    ``harmless`` words are never taken as misspellings.  Before its automaton runs, a word must share a piece with a term: of e + 1
    pieces of a term one survives e edits, moved by e places at most.
    """

    def __init__(self, terms: list[str], harmless: frozenset[str] = frozenset()):
        self.terms, self.harmless = terms, harmless
        self.exact = {t: i for i, t in enumerate(terms) if not t.endswith("*")}
        self.stems = {t[:-1]: i for i, t in enumerate(terms) if t.endswith("*")}
        self.stem_sizes = sorted({len(t) for t in self.stems}, reverse=True)
        words = list(self.exact)
        self.trie = Trie(words)
        pieces = {t[k * len(t) // (e + 1) : (k + 1) * len(t) // (e + 1)] for t in words if (e := edits_for(t)) for k in range(e + 1)}
        self.hint = re.compile("|".join(sorted(map(re.escape, pieces)))) if pieces else None
        self.lengths = {n for t in words for n in range(len(t) - edits_for(t), len(t) + edits_for(t) + 1)}

    def find(self, word: str) -> tuple[int, int] | None:
        """(term number, edits): the word itself, its longest stem, else the term with the fewest edits, the first of equals."""
        if (i := self.exact.get(word)) is not None:
            return i, 0
        for n in self.stem_sizes:
            if len(word) > n and (i := self.stems.get(word[:n])) is not None:
                return i, 0
        if len(word) not in self.lengths or not self.hint or not self.hint.search(word) or word in self.harmless:
            return None
        found = [(e, i) for i, e in intersect(self.trie, LevenshteinAutomaton(word, 2 if len(word) >= TWO_EDITS - 2 else 1)) if 0 < e <= edits_for(self.trie.terms[i])]
        return (self.exact[self.trie.terms[min(found)[1]]], min(found)[0]) if found else None


def edits_for(term: str) -> int:
    return 2 if len(term) >= TWO_EDITS else 1 if len(term) >= ONE_EDIT else 0


NONE, REPORT, ADDRESSEE = 0, 1, 2
#: Evidence of a text, in this order; counts are damped by log(1 + n), stems are held against a usual rate.
FEATURES = ("word", "misspelled", "quoted", "addressed", "stem", "stems")
#: Words with a stem of the lexicon that a harmless text of a thousand words may hold.
USUAL = 0.5


def word_info(lexicon: Lexicon) -> Callable[[list[bytes]], np.ndarray]:
    """For each word: its term (-1: none), edits and whether that is a stem, its part in a context, quotation marks at its ends."""

    def compute(words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words), [("term", np.int32), ("edits", np.int8), ("stem", np.bool_), ("part", np.int8), ("opens", np.bool_), ("closes", np.bool_)])
        out["term"] = -1
        for k, raw in enumerate(words):
            w = raw.decode(errors="replace").lower()
            bare = w.strip(_STRIP)
            if bare in REPORTING:
                out["part"][k] = REPORT
            elif bare in ADDRESS:
                out["part"][k] = ADDRESSEE
            if w[0] in QUOTES or w[-1] in QUOTES or w.rstrip(".,;:!?")[-1:] in QUOTES:
                head, tail = w[: len(w) - len(w.lstrip(_STRIP))], w[len(w.rstrip(_STRIP)) :]
                out["opens"][k], out["closes"][k] = any(c in QUOTES for c in head), any(c in QUOTES for c in tail)
            if found := lexicon.find(bare):
                out["term"][k], out["edits"][k] = found
                out["stem"][k] = lexicon.terms[found[0]].endswith("*")
        return out

    return compute


def evidence(info: np.ndarray) -> np.ndarray:
    """The features of one text from its words' info."""
    n = dict.fromkeys(FEATURES, 0.0)
    for i in np.flatnonzero(info["term"] >= 0):
        near = info[max(0, i - WINDOW) : i + WINDOW + 1]
        before, after = info[max(0, i - WINDOW) : i + 1], info[i : i + WINDOW + 1]
        # a span of quotation marks around the term, or words that report it and none that address someone
        marked = before["opens"].any() and after["closes"].any() and not (before["closes"][:-1].any() and not before["opens"][-1])
        addressed = (near["part"] == ADDRESSEE).any()
        quoted_here = marked or ((near["part"] == REPORT).any() and not addressed)
        n["quoted" if quoted_here else "stem" if info["stem"][i] else "misspelled" if info["edits"][i] else "word"] += 1
        n["addressed"] += addressed and not quoted_here
    usual = USUAL * len(info) / 1000
    n["stems"] = max(0.0, n["stem"] - 1 - usual)
    return np.log1p([n[f] for f in FEATURES])


@dataclass(frozen=True)
class ToxicityModel:
    terms: list[str]
    harmless: frozenset[str]
    weights: np.ndarray
    bias: float

    def lexicon(self) -> Lexicon:
        return Lexicon(self.terms, self.harmless)


#: Where learning starts and what it is drawn to: a plain word speaks for abuse, one stem or a quotation hardly.
PRIOR_WEIGHTS, PRIOR_BIAS, PULL = np.array([7.0, 6.5, 0.5, 1.0, 0.5, 2.0]), -2.5, 0.01


def bare_words(text: bytes) -> Counter:
    """Words of letters, in lower case, without marks at their ends."""
    words = Counter(text.split())
    out: Counter = Counter()
    for raw, n in words.items():
        w = raw.decode(errors="replace").lower().strip(_STRIP + "#$%&|")
        if len(w) >= STEM[0] and w.isalpha():
            out[w] += n
    return out


def stems_of(bag: Counter) -> set[str]:
    """Stems of which the text holds two words or more."""
    count: Counter = Counter()
    for w, n in bag.items():
        for k in STEM:
            if k < len(w):
                count[w[:k] + "*"] += n
    return {s for s, n in count.items() if n >= STEM_TWICE}


def learn_terms(bags: list[Counter], y: np.ndarray) -> list[str]:
    """Words and stems that mark label 1, each chosen for the marked texts that it adds to those before."""
    marked, plain = [i for i, label in enumerate(y) if label], [i for i, label in enumerate(y) if not label]
    terms_of = [b.keys() | stems_of(b) for b in bags]
    holders: dict[str, set] = {}
    for i in marked:
        for t in terms_of[i]:
            holders.setdefault(t, set()).add(i)
    holders = {t: x for t, x in holders.items() if len(x) >= MIN_TEXTS}
    against = Counter(t for i in plain for t in terms_of[i] if t in holders)
    rate = lambda t: (len(holders[t]) / len(marked), against[t] / len(plain))
    holders = {t: x for t, x in holders.items() if (r := rate(t))[0] >= PRECISION * (r[0] + r[1])}
    open_texts, terms = set(marked), []
    left = dict(holders)
    while left and len(terms) < TERMS:
        # new texts less twice the harm; of equals a word before a stem, and the longest
        best = max(left, key=lambda t: (len(left[t] & open_texts) / len(marked) - 2 * rate(t)[1], not t.endswith("*"), len(t), t))
        if len(left[best] & open_texts) < max(MIN_TEXTS, GAIN * len(marked)):
            break
        open_texts -= left.pop(best)
        terms.append(best)
    # words that are nearly as common as the commonest one, though their texts are covered
    most = max((len(holders[t]) for t in terms if not t.endswith("*")), default=0)
    alike = [t for t, x in left.items() if not t.endswith("*") and most and len(x) >= max(ALIKE * most, MIN_TEXTS)]
    return terms + sorted(alike, key=lambda t: (-len(holders[t]), t))[: TERMS - len(terms)]


def fit(texts: list[bytes], labels: list[int]) -> ToxicityModel:
    y = np.array(labels, np.float64)
    if len(set(labels)) < 2:
        return ToxicityModel([], frozenset(), PRIOR_WEIGHTS, PRIOR_BIAS)
    bags = [bare_words(t) for t in texts]
    terms = learn_terms(bags, y)
    lexicon = Lexicon(terms)
    ordinary = {w for b, label in zip(bags, y, strict=True) if not label for w in b}
    harmless = frozenset(w for w in ordinary if w not in lexicon.exact and (f := lexicon.find(w)) and f[1])
    compute = word_info(Lexicon(terms, harmless))
    x = np.array([evidence(compute(t.split())) for t in texts])
    w, b = PRIOR_WEIGHTS.copy(), PRIOR_BIAS
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    for _ in range(3000):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        back = weight * (p - y)
        w -= 1.0 * (x.T @ back + PULL * (w - PRIOR_WEIGHTS))
        b -= 1.0 * (back.sum() + PULL * (b - PRIOR_BIAS))
    return ToxicityModel(terms, harmless, w, float(b))


def maker(get: Callable[[], ToxicityModel], threshold: float, spans: bool) -> Callable[[], Callable]:
    def make() -> Callable:
        model = get()
        table = WordTable(word_info(model.lexicon()))
        nothing = 1 / (1 + np.exp(-model.bias))

        def run(texts: list) -> dict:
            words = [(t or b"").split() for t in texts]
            off = offsets(words)
            info = table(flat(words))
            score = np.full(len(texts), nothing)
            hits = np.searchsorted(off, np.flatnonzero(info["term"] >= 0), side="right") - 1
            terms: list = [[] for _ in texts]
            for i in np.unique(hits):
                mine = info[off[i] : off[i + 1]]
                score[i] = 1 / (1 + np.exp(-(evidence(mine) @ model.weights + model.bias)))
                if spans:
                    terms[i] = [f"{k}:{model.terms[mine['term'][k]]}:{mine['edits'][k]}" for k in np.flatnonzero(mine["term"] >= 0)]
            out: dict = {"score": score, "predicted": (score >= threshold).astype(np.int32)}
            return out | ({"hits": terms} if spans else {})

        return run

    return make


def toxicity_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", keep: list[str] | None = None, threshold: float = 0.7, per_label: int = PER_LABEL, spans: bool = True) -> DataFrame:
    """Score (0 to 1, higher: label 1 likelier), prediction and held-out flag of each whole text.

    ``hits`` lists word number, term and edits of each hit.  Learns from
    ``per_label`` rows of each label at most, never from held-out ones, and from
    the text alone.  Null, empty and hit-free texts get the score of the bias;
    without rows of both labels the lexicon is empty.  A null id is not held out.
    Repeated rows are scored each, very long texts whole (in the sample they count
    against its budget of bytes); other columns stay, except those named as the
    results.  No shuffle of texts.
    """
    texts, y = training_texts(docs, labels, label, doc_id, text, per_label)
    shared = docs.sparkSession.sparkContext.broadcast(fit(texts, y))
    fields = "score double, predicted int" + (", hits array<string>" if spans else "")
    out = annotate(docs, text, maker(lambda: shared.value, threshold, spans), fields, keep)
    return out.withColumn("held_out", held_out(F.col(quoted(doc_id))))
