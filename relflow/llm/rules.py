"""Quality rules: lines are judged first, failing lines removed, and a document that loses too much goes."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from relflow.llm.batches import HASHED_WORDS, WordTable, annotate, flat, grams, hash_words, mix, offsets, per_text, starts

SYMBOLS = b"#*$%&|<>"
SPACES = b"\t\n\x0b\x0c\r "
#: Phrases of page furniture; a short line with one of them is boilerplate.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "use cookies",
    "accept cookies", "enable javascript", "sign in", "log in", "subscribe to", "newsletter", "click here", "read more",
    "back to top", "skip to content", "share this", "follow us", "lorem ipsum", "page not found",
)
_BOILER = re.compile("|".join(p.replace(" ", r"\s+") for p in BOILERPLATE).encode())
_NAV = re.compile(rb"\s(?:\||>|\xc2\xbb|\xe2\x80\xba|\xc2\xb7|\xe2\x80\xa2)\s")


@dataclass(frozen=True)
class Rules:
    """Parameters.  A line fails if one rule catches it."""

    window: int = 8
    min_words: int = 20
    max_repeat_percent: int = 30
    #: Navigation: this many separators, and no more than so many words between them on average.
    nav_separators: int = 3
    nav_words: float = 4.0
    #: Boilerplate phrases count in lines of up to so many words.
    boilerplate_words: int = 25
    #: Punctuation: symbols, or marks of shouting, for each word of the line.
    max_symbols_per_word: float = 0.5
    max_shouts_per_word: float = 0.5
    #: A longer line that holds no letter at all is noise.
    min_letters_percent: int = 25
    #: Repetition: a line of so many words, too few of them different.
    repeat_words: int = 10
    min_distinct_percent: int = 30
    #: The document goes if failing lines hold more than this part of its words.
    max_lost_percent: int = 50


def judge_line(line: bytes, n_words: int, rules: Rules) -> str | None:
    """The rule that the line breaks, or None."""
    separators = len(_NAV.findall(line)) if b" " in line else 0
    if separators >= rules.nav_separators and n_words - separators <= rules.nav_words * (separators + 1) and not line.startswith(b"|"):
        return "navigation"
    symbols = len(line) - len(line.translate(None, b"#*$%&<>"))
    if symbols > rules.max_symbols_per_word * n_words:
        return "punctuation"
    if line.count(b"!") + line.count(b"?") > rules.max_shouts_per_word * max(n_words, 2):
        return "punctuation"
    if n_words >= rules.repeat_words and 100 * len(set(line.split())) < rules.min_distinct_percent * n_words:
        return "repetition"
    if n_words <= rules.boilerplate_words and _BOILER.search(line.lower()):
        return "boilerplate"
    letters = len(line) - len(line.translate(None, bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))))
    return "punctuation" if len(line) >= 40 and 100 * letters < rules.min_letters_percent * len(line) else None


def clean(text: bytes, rules: Rules) -> tuple[bytes, int, int]:
    """The text without failing lines, words lost to them, and lines equal to an earlier line."""
    seen: set = set()
    kept, lost, dup = [], 0, 0
    for line in text.split(b"\n"):
        n = len(line.split())
        if not n:
            kept.append(line)
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        if judge_line(line.strip(SPACES), n, rules):
            lost += n
        else:
            kept.append(line)
    return b"\n".join(kept), lost, dup


def maker(rules: Rules, with_text: bool) -> Callable[[], Callable]:
    def make() -> Callable:
        table = WordTable(hash_words, HASHED_WORDS)

        def run(texts: list) -> dict:
            texts = [t or b"" for t in texts]
            words = [t.split() for t in texts]
            off = offsets(words)
            n_words = np.diff(off)
            h = table(flat(words))
            at, owner = starts(off, rules.window)
            repeated = np.zeros(len(h) + 1, np.int64)
            if len(at):
                g = grams(h, rules.window)[at] ^ mix(owner.astype(np.uint64) + np.uint64(1))
                _, first, count = np.unique(g, return_inverse=True, return_counts=True)
                twice = at[count[first] > 1]
                np.add.at(repeated, twice, 1)
                np.add.at(repeated, twice + rules.window, -1)
            repeats = per_text((np.cumsum(repeated[:-1]) > 0).astype(np.int64), off)
            cleaned = [clean(t, rules) for t in texts]
            spaces = [len(t) - len(t.translate(None, SPACES)) for t in texts]
            points = [len(t.decode(errors="replace")) for t in texts]
            failed = (n_words < rules.min_words) | (100 * repeats > rules.max_repeat_percent * n_words)
            lost = np.array([x[1] for x in cleaned], np.int64)
            out = {
                "n_words": n_words,
                "word_chars": np.array(points, np.int64) - np.array(spaces, np.int64),
                "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64),
                "n_dup_lines": np.array([x[2] for x in cleaned], np.int64),
                "n_repeat_words": repeats,
                "base_failed": failed,
                "n_lost_words": lost,
                "kept": ~failed & (100 * lost <= rules.max_lost_percent * n_words),
            }
            if with_text:
                out["clean_text"] = [x[0].decode(errors="replace") for x in cleaned]
            return out

        return run

    return make


FIELDS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, n_lost_words bigint, kept boolean"


def quality_rules(docs: DataFrame, text: str = "text", keep: list[str] | None = None, rules: Rules | None = None, with_text: bool = True) -> DataFrame:
    """Counts, verdict and ``clean_text`` (the text without failing lines) of each document.

    A window of 8 words found twice in a text makes its words repeats; a line
    with a word that equals an earlier one is a duplicate (these lines are
    counted, not removed).  ``kept`` is false if the base test fails (under 20
    words, or over 30 % repeats) or failing lines hold over half of the words.
    Null counts as empty: no words, not kept.  Bytes that aren't UTF-8 count as the
    replacement characters that they are read as.  Very long texts are judged whole.  Rows with one id are judged each
    for itself; other columns stay as they are, except those named as the
    results.  An empty table gives an empty table.  No shuffle.
    """
    rules = rules or Rules()
    return annotate(docs, text, maker(rules, with_text), FIELDS + (", clean_text string" if with_text else ""), keep)
