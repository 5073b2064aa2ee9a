"""Token counts by a two-tier lookup on the map side.

A broadcast table holds the lengths of frequent pre-tokens; a pre-token that
it lacks is encoded once and kept in the worker's cache.  No pre-token is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from relflow.functions.lambdas import quoted
from relflow.llm.batches import annotate

#: Entries of the broadcast table (some 2 MB), the pre-tokens that a sketch tracks to choose them, and partial sketches.
TABLE, TRACKED, SKETCHES = 40_000, 100_000, 64
#: Pre-tokens that one generation of a worker's cache holds, and their length.
CACHE, CACHED_CHARS = 300_000, 48
#: The byte-level pattern with its white space spelled out, as the library has it.
_WS = r"\t-\r \x85\xa0  -     　"
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Much the same pattern for the search of frequent pre-tokens, where a difference costs a cache entry only.
_PIECE = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
#: Beyond these blocks the Unicode versions of pattern engines differ; such texts are split by the library.
_ODD = regex.compile(r"[^\u0000-՗ -⁰₠-₿←-⏿─-⟿　-ヿ一-龥가-힣＀-￯\U0001f300-\U0001f64f]")


class Counts:
    """A worker's tokenizer, broadcast table and cache."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only byte-level vocabularies without a normalizer are counted by pre-token")
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.young: dict = {}
        self.old: dict = {}

    def split(self, text: str) -> list[str]:
        if _ODD.search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return _SPLIT.findall(text)

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and how many special tokens stand between them."""
        if self.special is None or not self.special.search(text):
            return self.split(text), 0
        parts = self.special.split(text)
        return [x for p in parts for x in self.split(p)], len(parts) - 1

    def lengths(self, pretokens: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(pretokens, add_special_tokens=False)]

    def lookup(self, frequent: dict, pretokens: list[str]) -> dict:
        """Lengths of distinct pre-tokens that ``frequent`` lacks."""
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        missing, new, out = set(pretokens).difference(frequent), [], {}
        for p in missing:
            n = self.young.get(p)
            if n is None and (n := self.old.get(p)) is not None:
                self.young[p] = n
            if n is None:
                new.append(p)
            else:
                out[p] = n
        for p, n in zip(new, self.lengths(new), strict=True):
            out[p] = n
            if len(p) <= CACHED_CHARS:
                self.young[p] = n
        return out


_WORKER: dict[str, Counts] = {}


def counts_of(path: str) -> Counts:
    if path not in _WORKER:
        _WORKER[path] = Counts(path)
    return _WORKER[path]


def frequent_lengths(docs: DataFrame, text: str, path: str) -> dict[str, int]:
    """Lengths of the commonest pre-tokens of all texts; they only decide which tier answers.

    Each task counts its pre-tokens in a frequent-items sketch of bounded size;
    sketches, not pre-tokens, are shuffled and merged in two rounds.
    """
    found = F.explode(F.regexp_extract_all(F.col(quoted(text)).cast("string"), F.lit(_PIECE), F.lit(0)))
    words = docs.select(found.alias("w")).where(F.length("w") <= CACHED_CHARS).select("w", F.pmod(F.spark_partition_id(), F.lit(SKETCHES)).alias("part"))
    # a table without texts still has one sketch
    words = words.unionByName(docs.sparkSession.range(1).select(F.lit(" ").alias("w"), F.lit(0).alias("part")))
    partial = words.groupBy("part").agg(F.expr(f"approx_top_k_accumulate(w, {TRACKED})").alias("sketch"))
    # grouped, so that merge tasks without rows yield no sketch
    merged = partial.groupBy(F.pmod("part", F.lit(1)).alias("all")).agg(F.expr(f"approx_top_k_combine(sketch, {TRACKED})").alias("sketch"))
    rows = merged.select(F.expr(f"inline(approx_top_k_estimate(sketch, {TABLE}))")).select("item").collect()
    common = [r["item"] for r in rows]
    return dict(zip(common, counts_of(path).lengths(common), strict=True))


def maker(path: str, table: Callable[[], dict], limit: int) -> Callable[[], Callable]:
    def make() -> Callable:
        counts, frequent = counts_of(path), table()

        def run(texts: list) -> dict:
            texts = [t or b"" for t in texts]
            split = [counts.pretokens(t.decode(errors="replace")) for t in texts]
            rest = counts.lookup(frequent, [p for x, _ in split for p in x])
            both = _Tiers(frequent, rest)
            n = np.fromiter((sum(map(both.__getitem__, x)) + s for x, s in split), np.int64, len(texts))
            return {"n_bytes": np.fromiter(map(len, texts), np.int64, len(texts)), "n_tokens": n, "over_limit": n > limit}

        return run

    return make


class _Tiers(dict):
    """The batch's misses, backed by the broadcast table."""

    def __init__(self, frequent: dict, rest: dict):
        super().__init__(rest)
        self.frequent = frequent

    def __missing__(self, p: str) -> int:
        self[p] = n = self.frequent[p]
        return n


def token_counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None, tokenizer: str | None = None, limit: int = 1024) -> DataFrame:
    """``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of each whole text.

    Counts are those of the tokenizers library without added special tokens;
    special strings in a text count as one token.  ``tokenizer`` is a path to a
    byte-level vocabulary.  Null counts as empty: 0 bytes, 0 tokens.  Bytes that
    aren't UTF-8 are read as replacement characters, but counted as they are.
    Repeated rows are counted each; other columns stay, except those named as the
    results.  Only sketches of bounded size are shuffled, no text and no count.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, text, path))
    return annotate(docs, text, maker(path, lambda: shared.value, limit), "n_bytes bigint, n_tokens bigint, over_limit boolean", keep)


def iter_pretokens(texts: list[str], path: str) -> Iterator[str]:
    """Pre-tokens of texts on the driver, for tests."""
    for t in texts:
        yield from counts_of(path).pretokens(t)[0]
