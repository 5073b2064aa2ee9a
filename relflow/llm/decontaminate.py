"""Benchmark decontamination by winnowing.

Of every window of k-gram hashes the least is kept, in documents and benchmark
items alike, so each shared span of ``span`` words shares a fingerprint.  Equal
fingerprints are joined and extended word by word on both sides; a run of
``span`` words or more is a hit.  Items shorter than ``span`` words are one
window each and found by hashes of their own length.

Benchmark fingerprints go to the workers in blocks of bounded size; a larger
benchmark is joined block after block, with the state written in between.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relflow.functions.lambdas import quoted
from relflow.llm.batches import HASHED_WORDS, WordTable, annotate, flat, grams, hash_words, offsets, starts
from relflow.sources.scratch import written

SPAN, GRAM = 8, 4
#: Bytes of benchmark text in one broadcast block; an item that is larger is a block of its own.
BLOCK_BYTES = 16_000_000

#: Bytes that separate words (after lower-casing) become spaces.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_U = np.uint64


def words_of(text: bytes | None) -> list[bytes]:
    """Words in lower case: runs of ASCII letters and digits and of all characters beyond ASCII."""
    return (text or b"").translate(_TABLE).split()


def winnow(h: np.ndarray, off: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes): of each window of span - k + 1 k-grams of one text the least, the last of equals."""
    w = span - k + 1
    g = grams(h, k)
    at, _ = starts(off, span)
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, _U)
    best, where = g[at], at
    for j in range(1, w):
        other = g[at + j]
        better = other <= best
        best, where = np.where(better, other, best), np.where(better, at + j, where)
    kept = np.unique(where)
    return kept, g[kept]


@dataclass(frozen=True)
class Block:
    """Fingerprints of some items, sorted by hash, and the items' words as hashes."""

    ids: list[str | None]
    words: list[np.ndarray]
    prints: np.ndarray
    item: np.ndarray
    place: np.ndarray
    bits: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def block_of(items: list[tuple], span: int, k: int) -> Block:
    """Fingerprints of (id as text, text) items."""
    lists = [words_of(t) for _, t in items]
    words = [hash_words(x) for x in lists]
    off = offsets(lists)
    h = np.concatenate([np.empty(0, _U), *words])
    at, prints = winnow(h, off, span, k)
    item = np.searchsorted(off, at, side="right") - 1
    order = np.argsort(prints, kind="stable")
    bits = np.zeros(1 << max(16, int(len(prints)).bit_length() + 3), bool)
    bits[prints & _U(len(bits) - 1)] = True
    short: dict = {}
    for n in {len(x) for x in lists if 0 < len(x) < span}:
        mine = np.array([i for i, x in enumerate(lists) if len(x) == n])
        g = np.array([grams(words[i], n)[0] for i in mine], _U)
        o = np.argsort(g, kind="stable")
        short[n] = (g[o], mine[o])
    return Block([i for i, _ in items], words, prints[order], item[order], (at - off[item])[order], bits, short)


def matches(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index in values, index in the sorted table) of all equal pairs."""
    lo, hi = np.searchsorted(table, values, "left"), np.searchsorted(table, values, "right")
    n = hi - lo
    left = np.repeat(np.arange(len(values)), n)
    return left, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def runs(a: np.ndarray, b: np.ndarray, span: int) -> list[tuple[int, int]]:
    """(start, end) of runs of ``span`` or more equal places."""
    same = np.concatenate([[False], a == b, [False]])
    edges = np.flatnonzero(same[1:] != same[:-1])
    return [(s, e) for s, e in zip(edges[::2], edges[1::2], strict=True) if e - s >= span]


def find(h: np.ndarray, off: np.ndarray, block: Block, span: int, k: int) -> list[tuple[int, int, int, int]]:
    """(text, start, end, item) of all hits, in words of the text."""
    hits: set = set()
    at, prints = winnow(h, off, span, k)
    near = block.bits[prints & _U(len(block.bits) - 1)]
    at, prints = at[near], prints[near]
    left, right = matches(prints, block.prints)
    doc = np.searchsorted(off, at[left], side="right") - 1
    # a text and an item laid over each other at one shift are compared once, over their whole overlap
    for d, i, shift in {(d, i, s) for d, i, s in zip(doc.tolist(), block.item[right].tolist(), (at[left] - block.place[right]).tolist(), strict=True)}:
        item = block.words[i]
        a, b = max(off[d], shift), min(off[d + 1], shift + len(item))
        hits.update((d, int(a - off[d] + s), int(a - off[d] + e), i) for s, e in runs(h[a:b], item[a - shift : b - shift], span))
    for n, (table, items) in block.short.items():
        at, owner = starts(off, n)
        g = grams(h, n)[at] if len(at) else np.empty(0, _U)
        left, right = matches(g, table)
        hits.update((d, int(p - off[d]), int(p - off[d]) + n, i) for d, p, i in zip(owner[left].tolist(), at[left].tolist(), items[right].tolist(), strict=True))
    return sorted(hits)


def maker(get: Callable[[], Block], span: int, k: int) -> Callable[[], Callable]:
    def make() -> Callable:
        block, table = get(), WordTable(hash_words, HASHED_WORDS)

        def run(texts: list, spans: list, items: list) -> dict:
            words = [words_of(t) for t in texts]
            off = offsets(words)
            spans, items = [list(x or ()) for x in spans], [set(x or ()) for x in items]
            for d, s, e, i in find(table(flat(words)), off, block, span, k):
                spans[d].append({"start": s, "end": e})
                if block.ids[i] is not None:
                    items[d].add(block.ids[i])
            return {"n_words": np.diff(off), "spans": [merged(x) for x in spans], "items": [sorted(x) for x in items]}

        return run

    return make


def merged(spans: list[dict]) -> list[dict]:
    """Spans in order, overlapping ones joined."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda x: (x["start"], x["end"])):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


FIELDS = "n_words bigint, spans array<struct<start: bigint, end: bigint>>, items array<string>"


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, span: int = SPAN, k: int = GRAM, block_bytes: int = BLOCK_BYTES, min_items: int = 2) -> DataFrame:
    """Of each document ``n_words``, hit ``spans`` (in words), ``items`` (ids as text), ``n_hit``, ``n_items``, ``contaminated``.

    Null and empty texts have no words and no hits.  Items without words match
    nothing; those without an id make hits but no ``items``; items with one id
    count once.  Repeated documents are searched each; other columns stay, except
    those named as the results.  Documents are never shuffled.
    """
    if not 0 < k <= span:
        raise ValueError("k must be from 1 to span")
    spark = docs.sparkSession
    items = benchmark.select(F.col(quoted(item_id)).cast("string").alias("id"), F.col(quoted(item_text)).cast("string").cast("binary").alias("t")).where(F.octet_length("t") > 0).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "spans", "items", "n_hit", "n_items", "contaminated")]
    state = docs.withColumns({"spans": F.expr("cast(null as array<struct<start: bigint, end: bigint>>)"), "items": F.expr("cast(null as array<string>)")})
    text_after = text if text in kept else None
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("id", "t"), F.lit(n)) == b).collect() if n > 1 else items.collect()
        shared = spark.sparkContext.broadcast(block_of([(r["id"], bytes(r["t"])) for r in rows], span, k))
        last = b == n - 1
        carry = kept if last or text_after else [*kept, text]
        state = annotate(state, text, maker(lambda s=shared: s.value, span, k), FIELDS, carry, ["spans", "items"])
        if not last:
            state = written(state, "decontaminate")
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return state.withColumns({"n_hit": hit, "n_items": F.size("items").cast("bigint")}).withColumn("contaminated", F.col("n_items") >= min_items)


def items_digest(items: object) -> object:
    """SHA-256 of the sorted ids, comma-joined."""
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


def digest_of(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
