"""SentencePiece encoding and decoding of merge-type vocabularies.

Adjacent symbol pairs that make a piece wait in an agenda ordered by score;
the best pair is merged first, the leftmost of equals.  No piece of such a
vocabulary holds the space mark after another character, so merges never
cross from a word to the next and each chunk of spaces and a word is encoded
once a worker.  New chunks are checked, batch by batch, against the library.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import operator
import re
from collections.abc import Callable

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame

from relflow.llm.batches import annotate, held

MARK = "▁"
#: Chunks that one generation of a worker's cache holds; two generations live at a time.
CACHE = 300_000
#: Chunks longer than this are not cached.
CACHED_CHARS = 48

#: More places than a text has.
PLACES = 1 << 40
#: Symbols up to which the agenda is a list, and the rank there of a pair that makes no piece.
SHORT, NO_RANK = 32, 1 << 60

_CHUNK = re.compile(" *[^ ]+| +")


class PieceModel:
    """Pieces, scores and the merge agenda of one model file."""

    def __init__(self, path: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.texts = [sp.id_to_piece(i) for i in range(n)]
        self.byte = [sp.id_to_piece(i) if sp.is_byte(i) else None for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.texts[i]: i for i in normal}
        by_score = {x: k for k, x in enumerate(sorted({sp.get_score(i) for i in normal}, reverse=True))}
        self.ranks = {self.texts[i]: by_score[sp.get_score(i)] for i in normal}
        self.bytes = {int(t[3:5], 16): i for i, t in enumerate(self.byte) if t}
        self.unknown = sp.unk_id()
        if any(MARK in t.lstrip(MARK) for t in self.ids):
            raise ValueError("pieces hold the space mark inside: words can't be encoded one by one")
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback")

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of spaces and one word, by the agenda."""
        symbols = list(chunk.replace(" ", MARK))
        symbols = self.merge_short(symbols) if len(symbols) <= SHORT else self.merge_long(symbols)
        out: list[int] = []
        for s in symbols:
            if (k := self.ids.get(s)) is not None:
                out.append(k)
            else:
                out.extend(self.bytes[b] for b in s.encode())
        return out

    def merge_short(self, symbols: list[str]) -> list[str]:
        """The agenda as a list by place: of few pairs the best is found sooner than a heap is kept."""
        get = self.ranks.get
        agenda = list(map(get, map(operator.add, symbols, symbols[1:]), itertools.repeat(NO_RANK)))
        while agenda and (rank := min(agenda)) != NO_RANK:
            i = agenda.index(rank)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del agenda[i]
            if i:
                agenda[i - 1] = get(symbols[i - 1] + symbols[i], NO_RANK)
            if i < len(agenda):
                agenda[i] = get(symbols[i] + symbols[i + 1], NO_RANK)
        return symbols

    def merge_long(self, symbols: list[str]) -> list[str]:
        """The agenda as a heap, each symbol linked to its neighbours."""
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        # an entry is the merged piece's rank by score, then the place of its left symbol
        get = self.ranks.get
        agenda = [r * PLACES + i for i in range(n - 1) if (r := get(symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            rank, i = divmod(heapq.heappop(agenda), PLACES)
            j = right[i]
            if j < 0 or not symbols[i] or get(merged := symbols[i] + symbols[j]) != rank:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = merged, ""
            right[i] = after = right[j]
            if after >= 0:
                left[after] = i
                if (r := get(merged + symbols[after])) is not None:
                    heapq.heappush(agenda, r * PLACES + i)
            if (before := left[i]) >= 0 and (r := get(symbols[before] + merged)) is not None:
                heapq.heappush(agenda, r * PLACES + before)
        return [s for s in symbols if s]

    def decode_ids(self, ids: list[int]) -> str:
        """Text of ids that spell whole characters, spaces as they are."""
        if not any(map(self.byte.__getitem__, ids)):
            return "".join(map(self.texts.__getitem__, ids)).replace(MARK, " ")
        out = bytearray()
        for i in ids:
            t = self.byte[i]
            out += bytes([int(t[3:5], 16)]) if t else self.texts[i].replace(MARK, " ").encode()
        return out.decode(errors="replace")

    def check(self, chunks: list[str], ids: list[list[int]]) -> None:
        """Raises if the library encodes a chunk differently."""
        theirs = self.library.encode([c[1:] for c in chunks], num_threads=1)
        # the library puts the first mark before any text but the empty one
        theirs = [x if c != " " else [self.library.piece_to_id(MARK)] for c, x in zip(chunks, theirs, strict=True)]
        for c, a, b in zip(chunks, ids, theirs, strict=True):
            if a != b:
                raise AssertionError(f"the agenda gives {a} for {c!r}, the library {b}")


def chunks_of(text: str) -> list[str]:
    """Chunks of the text: a space first, then each run of spaces with its word; the mark itself counts as a space."""
    return _CHUNK.findall(" " + (text.replace(MARK, " ") if MARK in text else text)) if text else []


class PieceCache:
    """chunk -> ids as text, in two generations; only chunks that decode to themselves are kept."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.young: dict = {}
        self.old: dict = {}

    def __call__(self, chunks: list[str]) -> tuple[list[str], dict[str, str]]:
        """The ids of each chunk as text, and what those chunks decode to that don't decode to themselves."""
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        young, old, model = self.young, self.old, self.model
        missing = set(chunks).difference(young)
        new = []
        for c in missing:
            if (known := old.get(c)) is not None:
                young[c] = known
            else:
                new.append(c)
        ids = [model.encode_chunk(c) for c in new]
        model.check(new, ids)
        once: dict = {}
        backs: dict = {}
        for c, x in zip(new, ids, strict=True):
            if (back := model.decode_ids(x)) != c:
                backs[c] = back
            (young if len(c) <= CACHED_CHARS and back == c else once)[c] = ",".join(map(str, x))
        if once:
            return [young.get(c) or once[c] for c in chunks], backs
        return list(map(young.__getitem__, chunks)), backs


def cache_of(path: str) -> PieceCache:
    """The worker's cache for a model: it outlives a task."""
    return held(f"pieces {path}", lambda: PieceCache(PieceModel(path)))


def maker(path: str | None, with_ids: bool) -> Callable[[], Callable]:
    def make() -> Callable:
        cache = cache_of(path or public_tokenizers.path("piece_bpe_32k.model"))

        def run(texts: list) -> dict:
            chunks = [chunks_of((t or b"").decode(errors="replace")) for t in texts]
            found, backs = cache([c for x in chunks for c in x])
            ids, counts, decoded, at = [], [], [], 0
            for x in chunks:
                ids.append(",".join(found[at : at + len(x)]))
                at += len(x)
                counts.append(ids[-1].count(",") + 1 if x else 0)
                decoded.append("".join([backs.get(c, c) for c in x] if backs else x)[1:])
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            out: dict = {"n_tokens": np.array(counts, np.int64), "ids_sha256": [sha(s) for s in ids], "decoded_sha256": [sha(s) for s in decoded]}
            if with_ids:
                out["ids"] = [[int(i) for i in s.split(",")] if s else [] for s in ids]
                out["decoded"] = decoded
            return out

        return run

    return make


def encode_pieces(docs: DataFrame, text: str = "text", keep: list[str] | None = None, model: str | None = None, with_ids: bool = True) -> DataFrame:
    """Ids of each whole text, without begin or end ids, and the text decoded from them.

    ``n_tokens``, ``ids_sha256`` (of decimal ids joined by commas) and
    ``decoded_sha256`` (UTF-8); with ``with_ids`` also ``ids`` and ``decoded``.
    ``model`` is a path on the workers; the default is the 32k public model.
    Null and empty texts give no ids.  Bytes that aren't UTF-8 are read as replacement
    characters.  Repeated rows are encoded each; other
    columns stay, except those named as the results.  No shuffle.
    """
    fields = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return annotate(docs, text, maker(model, with_ids), fields, keep)
