"""Texts in Arrow batches: each input row gives one output row, in slices of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from relflow.functions.lambdas import quoted

#: Bytes of text that a worker holds decoded at once; a longer text is a slice of its own.
SLICE_BYTES = 2_000_000
#: Bytes of an Arrow batch between Spark and a worker, which both hold outside of Spark's heap.
BATCH_BYTES = 8_000_000
#: Distinct words that a worker's table holds before it starts anew; fewer where a word's number is a hash, which is soon made again.
TABLE_WORDS, HASHED_WORDS = 300_000, 60_000

_U = np.uint64


def text_of(df: DataFrame, text: str) -> Column:
    """The text column as bytes."""
    return F.col(quoted(text)).cast("string").cast("binary")


def bound_batches(spark: SparkSession) -> None:
    """Limits the session's Arrow batches to BATCH_BYTES, unless it has a limit: else only rows are counted, and 10,000 long texts are one batch."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) is None:
        spark.conf.set(limit, str(BATCH_BYTES))


_HELD: dict = {}
_ASKED: set = set()


def held(key: str, make: Callable[[], object]) -> object:
    """A worker's one table that outlives a task."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    _ASKED.add(key)
    return _HELD[key]


def drop_unasked() -> None:
    """Drops a table that the worker's present task hasn't asked for: workers outlive operators, too."""
    if not _HELD.keys() <= _ASKED:
        _HELD.clear()
    _ASKED.clear()


def release() -> None:
    """Gives the memory that Arrow and the C library keep free back to the system; workers that wait for tasks would hold it."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def releasing(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for mapInArrow; once it is done and its variables are gone, the worker's free memory is given back."""

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def annotate(df: DataFrame, text: str, make: Callable[[], Callable[[list], dict]], fields: str, keep: list[str] | None = None, with_columns: list[str] | None = None) -> DataFrame:
    """``df`` (its columns ``keep``, else all) with new columns computed from the text.

    ``make()`` runs once a task and returns a function from a list of texts (bytes
    or None) to a list for each field; ``with_columns`` are read as further lists.
    A kept column with the name of a new one gives way to it.  No shuffle.
    """
    bound_batches(df.sparkSession)
    new = T._parse_datatype_string(fields)
    kept = [c for c in (df.columns if keep is None else keep) if c not in new.names]
    more = with_columns or []
    source = df.select(*[F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(kept)], text_of(df, text).alias("t"), *[F.col(quoted(c)).alias(f"w{i}") for i, c in enumerate(more)])
    schema = T.StructType([*[T.StructField(c, df.schema[c].dataType, True) for c in kept], *new.fields])
    arrow, n = to_arrow_schema(schema), len(kept)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        drop_unasked()
        for batch in batches:
            for part in slices(batch, n):
                args = [part.column(i).to_pylist() for i in range(n + 1, n + 1 + len(more))]
                out = f(part.column(n).to_pylist(), *args)
                arrays = [part.column(i).cast(arrow.field(i).type) for i in range(n)]
                arrays += [_array(out[x.name], arrow.field(x.name).type) for x in new]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return source.mapInArrow(releasing(run), schema)


def _array(values: object, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind) if not isinstance(values, pa.Array) else values.cast(kind)


def slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts, in column ``at``, come to SLICE_BYTES or to one row."""
    if not batch.num_rows:
        return
    sizes = np.fromiter((len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(at)), np.int64, batch.num_rows)
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


class _Index(dict):
    """word -> position; a word not seen before gets the next one and joins ``fresh``."""

    def __init__(self) -> None:
        self.fresh: list = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class WordTable:
    """Numbers for the distinct words of a worker's texts, kept from batch to batch.

    ``compute`` gives a row of numbers for each word, from a list of new words.
    """

    def __init__(self, compute: Callable[[list], np.ndarray], limit: int = TABLE_WORDS):
        self.compute, self.limit = compute, limit
        self.index, self.rows = _Index(), None

    def __call__(self, words: list) -> np.ndarray:
        """The rows of ``words``, in order."""
        at = self.positions(words)
        return self.rows[at] if self.rows is not None else self.compute([])

    def positions(self, words: list) -> np.ndarray:
        if len(self.index) > self.limit:
            self.index, self.rows = _Index(), None
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.fresh:
            new = self.compute(self.index.fresh)
            have = len(self.index) - len(new)
            if self.rows is None or len(self.index) > len(self.rows):
                grown = np.empty((max(1024, 2 * len(self.index)), *new.shape[1:]), new.dtype)
                if have:
                    grown[:have] = self.rows[:have]
                self.rows = grown
            self.rows[have : len(self.index)] = new
            self.index.fresh = []
        return at


def lower_words(texts: list) -> tuple[list, np.ndarray, np.ndarray]:
    """(words, numbers, offsets): the different words of all texts by ASCII white space, A-Z in lower case, and each text's as numbers into them."""
    column = pa.array([t or b"" for t in texts], pa.binary()).view(pa.string())
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(column)))
    n, values = np.diff(lists.offsets.to_numpy()), lists.flatten()
    blank = pc.equal(pc.binary_length(values), 0)
    if pc.any(blank).as_py():  # texts without words, which split into one of no length
        n[np.searchsorted(np.cumsum(n), np.flatnonzero(blank), side="right")] = 0
        values = values.filter(pc.invert(blank))
    coded = values.dictionary_encode()
    return coded.dictionary.view(pa.binary()).to_pylist(), coded.indices.to_numpy(), np.concatenate([np.zeros(1, np.int64), np.cumsum(n, dtype=np.int64)])


def hash_words(words: list) -> np.ndarray:
    """64-bit hashes of words given as bytes."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value scattered by two multiply-xorshift rounds."""
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def odd(seed: int, n: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers, fixed by the seed."""
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed) * _U(1_000_003)) * _U(0x9E3779B97F4A7C15)) | _U(1)


def grams(h: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hashes of each run of k words; run i starts at word i.  Runs may cross texts: see :func:`starts`."""
    m = len(h) - k + 1
    if m <= 0:
        return np.empty(0, _U)
    out = np.zeros(m, _U)
    for j, a in enumerate(odd(seed, k)):
        out += h[j : j + m] * a
    return mix(out)


def offsets(lists: list) -> np.ndarray:
    """Where each list begins in their concatenation, and its length at the end."""
    out = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)), out=out[1:])
    return out


def flat(lists: list) -> list:
    return [x for y in lists for x in y]


def starts(off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, owners) of the runs of k words that lie within one text."""
    n = np.maximum(np.diff(off) - k + 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    return np.arange(n.sum()) - np.repeat(first, n) + np.repeat(off[:-1], n), owner


def per_text(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each text."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[off[1:]] - total[off[:-1]]
