"""Near-duplicates by a chosen-path set similarity join.

A document is its set of 5-word shingles; documents with equal sets are one
class.  Each class has minwise tokens.  In each of several independent trees a
class descends along the tokens that its node selects, so similar classes meet
in small nodes.  Nodes that are still large branch on.  Where most members of a
large node resemble its first one, they are held against that one on full sets,
and a node whose members are all linked by then needs no more branches.

Small nodes are compared exhaustively on the tokens, which gives groups of
candidates; inside a group full sets decide, again exhaustively.  Groups that
are chained to one another are taken together only while they come to a small
node's size, so a long chain is checked node by node and not all against all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relflow.functions.lambdas import quoted
from relflow.llm.batches import HASHED_WORDS, WordTable, annotate, drop_unasked, flat, grams, hash_words, mix, odd, offsets, releasing, slices, starts
from relflow.llm.bitmaps import might_be
from relflow.llm.components import components
from relflow.sources.scratch import workspace, written

SHINGLE, PERCENT = 5, 75
#: Minwise tokens of a class (16 bits each), and how many of them, cut to 8 bits, nodes compare.
TOKENS, COMPARED = 128, 64
#: Trees, and their branching at first: a pair at the threshold misses all of them in 5 of 10 million cases.
TREES, DEPTH, CHOICES = 6, 2, 2
#: Classes that a node may hold when it is compared, and the levels after which a large one is checked as it is.
NODE, LEVELS = 200, 12
#: The levels on which families are looked for: they take several jobs, and large nodes shrink between them.
FAMILIES = (0, 3, 6, 9, 12)
#: Estimated similarity from which two classes are candidates: 5.5 standard errors under the threshold.
LIKELY = 0.45
#: Estimated similarity from which a member of a large node is held against its first one, and the part of a node that
#: must have it, or that a family must fill.
HEAD, COHERENT = 0.62, 0.5
#: Classes, and shingles, in one block of a group that is checked on full sets.
BLOCK, BLOCK_SHINGLES = 120, 60_000
#: Bytes that a task of a join or of a written table should have, and about those of a row of keys, one with tokens, one with a full set.
TASK_BYTES, NARROW, WIDE, FULL = 4_000_000, 40, 400, 4_000

_U = np.uint64


def words_of(text: bytes | None) -> list[bytes]:
    """Words by ASCII white space, A-Z in lower case."""
    return (text or b"").lower().split()


def shingle_sets(texts: list, table: WordTable) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    words = [words_of(t) for t in texts]
    off = offsets(words)
    h = table(flat(words))
    at, owner = starts(off, SHINGLE)
    g = grams(h, SHINGLE)[at] if len(at) else np.empty(0, _U)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i, w in enumerate(words):
        if len(w) >= SHINGLE:
            out.append(np.unique(g[cuts[i] : cuts[i + 1]]))
        else:
            out.append(grams(h[off[i] : off[i + 1]], len(w), seed=100 + len(w)) if w else np.empty(0, _U))
    return out


def digest_of(shingles: np.ndarray) -> bytes:
    """The name of the class of a set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """TOKENS 16-bit minwise values of each set; sets must not be empty."""
    off = offsets(sets)
    h = np.concatenate(sets)
    out = np.empty((len(sets), TOKENS), np.uint16)
    for k, (a, b) in enumerate(zip(odd(3, TOKENS), odd(4, TOKENS), strict=True)):
        low = np.minimum.reduceat((h ^ b) * a, off[:-1])
        out[:, k] = (mix(low) & _U(0xFFFF)).astype(np.uint16)
    return out


def sketch_maker() -> Callable:
    table = WordTable(hash_words, HASHED_WORDS)

    def run(texts: list) -> dict:
        sets = shingle_sets(texts, table)
        some = [i for i, s in enumerate(sets) if len(s)]
        tokens: list = [None] * len(texts)
        digests: list = [None] * len(texts)
        low: list = [None] * len(texts)
        for lo in range(0, len(some), 512):
            part = some[lo : lo + 512]
            for i, row in zip(part, minwise([sets[i] for i in part]), strict=True):
                tokens[i] = row.tobytes()
                low[i] = row[:COMPARED].astype(np.uint8).tobytes()
                digests[i] = digest_of(sets[i])
        return {"n_shingles": [len(s) for s in sets], "digest": digests, "tokens": tokens, "low": low}

    return run


def paths_maker(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, digest) rows: each class in the nodes that it reaches in all trees."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        tokens = _matrix(batch.column(1), np.uint16, TOKENS)
        each = TOKENS // TREES
        for tree in range(TREES):
            nodes = np.full((n, 1), mix(np.array([tree + 1], _U))[0], _U)
            first = 0
            for _ in range(DEPTH):
                # a node's choices are fixed by its place; each tree keeps to tokens of its own
                count = nodes.shape[1]
                nxt = [mix(nodes[:, j] * odd(5, 1)[0] + _U(c + 1)) ^ mix(tokens[:, tree * each + first + j * CHOICES + c].astype(_U) * odd(6, 1)[0] + nodes[:, j]) for j in range(count) for c in range(CHOICES)]
                nodes, first = np.stack(nxt, 1), first + count * CHOICES
            for j in range(nodes.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[:, j].view(np.int64)), batch.column(0)], names=["node", "digest"])


def branch_maker(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Children (node, digest) of rows (node, digest, tokens): CHOICES tokens that the node chooses."""
    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column(0).to_numpy(zero_copy_only=False).view(_U)
        tokens = _matrix(batch.column(2), np.uint16, TOKENS)
        rows = np.arange(len(node))
        for c in range(CHOICES):
            chosen = mix(node * odd(7, 1)[0] + _U(c + 1))
            value = tokens[rows, (chosen % _U(TOKENS)).astype(np.int64)].astype(_U)
            child = mix(chosen ^ (value * odd(8, 1)[0] + _U(c)))
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column(1)], names=["node", "digest"])


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """Rows of a binary column of fixed width."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


class Union:
    """Disjoint sets of 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.parts = n

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.parts -= 1

    def groups(self) -> list[list[int]]:
        """The members of all sets that have two or more."""
        out: dict[int, list[int]] = {}
        for x in range(len(self.up)):
            out.setdefault(self.root(x), []).append(x)
        return [g for g in out.values() if len(g) > 1]

    def stars(self) -> list[tuple[int, int]]:
        """(root, member) of all that aren't alone."""
        return [(r, x) for x in range(len(self.up)) if (r := self.root(x)) != x]


def by_run(f: Callable[[pa.Table], pa.RecordBatch | None]) -> Callable:
    """Applies ``f`` to each run of two or more rows with equal first columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_unasked()
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held and sum(b.num_rows for b in held) > 1 and (out := f(pa.Table.from_batches(held))) is not None:
                yield out
            held.clear()

        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if keys[s] != key:
                    yield from flush()
                    key = keys[s]
                held.append(batch.slice(s, e - s))
        yield from flush()

    return releasing(run)


def _binaries(names: list[str], *columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=names)


def likely_groups(rows: pa.Table) -> pa.RecordBatch | None:
    """(group, head, digest): the members of each set of classes of one node that their tokens hold similar, pair by pair.

    Classes whose sizes are too far apart aren't similar.  A set whose members
    have one label, that is are linked already, is left out.  A group is named by
    its members, so that it has one name in all nodes where it is found.
    """
    n = rows.column("n").to_numpy()
    low = _matrix(rows.column("low").combine_chunks(), np.uint8, COMPARED)
    sets = Union(len(n))
    for i in range(1, len(n)):
        if sets.parts == 1:
            break
        alike = (low[:i] == low[i]).sum(1) >= LIKELY * COMPARED
        alike &= 100 * np.minimum(n[:i], n[i]) >= PERCENT * np.maximum(n[:i], n[i])
        for j in np.flatnonzero(alike).tolist():
            sets.join(j, i)
    labels = rows.column("label").to_pylist()
    digests, groups, heads, members = rows.column("digest").to_pylist(), [], [], []
    for g in sets.groups():
        if labels[g[0]] is None or any(labels[i] != labels[g[0]] for i in g):
            mine = sorted(digests[i] for i in g)
            groups += [hashlib.blake2b(b"".join(mine), digest_size=16).digest()] * len(mine)
            heads += [mine[0]] * len(mine)
            members += mine
    return _binaries(["group", "head", "digest"], groups, heads, members) if groups else None


def equal_edges(rows: pa.Table) -> pa.RecordBatch | None:
    """Edges (a, b) that connect the classes of one cell whose full sets reach the threshold, pair by pair."""
    ids = rows.column("digest").to_pylist()
    stars = equal_pairs(rows)
    return _binaries(["a", "b"], [ids[a] for a, _ in stars], [ids[b] for _, b in stars]) if stars else None


def equal_pairs(rows: pa.Table) -> list[tuple[int, int]]:
    """Stars of the classes of one cell whose full sets reach the threshold."""
    sets = [np.frombuffer(x.as_py(), _U) for x in rows.column("shingles")]
    groups = Union(len(sets))
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if 100 * both >= PERCENT * (len(sets[0]) + len(sets[1]) - both):
            groups.join(0, 1)
        return groups.stars()
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(token, kind="stable")
    posting, begin = owner[order], np.concatenate([[0], np.cumsum(np.bincount(token))])
    at = np.concatenate([[0], np.cumsum(size)])
    for i in range(1, len(sets)):
        if groups.parts == 1:
            break
        mine = token[at[i] : at[i + 1]]
        lo, hi = begin[mine], begin[mine + 1]
        n = hi - lo
        places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        both = np.bincount(posting[places], minlength=len(sets))[:i]
        for j in np.flatnonzero(100 * both >= PERCENT * (size[:i] + size[i] - both)).tolist():
            groups.join(j, i)
    return groups.stars()


EDGE = "a binary, b binary"


class Tables:
    """Writes tables, each over as many tasks as it needs.

    ``rows`` is the number of classes; a table has about ``times`` as many rows, of
    ``width`` bytes.  Where Spark has more partitions than such a table fills with
    TASK_BYTES, and more than there are cores, each would cost a task and a file.
    A hot key's parts are still dealt out: only whole partitions are put together.
    """

    def __init__(self, keep: Callable[[DataFrame, str], DataFrame], rows: int, cores: int):
        self.keep, self.rows, self.cores = keep, rows, cores

    def fit(self, df: DataFrame, times: float = 1, width: int = NARROW) -> DataFrame:
        return df.coalesce(max(self.cores, ceil(times * self.rows * width / TASK_BYTES)))

    def __call__(self, df: DataFrame, name: str, times: float = 1, width: int = NARROW) -> DataFrame:
        return self.keep(self.fit(df, times, width), name)


def _in_runs(df: DataFrame, key: str, f: Callable, fit: Callable[[DataFrame], DataFrame], schema: str = EDGE) -> DataFrame:
    """What ``f`` finds in the rows of each key; keys hold few rows."""
    return fit(fit(df).repartition(F.col(key))).sortWithinPartitions(key, "digest").mapInArrow(by_run(f), schema)


def with_likeness(rows: DataFrame) -> DataFrame:
    """(node, digest, head, like): the part of compared tokens that a row shares with its node's head."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                same = (_matrix(b.column(3), np.uint8, COMPARED) == _matrix(b.column(4), np.uint8, COMPARED)).mean(1)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(same)], names=["node", "digest", "head", "like"])

    return rows.select("node", "digest", "head", "low", "head_low").mapInArrow(run, "node bigint, digest binary, head binary, like double")


def full_sets(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(digest, shingles) of the classes whose ``key``, the hash of one of their texts, is in ``wanted``.

    A bitmap of the keys, of bounded size, keeps most other texts from the workers.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_unasked()
        table = WordTable(hash_words, HASHED_WORDS)
        for b in batches:
            for part in slices(b, 0):
                sets = [s for s in shingle_sets(part.column(0).to_pylist(), table) if len(s)]
                yield _binaries(["digest", "shingles"], [digest_of(s) for s in sets], [s.tobytes() for s in sets])

    t = F.col(quoted(text)).cast("string")
    rows = might_be(docs.where(t.isNotNull()).select(t.alias("t")), F.xxhash64("t"), wanted, "hit").where("hit")
    return rows.select(F.col("t").cast("binary").alias("t")).mapInArrow(releasing(run), "digest binary, shingles binary").groupBy("digest").agg(F.first("shingles").alias("shingles"))


def linked(cells: DataFrame, docs: DataFrame, classes: DataFrame, text: str, keep: Tables) -> DataFrame:
    """Edges between the classes of each cell of (cell, digest), decided on full sets.  Cells and keys are read several times, so they are written."""
    cells = keep(cells, "cells")
    keys = keep(classes.join(cells, "digest", "left_semi").select("key"), "keys")
    met = cells.join(full_sets(docs, text, keys), "digest").select("cell", "digest", "shingles")
    return _in_runs(met, "cell", equal_edges, lambda df: keep.fit(df, 1, FULL))


def _dealt(members: DataFrame, by: str, classes: DataFrame, keep: Tables) -> DataFrame:
    """``members`` (``by``, digest) with the number of their block, ``mine`` of ``blocks``: a block holds BLOCK classes or BLOCK_SHINGLES shingles."""
    sized = members.join(classes.select("digest", "n"), "digest")
    blocks = sized.groupBy(by).agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    # written, so that the join is one of two plain exchanges and Spark can split a hot group
    return members.join(keep(blocks, "blocks"), by).withColumn("mine", F.pmod(F.xxhash64("digest", F.lit(9)), F.col("blocks")).cast("int"))


def head_cells(pairs: DataFrame, classes: DataFrame, keep: Tables) -> DataFrame:
    """Cells of (head, digest) pairs: each block of a head's members, and the head with them."""
    dealt = _dealt(pairs, "head", classes, keep).select("head", "digest", F.xxhash64("head", "mine").alias("cell"))
    return dealt.select("cell", "digest").unionByName(dealt.select("cell", F.col("head").alias("digest")).distinct())


def family_cells(members: DataFrame, others: DataFrame, classes: DataFrame, keep: Tables) -> DataFrame:
    """Cells of families (label, digest) and of the others that are held against them: each block of one with each of the other."""
    ours, theirs = (_dealt(x, "label", classes, keep) for x in (members, others))
    n = lambda x: keep(x.select("label", F.col("blocks").alias("opposite")).distinct(), "blocks")
    i, j = (x.join(n(y), "label").select("label", "digest", "mine", F.explode(F.sequence(F.lit(0), F.col("opposite") - 1)).alias("other")) for x, y in ((ours, theirs), (theirs, ours)))
    return i.select("digest", F.xxhash64("label", "mine", "other").alias("cell")).unionByName(j.select("digest", F.xxhash64("label", "other", "mine").alias("cell")))


def group_cells(members: DataFrame, classes: DataFrame, keep: Tables) -> DataFrame:
    """Cells of groups (node, digest): each pair of a group's blocks."""
    dealt = _dealt(members, "node", classes, keep)
    pairs = dealt.select("digest", "node", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return pairs.select("digest", F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"))


def majorities(labelled: DataFrame) -> DataFrame:
    """(node, family) of the nodes (node, digest, label) in which COHERENT of the members have one label."""
    of = labelled.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("node")
    most = of.agg(F.sum("n").alias("size"), F.max(F.when(F.col("label").isNotNull(), F.struct("n", "label"))).alias("most"))
    return most.where(F.col("most.n") >= COHERENT * F.col("size")).select("node", F.col("most.label").alias("family"))


def head_pairs(large: DataFrame, classes: DataFrame, times: float, keep: Tables) -> DataFrame:
    """(head, digest): the first member of each node that most others resemble by their tokens, with those that do.  ``large`` has ``times`` as many rows as there are classes."""
    met = keep.fit(large.join(classes.select("digest", "low"), "digest"), times, WIDE)
    first = large.groupBy("node").agg(F.min("digest").alias("head")).join(classes.select(F.col("digest").alias("head"), F.col("low").alias("head_low")), "head")
    compared = keep(with_likeness(met.join(keep(first, "first"), "node")), "heads", times)
    alike = F.col("like") >= HEAD
    coherent = compared.groupBy("node").agg(F.avg(alike.cast("double")).alias("part")).where(F.col("part") >= COHERENT).select("node")
    return compared.where(alike & (F.col("head") != F.col("digest"))).join(keep(coherent, "coherent"), "node", "left_semi").select("head", "digest").distinct()


def near_links(docs: DataFrame, classes: DataFrame, text: str, keep: Tables) -> DataFrame:
    """Edges (a, b) between classes that are linked: as many as it takes to connect them."""
    # rows in nodes, for each class
    times: float = TREES * CHOICES**DEPTH
    # a class's paths end in different nodes, so these rows and their children are unique as they are
    rows = classes.select("digest", "tokens").mapInArrow(paths_maker, "node bigint, digest binary")
    labels = keep(classes.select("digest", F.col("digest").alias("label")).limit(0), "labels")
    none, links, small = labels.select("label", "digest"), [], []
    pairs_done, others_done, whole = labels.select(F.col("label").alias("head"), "digest"), none, None

    def learned(cells: DataFrame) -> DataFrame:
        """The labels of all linked classes, those of ``cells`` among them."""
        links.append(keep(linked(cells, docs, classes, text, keep), "links", 1, FULL))
        return components(reduce(DataFrame.unionByName, links), "labels", keep).select(F.col("v").alias("digest"), F.col("c").alias("label"))

    for level in range(LEVELS + 1):
        # what hot nodes are joined to is written first, so that Spark can split these joins
        counts = keep(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "counts", times)
        rows = keep(rows.join(counts, "node"), "nodes", times)
        small.append(rows.where(F.col("size") <= NODE).select("node", "digest"))
        large = rows.where(F.col("size") > NODE).select("node", "digest")
        if not (crowded := large.count()):
            break
        times = crowded / keep.rows
        if level in FAMILIES:
            # nodes that most members of one family fill have no need of a head
            labelled, settled = large.withColumn("label", F.lit(None).cast("binary")), None
            if links:
                labelled = keep(large.join(labels, "digest", "left"), "labelled", times)
                settled = keep(majorities(labelled), "settled")
            pairs = head_pairs(large.join(settled, "node", "left_anti") if links else large, classes, times, keep)
            pairs = keep(pairs.join(pairs_done, ["head", "digest"], "left_anti"), "pairs", times)
            if pairs.limit(1).count():
                pairs_done = pairs_done.unionByName(pairs)
                labels = learned(head_cells(pairs, classes, keep))
                labelled = keep(large.join(labels, "digest", "left"), "labelled", times)
                settled = keep(majorities(labelled), "settled")
            if settled is not None and settled.limit(1).count():
                # of a node that a family fills only the others go on, once they are held against that family
                rest = labelled.join(settled, "node").where(~F.coalesce(F.col("label") == F.col("family"), F.lit(False)))
                rest = keep(rest.select("node", "digest", F.col("family").alias("label")), "rest", times)
                others = keep(rest.select("label", "digest").distinct().join(others_done, ["label", "digest"], "left_anti"), "others", times)
                if others.limit(1).count():
                    others_done = others_done.unionByName(others)
                    families = labels.join(others.select("label").distinct(), "label", "left_semi").select("label", "digest")
                    labels = learned(family_cells(families, others, classes, keep))
                sizes = keep(rest.groupBy("node").agg(F.count(F.lit(1)).alias("size")), "counts")
                rest = keep(rest.select("node", "digest").join(sizes, "node"), "nodes", times)
                small.append(rest.where(F.col("size") <= NODE).select("node", "digest"))
                large = keep(large.join(settled.select("node"), "node", "left_anti").unionByName(rest.where(F.col("size") > NODE).select("node", "digest")), "large", times)
                if not (crowded := large.count()):
                    break
                times = crowded / keep.rows
        if level == LEVELS:
            whole = large
            break
        rows = keep(large.join(classes.select("digest", "tokens"), "digest").select("node", "digest", "tokens").mapInArrow(branch_maker, "node bigint, digest binary"), "children", times, WIDE)
        times *= CHOICES
    rows = reduce(DataFrame.unionByName, small)
    times = rows.count() / max(1, keep.rows)
    rows = rows.join(classes.select("digest", "n", "low"), "digest").join(labels, "digest", "left").select("node", "digest", "n", "low", "label")
    found = keep(_in_runs(rows, "node", likely_groups, lambda df: keep.fit(df, times, WIDE), "group binary, head binary, digest binary").distinct(), "groups")
    chains = components(found.select(F.col("head").alias("a"), F.col("digest").alias("b")), "candidates", keep)
    sizes = chains.groupBy("c").agg(F.count(F.lit(1)).alias("size"))
    long = keep(sizes.where(F.col("size") > NODE).select("c"), "long")
    members = chains.join(long, "c", "left_anti").select(F.xxhash64("c").alias("node"), F.col("v").alias("digest"))
    if long.limit(1).count():
        inside = chains.join(long, "c", "left_semi").select(F.col("v").alias("digest"))
        members = members.unionByName(found.join(inside, "digest", "left_semi").select(F.xxhash64("group").alias("node"), "digest"))
    if whole is not None:
        members = members.unionByName(whole)
    members = keep(members.distinct(), "members")
    last = linked(group_cells(members, classes, keep), docs, classes, text, keep)
    return reduce(DataFrame.unionByName, [*links, last])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key: str | None = None, group: str | None = None) -> DataFrame:
    """One row for each document: ``n_shingles``, ``component_id`` and ``kept``.

    Documents are linked if their shingle sets share 75 % of their union;
    ``component_id`` is the least id of a document's component, itself included,
    and ``kept`` tells whether that is its own.  Documents without words (null and
    empty texts) are linked with nothing and form components of their own.  Rows
    with a null id are kept, and have the component of their links, null without
    any.  Repeated rows have equal texts, so they are linked; those with the least
    id are all kept.  Very long texts count whole; one's set is held by one task at a time.
    Other columns are not read.  An empty table gives an empty one.
    ``key`` names a further column with the xxhash64 of the text, and ``group`` one
    that tells components apart even where their least ids clash; it is null
    without words.
    """
    t = F.col(quoted(text)).cast("string")
    rows = docs.select(F.col(quoted(doc_id)).alias("id"), F.xxhash64(t).alias("key"), t.alias("t"))
    sketch = written(annotate(rows, "t", lambda: sketch_maker(), "n_shingles bigint, digest binary, tokens binary, low binary", ["id", "key"]), "sketch")
    some = sketch.where(F.col("digest").isNotNull())
    classes = some.groupBy("digest").agg(F.min("key").alias("key"), F.min("id").alias("id"), F.min("n_shingles").alias("n"), *[F.first(c).alias(c) for c in ("tokens", "low")])
    cores = docs.sparkSession.sparkContext.defaultParallelism
    classes = Tables(written, some.count(), cores)(classes, "classes", 1, WIDE)
    n = classes.count()
    with workspace(docs.sparkSession, "links") as keep:
        groups = components(near_links(docs, classes, text, Tables(keep, n, cores)), "links")
    stay = Tables(written, n, cores)
    # only classes with links are dealt by component, and its least id is looked up in a table of its own
    known = stay(groups.select(F.col("v").alias("digest"), "c").join(classes.select("digest", "id"), "digest"), "linked")
    least = stay(known.groupBy("c").agg(F.min("id").alias("component")), "least")
    renamed = known.select("digest", "c").join(least, "c").select("digest", "component", "c")
    of_class = stay(classes.select("digest", "id").join(renamed, "digest", "left").select("digest", F.coalesce("component", "id").alias("component"), F.coalesce("c", "digest").alias("c")), "named")
    # a join of two plain exchanges, so that Spark can split a class of very many copies
    out = sketch.select("id", "key", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.coalesce("component", "id")
    more = [F.col(c).alias(name) for c, name in (("key", key), ("c", group)) if name]
    return out.select(F.col("id").alias(doc_id), "n_shingles", component.alias("component_id"), (F.col("id").isNull() | F.coalesce(F.col("id") == component, F.lit(True))).alias("kept"), *more)
