"""Connected components by contraction: no vertex, edge or component is brought to the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relflow.sources.scratch import workspace, written

#: Edges, of some dozen bytes each, that one task joins at the most.
FEW = 100_000


def components(edges: DataFrame, name: str = "components", into: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """(v, c) for each vertex of ``edges`` (a, b): c is the same for connected vertices.

    Each round maps every vertex to its least neighbour and the edges to edges
    between these; with ids in random order, as digests are, the graph shrinks
    by a constant factor.  Each round is written, so a lost executor costs one.
    FEW edges or less, a bounded size that is checked, are joined by one task.
    """
    with workspace(edges.sparkSession, name) as keep:
        # copies of an edge go only if there are many: a few need no shuffle
        left = keep(edges.where(F.col("a") != F.col("b")), "edges")
        if left.count() <= FEW:
            return into(left.coalesce(1).mapInArrow(_joined, "v binary, c binary"), name)
        return into(_components(keep(_proper(left), "edges"), keep), name)


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, c) of all edges of the task, by disjoint sets."""
    up: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.binary()), pa.array([root(x) for x in list(up)], pa.binary())], names=["v", "c"])


def _components(left: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    maps = []
    while left.limit(1).count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("c"))
        least = keep(least, "least")
        maps.append(least)
        moved = left.join(least.select(F.col("v").alias("a"), F.col("c").alias("x")), "a").join(least.select(F.col("v").alias("b"), F.col("c").alias("y")), "b")
        left = keep(_proper(moved.select(F.col("x").alias("a"), F.col("y").alias("b"))), "edges")
    out = maps[-1]
    for m in reversed(maps[:-1]):
        # a vertex whose image has no edge left is its own component's name
        step = m.select("v", F.col("c").alias("via")).join(out.select(F.col("v").alias("via"), F.col("c").alias("end")), "via", "left")
        out = step.select("v", F.coalesce("end", "via").alias("c"))
    return out


def _proper(edges: DataFrame) -> DataFrame:
    """Each edge once, without loops."""
    return edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
