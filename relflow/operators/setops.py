"""Set and multiset operations on whole rows, matched by column name; null equals null."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relflow.functions.lambdas import as_column, assert_arity, quoted
from relflow.relation import Relation, relation


def _frames(rels: tuple) -> list[DataFrame]:
    """The relations' frames; None among them is skipped."""
    dfs = [relation(r).df for r in rels if r is not None]
    if not dfs:
        raise ValueError("at least one relation is needed")
    return [dfs[0], *[d.select(*[F.col(quoted(c)) for c in dfs[0].columns]) for d in dfs[1:]]]


def distinct(rel: Relation | DataFrame, partition_by: Callable | None = None, parallel: int | None = None) -> Relation:
    """Unique rows.  ``partition_by(n, row)`` gives the partition of a row, of ``parallel`` ones."""
    rel = relation(rel)
    if partition_by is None:
        # rows meet where they are first, and only the unique ones are dealt anew
        return Relation(rel.df.distinct().repartition(parallel, *[F.col(quoted(c)) for c in rel.df.columns]) if parallel else rel.df.distinct())
    assert_arity(partition_by, 2, "partition_by")
    n = parallel or int(rel.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    unique = Relation(rel.df.dropDuplicates())
    part = F.pmod(as_column(partition_by(F.lit(n), unique.row)), F.lit(n)).cast("int")
    return Relation(unique.df.repartitionById(n, part))


def concat(*rels: Relation | DataFrame | None) -> Relation:
    return Relation(reduce(lambda a, b: a.unionByName(b), _frames(rels)))


union_multiset = concat


def union(*rels: Relation | DataFrame | None) -> Relation:
    return Relation(concat(*rels).df.distinct())


def intersection(*rels: Relation | DataFrame | None) -> Relation:
    return Relation(reduce(lambda a, b: a.intersect(b), _frames(rels)).distinct())


def intersection_multiset(*rels: Relation | DataFrame | None) -> Relation:
    """Each row as often as in the relation that has it least often."""
    return Relation(reduce(lambda a, b: a.intersectAll(b), _frames(rels)))


def difference(*rels: Relation | DataFrame | None) -> Relation:
    return Relation(reduce(lambda a, b: a.subtract(b), _frames(rels)).distinct())


def difference_multiset(*rels: Relation | DataFrame | None) -> Relation:
    """Each row as often as in the first, less its copies in all others."""
    return Relation(reduce(lambda a, b: a.exceptAll(b), _frames(rels)))


def set_op(f: Callable[..., Column], *rels: Relation | DataFrame | None) -> Relation:
    """Each distinct row f(n0, n1, ...) times, where ni is its number of copies in relation i.

    One tagged union, summed map-side; only counts are shuffled.
    """
    dfs = _frames(rels)
    assert_arity(f, len(dfs), "set_op")
    names = dfs[0].columns
    tagged = reduce(lambda a, b: a.unionByName(b), [d.withColumn("__tag", F.lit(i)) for i, d in enumerate(dfs)])
    counts = tagged.groupBy(*[F.col(quoted(c)) for c in names]).agg(*[F.count(F.when(F.col("__tag") == i, F.lit(1))).alias(f"__n{i}") for i in range(len(dfs))])
    n = F.greatest(as_column(f(*[F.col(f"__n{i}") for i in range(len(dfs))])).cast("int"), F.lit(0))
    copies = counts.withColumn("__c", F.explode(F.array_repeat(F.lit(0), n)))
    return Relation(copies.select(*[F.col(quoted(c)) for c in names]))
