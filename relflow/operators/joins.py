"""Equi-joins on computed keys, with explicit null-key rules.

Null keys match nothing unless ``join_nils``; outer sides still emit them.
``filter_by`` and ``remove_by`` match null with null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relflow.functions.folds import Fold
from relflow.functions.lambdas import VALUE, Row, as_column, assert_arity, is_scalar, quoted, row_of, to_columns
from relflow.relation import Relation, relation

TYPES = ("required", "optional")
STRATEGIES = {"replicated": "broadcast", "broadcast": "broadcast", "merge": "merge", "hash": "shuffle_hash", "shuffle_hash": "shuffle_hash", "skewed": None}
#: Bytes, as Spark estimates them, up to which a side is replicated on request.
REPLICATED_BYTES = 64 << 20


@dataclass(frozen=True)
class Select:
    rel: Relation
    key: Callable
    type: str | None
    fold: Fold | None


def on(rel: Relation | DataFrame, key: Callable | str | None = None, type: str | None = None, fold: Fold | None = None) -> Select:
    """One side of a join or cogroup.  The key defaults to the whole row; a name selects a column."""
    if type is not None and type not in TYPES:
        raise ValueError(f"type must be one of {TYPES}")
    if isinstance(key, str):
        name = key
        key = lambda r: r if isinstance(r, Column) else r[name]
    if key is not None:
        assert_arity(key, 1, "key")
    return Select(relation(rel), key or (lambda r: r), type, fold)


def _side(s: Select, i: int) -> tuple[DataFrame, Any, Column]:
    """The side with its columns renamed apart, its row and its key."""
    df = s.rel.df
    side = df.select(*[F.col(quoted(c)).alias(f"__{i}_{c}") for c in df.columns], as_column(s.key(s.rel.row)).alias(f"__k{i}"), F.lit(True).alias(f"__p{i}"))
    columns = {c: F.col(quoted(f"__{i}_{c}")) for c in df.columns}
    row = columns[VALUE] if is_scalar(columns) else Row(columns, F.coalesce(F.col(f"__p{i}"), F.lit(False)))
    return side, row, F.col(f"__k{i}")


def _small(df: DataFrame) -> bool:
    """Whether Spark's estimate, which is a file's size where it knows no better, lets the side be replicated."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= REPLICATED_BYTES


def join(selects: list[Select], f: Callable, join_nils: bool = False, strategy: str | None = None, parallel: int | None = None, all_args: bool = False) -> Relation:
    """Inner join of two or more sides, or outer join of exactly two.

    ``f`` gets one row for each side (with ``all_args`` key, row, key, row, ...);
    of an absent side all columns are null and ``row.present`` is false.
    ``strategy`` is a physical hint, ``parallel`` the number of partitions.  A
    right side of over REPLICATED_BYTES is not replicated, whatever the hint:
    Spark then chooses the join.
    """
    if len(selects) < 2:
        raise ValueError("a join needs two relations at least")
    kinds = [s.type or "required" for s in selects]
    if "optional" in kinds and len(selects) != 2:
        raise ValueError("an outer join takes exactly two relations")
    if strategy is not None and strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {sorted(STRATEGIES)}")
    assert_arity(f, len(selects) * (1 + all_args), "join function")
    sides = [_side(s, i) for i, s in enumerate(selects)]
    how = {("required", "required"): "inner", ("required", "optional"): "left", ("optional", "required"): "right", ("optional", "optional"): "full"}.get(tuple(kinds), "inner")
    df, _, first = sides[0]
    if parallel:
        df = df.repartition(parallel, first)
    for right, _, key in sides[1:]:
        right = right.repartition(parallel, key) if parallel else right
        hint = STRATEGIES[strategy] if strategy else None
        if hint and (hint != "broadcast" or _small(right)):
            right = right.hint(hint)
        df = df.join(right, first.eqNullSafe(key) if join_nils else first == key, how)
    args = [x for _, row, key in sides for x in ((key, row) if all_args else (row,))]
    return Relation(df.select(*to_columns(f(*args))))


def _keyed(rel: Relation | DataFrame, keys: Relation | DataFrame, key: Callable | None) -> tuple[DataFrame, DataFrame, Column]:
    rel, keys = relation(rel), relation(keys)
    left = rel.df.select("*", as_column((key or (lambda r: r))(rel.row)).alias("__key"))
    right = keys.df.select(as_column(row_of(keys.df)).alias("__other"))
    return left, right, F.col("__key").eqNullSafe(F.col("__other"))


def filter_by(rel: Relation | DataFrame, keys: Relation | DataFrame, key: Callable | None = None) -> Relation:
    """Rows whose key is among ``keys``; a key that stands there twice gives its rows twice."""
    left, right, same = _keyed(rel, keys, key)
    return Relation(left.join(right, same, "inner").drop("__key", "__other"))


def remove_by(rel: Relation | DataFrame, keys: Relation | DataFrame, key: Callable | None = None) -> Relation:
    """Rows whose key is not among ``keys``; a null key goes only if ``keys`` has null."""
    left, right, same = _keyed(rel, keys, key)
    return Relation(left.join(right, same, "left_anti").drop("__key"))
