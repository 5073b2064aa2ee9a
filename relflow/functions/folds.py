"""Composable folds that compile to aggregate Columns.

A fold is a list of steps on each element (map, mapcat, filter, remove, keep)
and one terminal.  Terminals of sequence type (vec, sort, distinct, take) can
be refined further; an aggregate (count, sum, ...) can't.  As in the model that
is followed, count/sum/avg/min/max/distinct built on a sequence fold keep only
its element steps: ``fold.take(5).count()`` counts everything.

Null rules: count, vec and distinct include nulls; sum and avg raise on null;
null is the least value for min, max, sort and top.  Nothing left: count and
sum give 0, avg, min and max null, sequences an empty array.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relflow.functions.lambdas import as_column, assert_arity, unwrap

SEQUENCE = {"vec", "distinct"}


@dataclass(frozen=True)
class Fold:
    steps: tuple = ()
    terminal: str = "vec"
    key: Callable | None = None
    reverse: bool = False
    post: tuple = ()
    folds: tuple = ()

    # element steps
    def _step(self, kind: str, f: Callable) -> Fold:
        if self.terminal not in SEQUENCE or self.terminal == "distinct" or self.post:
            raise ValueError("operator must be used before aggregation")
        assert_arity(f, 1, f"fold.{kind}")
        return replace(self, steps=(*self.steps, (kind, f)))

    def map(self, f: Callable) -> Fold:
        return self._step("map", f)

    def mapcat(self, f: Callable) -> Fold:
        return self._step("mapcat", f)

    def filter(self, p: Callable) -> Fold:
        return self._step("filter", p)

    def remove(self, p: Callable) -> Fold:
        return self._step("remove", p)

    def keep(self, f: Callable) -> Fold:
        """Map, then drop nulls (false stays)."""
        return self._step("map", f)._step("filter", lambda x: as_column(x).isNotNull())

    def preprocess(self, name: str, f: Callable) -> Fold:
        """The element step of that name: the helper the named steps are made of."""
        return getattr(self, name)(f)

    # sequences
    def _refine(self, *step: Any) -> Fold:
        if self.terminal not in SEQUENCE:
            raise ValueError("operator must be used before aggregation")
        return replace(self, post=(*self.post, step))

    def vec(self) -> Fold:
        return self

    def sort(self, reverse: bool = False) -> Fold:
        return self._refine("sort", None, reverse)

    def sort_by(self, key: Callable, reverse: bool = False) -> Fold:
        assert_arity(key, 1, "fold.sort_by")
        return self._refine("sort", key, reverse)

    def take(self, n: int) -> Fold:
        if n <= 0:
            raise ValueError("n must be positive")
        return self._refine("take", n)

    def first(self) -> Fold:
        return self._refine("first")

    def last(self) -> Fold:
        return self._refine("last")

    def top(self, n: int, reverse: bool = False) -> Fold:
        """The ``n`` smallest values; the largest if ``reverse``."""
        return self.sort(reverse).take(n)

    def top_by(self, key: Callable, n: int, reverse: bool = False) -> Fold:
        return self.sort_by(key, reverse).take(n)

    # aggregates: they keep the element steps only
    def _terminal(self, name: str, **more: Any) -> Fold:
        if self.terminal not in SEQUENCE:
            raise ValueError("operator must be used before aggregation")
        return Fold(steps=self.steps, terminal=name, **more)

    def distinct(self) -> Fold:
        return self._terminal("distinct")

    def count(self) -> Fold:
        return self._terminal("count")

    def sum(self) -> Fold:
        return self._terminal("sum")

    def avg(self) -> Fold:
        return self._terminal("avg")

    def min(self, reverse: bool = False) -> Fold:
        return self._terminal("min", reverse=reverse)

    def max(self, reverse: bool = False) -> Fold:
        return self._terminal("min", reverse=not reverse)

    def min_key(self, key: Callable, reverse: bool = False) -> Fold:
        """The element with the least key; ties go to the least element."""
        assert_arity(key, 1, "fold.min_key")
        return self._terminal("min", key=key, reverse=reverse)

    def max_key(self, key: Callable, reverse: bool = False) -> Fold:
        return self.min_key(key, not reverse)

    def juxt(self, *folds: Fold, **named: Fold) -> Fold:
        """Several folds in one pass: a struct of their results."""
        items = (*((f"_{i + 1}", f) for i, f in enumerate(folds)), *named.items())
        return Fold(terminal="juxt", folds=tuple(items))

    def top_spec(self) -> tuple[Callable | None, bool, int] | None:
        """(key, reverse, n) of a plain top fold, which a bounded plan can serve."""
        if self.terminal == "vec" and len(self.post) == 2 and self.post[0][0] == "sort" and self.post[1][0] == "take" and all(k != "mapcat" for k, _ in self.steps):
            return self.post[0][1], self.post[0][2], self.post[1][1]
        return None

    def elements(self, x: Any) -> tuple[Any, Column | None]:
        """The mapped element and the condition under which it counts; mapcat-free folds only."""
        where: Column | None = None
        for kind, f in self.steps:
            r = f(x)
            if kind == "map":
                x = r
            else:
                p = F.coalesce(as_column(r), F.lit(False))
                p = ~p if kind == "remove" else p
                where = p if where is None else where & p
        return x, where

    def compile(self, x: Any, where: Column | None = None, df: DataFrame | None = None) -> Column:
        """The aggregate Column of this fold over elements ``x``, of the rows with ``where``.

        ``df``, which has the columns of ``x``, tells the type of sums after a mapcat;
        without it they are doubles.
        """
        if self.terminal == "juxt":
            return F.struct(*[f.compile(x, where, df).alias(n) for n, f in self.folds])
        if any(kind == "mapcat" for kind, _ in self.steps):
            return self._over_arrays(x, where, df)
        x, p = self.elements(x)
        p = p if where is None else where if p is None else where & p
        only = (lambda c: c) if p is None else (lambda c: F.when(p, c))
        if self.terminal == "count":
            return F.count(only(F.lit(1)))
        if self.terminal in ("sum", "avg"):
            value = F.when(as_column(x).isNull(), F.raise_error(F.lit(f"{self.terminal} of null"))).otherwise(as_column(x))
            return F.coalesce(F.sum(only(value)), F.lit(0)) if self.terminal == "sum" else F.avg(only(value))
        if self.terminal == "min":
            best = F.struct(as_column(self.key(x)).alias("k"), unwrap(x).alias("x")) if self.key else F.struct(unwrap(x).alias("x"))
            return (F.max if self.reverse else F.min)(only(best))["x"]
        wrapped = only(F.struct(unwrap(x).alias("x")))
        steps = [step[0] for step in self.post] if self.terminal == "vec" else []
        if steps in (["first"], ["last"]):
            return (F.first if steps == ["first"] else F.last)(wrapped, ignorenulls=True)["x"]
        if steps in (["sort", "first"], ["sort", "last"]):
            # one element is held for each group, not all of them
            _, key, reverse = self.post[0]
            best = F.struct(as_column(key(x) if key else x).alias("k"), unwrap(x).alias("x"))
            return (F.max if reverse != (steps[1] == "last") else F.min)(only(best))["x"]
        return self._finish(F.collect_set(wrapped) if self.terminal == "distinct" else F.collect_list(wrapped))

    def _over_arrays(self, x: Any, where: Column | None, df: DataFrame | None) -> Column:
        """As compile, with a mapcat among the steps: each row gives an array of wrapped elements."""
        arr = F.array(F.struct(unwrap(x).alias("x")))
        for kind, f in self.steps:
            arr = _array_step(arr, kind, f)
        arr = arr if where is None else F.when(where, arr)
        if self.terminal == "count":
            return F.coalesce(F.sum(F.size(arr)), F.lit(0)).cast("bigint")
        if self.terminal in ("sum", "avg"):
            kind = _sum_type(df, arr)
            strict = F.transform(arr, lambda e: F.when(e["x"].isNull(), F.raise_error(F.lit(f"{self.terminal} of null"))).otherwise(e["x"].cast(kind)))
            total = F.sum(F.aggregate(strict, F.lit(0).cast(kind), lambda a, b: (a + b).cast(kind)))
            return F.coalesce(total, F.lit(0).cast(kind)) if self.terminal == "sum" else total / F.nullif(F.sum(F.size(arr)), F.lit(0))
        if self.terminal == "min":
            best = F.transform(arr, lambda e: F.struct(as_column(self.key(e["x"])).alias("k"), e["x"].alias("x"))) if self.key else arr
            return (F.max(F.array_max(best)) if self.reverse else F.min(F.array_min(best)))["x"]
        out = F.flatten(F.collect_list(arr))
        return self._finish(F.array_distinct(out) if self.terminal == "distinct" else out)

    def _finish(self, wrapped: Column) -> Column:
        """Refinements on an array of wrapped elements, then unwrapped."""
        for step in self.post:
            if step[0] == "sort":
                _, key, reverse = step
                wrapped = F.transform(F.sort_array(_keyed(wrapped, key), asc=not reverse), lambda e: F.struct(e["x"].alias("x")))
            elif step[0] == "take":
                wrapped = F.slice(wrapped, 1, step[1])
            else:
                return F.try_element_at(wrapped, F.lit(1 if step[0] == "first" else -1))["x"]
        return F.transform(wrapped, lambda e: e["x"])


def _sum_type(df: DataFrame | None, arr: Column) -> str:
    """The type in which wrapped elements of ``arr`` are summed: bigint for whole numbers, the widest decimal of a scale, else double."""
    kind = df.select(arr).schema[0].dataType.elementType["x"].dataType if df is not None else None
    if isinstance(kind, T.DecimalType):
        return f"decimal(38,{kind.scale})"
    return "bigint" if isinstance(kind, T.IntegralType) else "double"


def _array_step(arr: Column, kind: str, f: Callable) -> Column:
    """One element step on an array of wrapped elements."""
    if kind == "map":
        return F.transform(arr, lambda e: F.struct(as_column(f(e["x"])).alias("x")))
    if kind == "mapcat":
        return F.flatten(F.transform(arr, lambda e: F.transform(F.coalesce(as_column(f(e["x"])), F.array()), lambda v: F.struct(v.alias("x")))))
    return F.filter(arr, lambda e: F.coalesce(as_column(f(e["x"])), F.lit(False)) == F.lit(kind == "filter"))


def _keyed(wrapped: Column, key: Callable | None) -> Column:
    return F.transform(wrapped, lambda e: F.struct(as_column(key(e["x"]) if key else e["x"]).alias("k"), e["x"].alias("x")))


@dataclass(frozen=True)
class FoldFn:
    """An opaque Python fold: see :func:`fold_fn`."""

    combine: Callable
    reduce: Callable
    post: Callable
    pre: Callable
    returns: str


def fold_fn(reducef: Callable, combinef: Callable | None = None, post: Callable | None = None, pre: Callable | None = None, returns: str = "double") -> FoldFn:
    """A user-defined fold.  ``combinef()`` seeds and ``combinef(a, b)`` merges, ``reducef(acc, v)`` adds.

    ``pre`` maps the elements of a partition (an iterable to an iterable), ``post``
    the last accumulator; ``returns`` is its DDL type.  Partitions reduce first and
    only accumulators are shuffled.  With ``reducef`` alone it also seeds and merges.
    """
    combinef = combinef or reducef
    assert_arity(reducef, 2, "reducef")
    assert_arity(combinef, 0, "combinef")
    assert_arity(combinef, 2, "combinef")
    assert_arity(post or (lambda x: x), 1, "post")
    assert_arity(pre or (lambda x: x), 1, "pre")
    return FoldFn(combinef, reducef, post or (lambda x: x), pre or (lambda x: x), returns)


#: The identity fold: the start of every chain, as in ``fold.filter(p).count()``.
fold = Fold()
