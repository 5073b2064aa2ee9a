"""User lambdas: called once with symbolic rows, they yield column expressions.

A relation with the single column ``value`` is *scalar*: its lambdas get that
Column itself.  Any other relation hands its lambdas a :class:`Row` of Columns.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALUE = "value"


class Row:
    """Named Columns of one relation (``row.a`` or ``row["a"]``).

    ``row.present`` tells whether an outer join or a cogroup found the row.
    """

    def __init__(self, columns: dict[str, Column], present: Column | None = None):
        self._columns = columns
        self.present = F.lit(True) if present is None else present

    def __getattr__(self, name: str) -> Column:
        try:
            return self.__dict__["_columns"][name]
        except KeyError:
            raise AttributeError(f"no column {name!r}; there are {list(self.__dict__.get('_columns', ()))}") from None

    def __getitem__(self, name: str) -> Column:
        return self._columns[name]

    def keys(self) -> list[str]:
        return list(self._columns)

    def as_struct(self) -> Column:
        return F.struct(*[c.alias(n) for n, c in self._columns.items()])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def is_scalar(names: Iterable[str]) -> bool:
    return list(names) == [VALUE]


def row_of(df: DataFrame, rename: Callable[[str], str] = lambda n: n, present: Column | None = None) -> Any:
    """What a lambda over ``df`` gets: a Column if it is scalar, else a Row."""
    columns = {n: F.col(quoted(rename(n))) for n in df.columns}
    return columns[VALUE] if is_scalar(columns) else Row(columns, present)


def assert_arity(f: Callable, n: int, what: str = "function") -> None:
    """Raise TypeError, before any job starts, if ``f`` can't take ``n`` positional arguments."""
    try:
        signature = inspect.signature(f)
    except (TypeError, ValueError):
        return
    try:
        signature.bind(*range(n))
    except TypeError as e:
        raise TypeError(f"{what} must take {n} argument(s): {e}") from None


def to_columns(result: Any) -> list[Column]:
    """Columns of a lambda's result: Row and dict keep names, a tuple is _1.._n, all else is ``value``."""
    if isinstance(result, Row):
        result = {n: result[n] for n in result.keys()}
    if isinstance(result, dict):
        return [as_column(v).alias(n) for n, v in result.items()]
    if isinstance(result, tuple):
        return [as_column(v).alias(f"_{i + 1}") for i, v in enumerate(result)]
    return [as_column(result).alias(VALUE)]


def as_column(x: Any) -> Column:
    """One Column: structs for Row, dict and tuple, arrays for lists, literals for host values."""
    if isinstance(x, Column):
        return x
    if isinstance(x, Row):
        return x.as_struct()
    if isinstance(x, dict):
        return F.struct(*[as_column(v).alias(n) for n, v in x.items()])
    if isinstance(x, tuple):
        return F.struct(*[as_column(v).alias(f"_{i + 1}") for i, v in enumerate(x)])
    if isinstance(x, list):
        return F.array(*[as_column(v) for v in x])
    return F.lit(x)


def unwrap(x: Any) -> Any:
    """The value that a collected element holds: Rows become structs."""
    return x.as_struct() if isinstance(x, Row) else as_column(x)
