"""The Relation: one DataFrame, and the order that a sort has given it."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from relflow.functions.lambdas import VALUE, as_column, assert_arity, quoted, row_of, to_columns


class Relation:
    """A lazy relation.  Methods return new relations; nothing runs until an action."""

    def __init__(self, df: DataFrame, order: tuple[tuple[Column, bool], ...] = ()):
        self.df = df
        self.order = order

    @property
    def row(self) -> Any:
        return row_of(self.df)

    # rows ------------------------------------------------------------------
    def map(self, f: Callable, schema: str | T.StructType | None = None) -> Relation:
        """One row out for each row in; null results stay.

        With ``schema``, ``f`` is opaque Python: it gets the value or a dict and
        returns a value, dict or tuple, in Arrow batches on the executors.
        """
        assert_arity(f, 1, "map")
        if schema is not None:
            return Relation(opaque(self.df, lambda x: (f(x),), schema))
        return Relation(self.df.select(*to_columns(f(self.row))))

    def mapcat(self, f: Callable, schema: str | T.StructType | None = None) -> Relation:
        """0..n rows for each row, from an array Column; a null or empty array gives none."""
        assert_arity(f, 1, "mapcat")
        if schema is not None:
            return Relation(opaque(self.df, lambda x: f(x) or (), schema))
        return Relation(self.df.select(F.explode(as_column(f(self.row))).alias(VALUE)))

    def bind(self, f: Callable) -> Relation:
        """0..n rows with several columns, from an array of structs."""
        return Relation(self.df.select(F.inline(as_column(f(self.row)))))

    def project(self, *fields: str, flatten: Iterable[str] = (), **named: Callable) -> Relation:
        """Fields, computed fields, and array fields to flatten; several of these make their product."""
        df = self.df.select(*[F.col(quoted(c)) for c in fields], *[as_column(f(self.row)).alias(n) for n, f in named.items()])
        for name in flatten:
            df = df.withColumn(name, F.explode(F.col(quoted(name))))
        return Relation(df)

    def head_fields(self, n: int, f: Callable) -> Relation:
        """Of rows whose ``value`` is an array: its first ``n`` items as _1.._n, and f(rest) as ``value``."""
        value = F.col(VALUE)
        rest = F.slice(value, n + 1, F.greatest(F.size(value) - n, F.lit(0)))
        return Relation(self.df.select(*[F.try_element_at(value, F.lit(i + 1)).alias(f"_{i + 1}") for i in range(n)], as_column(f(rest)).alias(VALUE)))

    def alias(self, name: str) -> Relation:
        return Relation(self.df.alias(name), self.order)

    def filter(self, p: Callable) -> Relation:
        """Rows whose predicate is true; null is not."""
        assert_arity(p, 1, "filter")
        return Relation(self.df.where(as_column(p(self.row))), self.order)

    def remove(self, p: Callable) -> Relation:
        """Rows whose predicate is not true; null is kept."""
        assert_arity(p, 1, "remove")
        return Relation(self.df.where(~F.coalesce(as_column(p(self.row)), F.lit(False))), self.order)

    def take(self, n: int) -> Relation:
        if not isinstance(n, int) or n <= 0:
            raise ValueError("n must be a positive integer")
        return Relation(self.df.limit(n), self.order)

    def sample(self, p: float, seed: int | None = None) -> Relation:
        """Each row with probability ``p``."""
        if not 0.0 <= p <= 1.0:
            raise ValueError("p must be from 0.0 to 1.0")
        return Relation(self.df.sample(withReplacement=False, fraction=float(p), seed=seed))

    # order -----------------------------------------------------------------
    def sort(self, comp: str = "asc", parallel: int | None = None) -> Relation:
        """Total order by all columns; nulls first ascending, last descending."""
        return self.sort_by(lambda r: r if isinstance(r, Column) else tuple(r[n] for n in r.keys()), comp, parallel)

    def sort_by(self, key: Callable, comp: str = "asc", parallel: int | None = None) -> Relation:
        """Order by a key, or by a tuple of keys.  A range partitioning, not one reducer."""
        if comp not in ("asc", "desc"):
            raise ValueError("comp must be 'asc' or 'desc'")
        assert_arity(key, 1, "sort_by")
        keys = key(self.row)
        keys = keys if isinstance(keys, tuple) else (keys,)
        order = tuple((as_column(k), comp == "asc") for k in keys)
        by = [k.asc() if asc else k.desc() for k, asc in order]
        if parallel:
            return Relation(self.df.repartitionByRange(parallel, *by).sortWithinPartitions(*by), order)
        return Relation(self.df.orderBy(*by), order)

    def indexed(self, ties: str = "sequential", name: str = "index") -> Relation:
        """Adds a 0-based position (bigint) to each row.

        ``ties`` is "sequential", or after a sort "rank" or "dense": equal keys
        then share an index.  Positions are partition offsets plus positions in the
        partition, so no task sees all rows; ranks are joined to their keys.
        """
        if ties not in ("sequential", "rank", "dense"):
            raise ValueError("ties must be 'sequential', 'rank' or 'dense'")
        if ties != "sequential":
            if not self.order:
                raise ValueError("ties are defined after a sort only")
            return self._ranked(ties, name)
        if name in self.df.columns:
            raise ValueError(f"there is a column {name!r}")
        schema = T.StructType([T.StructField(name, T.LongType(), False), *self.df.schema.fields])
        rows = self.df.rdd.zipWithIndex().map(lambda x: (x[1], *x[0]))
        return Relation(self.df.sparkSession.createDataFrame(rows, schema, verifySchema=False))

    def _ranked(self, ties: str, name: str) -> Relation:
        """Keys are counted, their counts summed over range partitions, and the sums joined back."""
        keys = [F.col(f"__k{i}") for i in range(len(self.order))]
        df = self.df.select("*", *[k.alias(f"__k{i}") for i, (k, _) in enumerate(self.order)])
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        ordered = [k.asc() if asc else k.desc() for k, (_, asc) in zip(keys, self.order, strict=True)]
        parts = counts.repartitionByRange(*ordered).withColumn("__p", F.spark_partition_id())
        weight = F.lit(1) if ties == "dense" else F.col("__n")
        offsets = parts.groupBy("__p").agg(F.sum(weight).alias("__w"))
        offsets = offsets.select("__p", F.coalesce(F.sum("__w").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
        within = Window.partitionBy("__p").orderBy(*ordered).rowsBetween(Window.unboundedPreceding, -1)
        ranks = parts.withColumn("__r", F.coalesce(F.sum(weight).over(within), F.lit(0))).join(offsets, "__p").select(*[k.alias(f"__j{i}") for i, k in enumerate(keys)], (F.col("__r") + F.col("__o")).cast("bigint").alias(name))
        matched = None
        for i, k in enumerate(keys):
            c = k.eqNullSafe(F.col(f"__j{i}"))
            matched = c if matched is None else matched & c
        return Relation(df.join(ranks, matched).select(name, *[F.col(quoted(c)) for c in self.df.columns]))

    def map_indexed(self, f: Callable, ties: str = "sequential") -> Relation:
        """f(index, value), 0-based."""
        assert_arity(f, 2, "map_indexed")
        out = self.indexed(ties, "__index")
        return Relation(out.df.select(*to_columns(f(F.col("__index"), self.row))))

    # others ----------------------------------------------------------------
    def native_filter(self, predicate: str) -> Relation:
        """A SQL predicate next to the load: Parquet gets it as a pushed filter."""
        return Relation(self.df.where(predicate), self.order)

    def debug_tap(self, location: str) -> Relation:
        """Writes ``type<TAB>value`` of every field to a folder, and goes on."""
        lines = F.concat_ws("\n", *[F.concat_ws("\t", F.typeof(F.col(quoted(c))), F.coalesce(F.to_json(F.struct(F.col(quoted(c)))), F.lit(""))) for c in self.df.columns])
        self.df.select(lines.alias(VALUE)).write.mode("overwrite").text(location)
        return self

    def dump(self, n: int | None = None) -> list:
        return dump(self, n)

    @property
    def columns(self) -> list[str]:
        return self.df.columns


def opaque(df: DataFrame, f: Callable, schema: str | T.StructType) -> DataFrame:
    """Rows of ``f`` (0..n for each row), in Arrow batches.  ``f`` gets a value or a dict."""
    spark = df.sparkSession
    kind = schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema
    names, scalar = kind.names, df.columns == [VALUE]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def as_dict(x: Any) -> dict:
        return x if isinstance(x, dict) else dict(zip(names, x if isinstance(x, tuple) else (x,), strict=True))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_pylist() if scalar else batch.to_pylist()
            yield pa.RecordBatch.from_pylist([as_dict(y) for x in rows for y in f(x)], arrow)

    return df.mapInArrow(run, kind)


def relation(df: DataFrame | Relation) -> Relation:
    return df if isinstance(df, Relation) else Relation(df)


def returning(spark: SparkSession, data: list, schema: str | T.StructType) -> Relation:
    """A constant relation; an empty list is legal.  Scalar rows need the schema ``value <type>``."""
    rows = [x if isinstance(x, (tuple, dict)) else (x,) for x in data]
    return Relation(spark.createDataFrame(rows, schema))


def constantly(rel: Relation) -> Callable[..., Relation]:
    """A function of any arguments that returns ``rel``: stands in for a loader in tests."""
    return lambda *a, **k: rel


def dump(rel: Relation | DataFrame, n: int | None = None) -> list:
    """Values of the relation on the driver: of its one column, else Rows.  ``n`` bounds them."""
    df = relation(rel).df
    rows = df.collect() if n is None else df.take(n)
    return [r[0] for r in rows] if len(df.columns) == 1 else rows
