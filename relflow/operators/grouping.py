"""group_by, cogroup, reduce, into and fold.

A cogroup of n relations is one tagged union and one shuffle; folded sides are
conditional aggregates, so they are summed map-side.  A side that isn't folded
materialises its rows per key, as asked; use folds for hot keys.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from relflow.functions.folds import Fold, FoldFn, fold
from relflow.functions.lambdas import VALUE, as_column, assert_arity, quoted, row_of, to_columns, unwrap
from relflow.operators.joins import Select
from relflow.relation import Relation, relation

#: Distinct keys that a worker holds in one partial pass of an opaque fold before it hands them on.
PARTIAL_KEYS = 50_000


def group_by(rel: Relation | DataFrame, key: Callable, fold: Fold | FoldFn | None = None, parallel: int | None = None) -> Relation:
    """``key`` and ``values`` (an array) for each key, or ``key`` and ``value`` with a fold.

    Null is a key of its own.  A plain ``top`` fold keeps n rows for each key
    and partition before the shuffle, so a hot key stays small.
    """
    rel = relation(rel)
    assert_arity(key, 1, "key")
    if isinstance(fold, FoldFn):
        return _opaque_fold(rel, fold, key)
    if fold is not None and (spec := fold.top_spec()) is not None:
        return _group_top(rel, key, fold, spec)
    keyed = rel.df.select("*", as_column(key(rel.row)).alias("__key"))
    out = fold.compile(rel.row, None, rel.df).alias(VALUE) if fold else Fold().compile(rel.row).alias("values")
    grouped = keyed.groupBy("__key").agg(out).withColumnRenamed("__key", "key")
    # rows are folded where they are first, and only the groups are dealt anew
    return Relation(grouped.repartition(parallel, "key") if parallel else grouped)


def _group_top(rel: Relation, key: Callable | None, fold: Fold, spec: tuple) -> Relation:
    order_key, reverse, n = spec
    x, where = fold.elements(rel.row)
    by = as_column(order_key(x) if order_key else x)
    group = as_column(key(rel.row)) if key else F.lit(0)
    df = rel.df.select(group.alias("key"), F.struct(by.alias("k"), unwrap(x).alias("x")).alias("e"), (F.lit(True) if where is None else where).alias("w"))
    if key is None:
        kept = df.where("w").orderBy(F.col("e").desc() if reverse else F.col("e").asc()).limit(n)
    else:
        w = Window.partitionBy("key").orderBy(F.col("w").desc(), F.col("e").desc() if reverse else F.col("e").asc())
        kept = df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n)
    best = F.sort_array(F.collect_list(F.when(F.col("w"), F.col("e"))), asc=not reverse)
    out = kept.groupBy("key").agg(F.transform(best, lambda e: e["x"]).alias(VALUE))
    return Relation(out if key else out.select(VALUE))


def _grouped(selects: list[Select], join_nils: bool, finish: Callable[[list, list, DataFrame], list[Column]]) -> DataFrame:
    """The tagged union of the sides, grouped once by key (and by side, for null keys)."""
    parts, rows = [], []
    for i, s in enumerate(selects):
        df = s.rel.df
        parts.append(df.select(as_column(s.key(s.rel.row)).alias("key"), F.lit(i).alias("__tag"), *[F.col(quoted(c)).alias(f"__{i}_{c}") for c in df.columns]))
        rows.append(row_of(df, lambda n, i=i: f"__{i}_{n}"))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p, allowMissingColumns=True)
    nil = F.lit(None).cast("int") if join_nils else F.when(F.col("key").isNull(), F.col("__tag"))
    tags = [F.col("__tag") == i for i in range(len(selects))]
    return union.withColumn("__nil", nil).groupBy("key", "__nil").agg(*finish(rows, tags, union))


def cogroup(selects: list[Select], f: Callable | None = None, join_nils: bool = False) -> Relation:
    """f(key, side0, ..., sideN) for each key of any side.

    A side is an array of its rows, null if it has none, or its fold (a fold of
    nothing: count 0, sum 0, avg null).  ``type="required"`` drops keys that the
    side lacks.  Null keys make one group for each side unless ``join_nils``.
    """
    if f is not None:
        assert_arity(f, 1 + len(selects), "cogroup function")

    def finish(rows: list, tags: list, df: DataFrame) -> list[Column]:
        out = []
        for i, (s, row, tag) in enumerate(zip(selects, rows, tags, strict=True)):
            n = F.count(F.when(tag, F.lit(1)))
            out += [n.alias(f"__n{i}"), (s.fold.compile(row, tag, df) if s.fold else F.when(n > 0, Fold().compile(row, tag))).alias(f"__v{i}")]
        return out

    df = _grouped(selects, join_nils, finish)
    for i, s in enumerate(selects):
        if (s.type or "optional") == "required":
            df = df.where(F.col(f"__n{i}") > 0)
    sides = [F.col(f"__v{i}") for i in range(len(selects))]
    if f is None:
        return Relation(df.select("key", *[c.alias(f"_{i}") for i, c in enumerate(sides)]))
    return Relation(df.select(*to_columns(f(F.col("key"), *sides))))


def fold_relation(rel: Relation | DataFrame, f: Fold | FoldFn) -> Relation:
    """The whole relation folded to one row; an empty relation gives no row, even for count."""
    rel = relation(rel)
    if isinstance(f, FoldFn):
        return Relation(_opaque_fold(rel, f, None).df.select(VALUE))
    if f.top_spec() is not None:
        return _group_top(rel, None, f, f.top_spec())
    df = rel.df.agg(F.count(F.lit(1)).alias("__n"), f.compile(rel.row, None, rel.df).alias(VALUE))
    return Relation(df.where(F.col("__n") > 0).select(VALUE))


def into(rel: Relation | DataFrame, kind: str = "list") -> Relation:
    """All values poured into one "list", "set" or "map" (of pairs _1, _2); empty gives no row."""
    rel = relation(rel)
    if kind == "map":
        pairs = rel.df.agg(F.count(F.lit(1)).alias("__n"), F.map_from_entries(F.collect_list(F.struct("_1", "_2"))).alias(VALUE))
        return Relation(pairs.where(F.col("__n") > 0).select(VALUE))
    if kind not in ("list", "set"):
        raise ValueError("kind must be 'list', 'set' or 'map'")
    return fold_relation(rel, fold.distinct() if kind == "set" else fold.vec())


def reduce_relation(rel: Relation | DataFrame, f: Callable, *initial: Any, returns: str = "double") -> Relation:
    """f(acc, value) over the whole relation, opaque and in one task: use folds for anything large.

    ``initial``, if given, is the first accumulator, else the first value is.
    The order is that of partitions.  Empty gives no row.  The one task streams
    Arrow batches and sorts nothing, so memory stays bounded; time doesn't.
    Shuffles of ``rel`` run at once, since the number of its partitions is needed.
    """
    assert_arity(f, 2, "reduce")
    rel = relation(rel)
    scalar = rel.df.columns == [VALUE]
    schema = T.StructType([T.StructField(VALUE, _type_of(rel.df, returns))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        acc, some, last = list(initial), False, -1
        for batch in batches:
            at = np.concatenate([[last], batch.column(batch.num_columns - 1).to_numpy()])
            if (at[1:] <= at[:-1]).any():
                raise RuntimeError("the shuffle doesn't keep the order of rows")
            last = at[-1]
            for x in batch.column(0).to_pylist() if scalar else batch.select(batch.schema.names[:-1]).to_pylist():
                acc, some = [f(acc[0], x) if acc else x], True
        if some:
            yield pa.RecordBatch.from_pylist([{VALUE: acc[0]}], arrow)

    return Relation(_in_order(rel.df).mapInArrow(run, schema))


def _in_order(df: DataFrame) -> DataFrame:
    """``df`` in one task in the order of its partitions, with ``__at``, which rises; what comes before stays parallel.

    A partition is shuffled to the one of its number, whose rows so come from one
    task and in order, and the task reads these one after the other.
    """
    spark, jdf = df.sparkSession, df._jdf
    # the partitions as they are now, so that a second plan can't deal them otherwise
    parts = jdf.queryExecution().toRdd()
    fixed = DataFrame(spark._jsparkSession.internalCreateDataFrame(parts, jdf.schema(), False), spark)
    # the number of the partition stands above bit 33
    numbered = fixed.withColumn("__at", F.monotonically_increasing_id())
    return numbered.repartitionById(max(1, parts.getNumPartitions()), F.shiftright("__at", 33).cast("int")).coalesce(1)


def _type_of(df: DataFrame, ddl: str) -> T.DataType:
    return df.sparkSession.createDataFrame([], f"{VALUE} {ddl}").schema[0].dataType


def _opaque_fold(rel: Relation, f: FoldFn, key: Callable | None) -> Relation:
    """Partitions reduce to one pickled accumulator for each key; only these are shuffled.

    A key gets as many accumulators as there are partitions at most.
    """
    group = as_column(key(rel.row)) if key else F.lit(0)
    scalar = rel.df.columns == [VALUE]
    value = F.col(VALUE) if scalar else F.struct(*[F.col(quoted(c)) for c in rel.df.columns])
    df = rel.df.select(group.alias("key"), value.alias("x"))
    key_type = df.schema["key"].dataType
    schema = T.StructType([T.StructField("key", key_type), T.StructField("acc", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def hand_on(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"key": k, "acc": pickle.dumps(a)} for k, a in held.values()], arrow)

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            groups: dict = {}
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                groups.setdefault(k if isinstance(k, (str, int, bytes)) else pickle.dumps(k), (k, []))[1].append(x)
            for h, (k, xs) in groups.items():
                acc = held[h][1] if h in held else f.combine()
                for x in f.pre(xs):
                    acc = f.reduce(acc, x)
                held[h] = (k, acc)
            if len(held) > PARTIAL_KEYS:
                yield hand_on(held)
                held = {}
        if held:
            yield hand_on(held)

    out = T.StructType([T.StructField("key", key_type), T.StructField(VALUE, _type_of(rel.df, f.returns))])

    def merge(pdf):  # noqa: ANN001, ANN202
        import pandas as pd  # here, since all workers import this module and few need pandas

        acc = f.combine()
        for a in pdf["acc"]:
            acc = f.combine(acc, pickle.loads(a))
        return pd.DataFrame({"key": pdf["key"][:1], VALUE: [f.post(acc)]})

    return Relation(df.mapInArrow(partial, schema).groupBy("key").applyInPandas(merge, out))
