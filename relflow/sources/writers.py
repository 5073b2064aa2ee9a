"""Stores.  Each writes, replacing what the folder held, and returns its input relation."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from relflow.functions.lambdas import VALUE, quoted
from relflow.operators.setops import concat
from relflow.relation import Relation, relation
from relflow.sources import edn


def _text(df: DataFrame, location: str) -> None:
    df.write.mode("overwrite").text(location)


def _edn_lines(df: DataFrame, show: Callable[[Any], str]) -> DataFrame:
    kind = T.StructType([T.StructField(VALUE, T.StringType())])
    arrow = to_arrow_schema(kind)
    scalar = df.columns == [VALUE]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_pylist() if scalar else batch.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([show(edn.from_row(x)) for x in rows], pa.string())], schema=arrow)

    return df.mapInArrow(run, kind)


def _simple(t: T.DataType) -> bool:
    return isinstance(t, (T.StringType, T.IntegralType, T.BooleanType))


def store_string(location: str, rel: Relation | DataFrame) -> Relation:
    """One value for each line as text; null is an empty line."""
    rel = relation(rel)
    if rel.df.columns == [VALUE] and _simple(rel.df.schema[0].dataType):
        _text(rel.df.select(F.coalesce(F.col(VALUE).cast("string"), F.lit("")).alias(VALUE)), location)
    else:
        _text(_edn_lines(rel.df, lambda x: "" if x is None else edn.display(x)), location)
    return rel


def store_tsv(location: str, rel: Relation | DataFrame, delimiter: str = "\t") -> Relation:
    """Fields, or the items of an array ``value``, joined; null is ``nil``, nested data EDN."""
    rel = relation(rel)
    kinds = [f.dataType for f in rel.df.schema]
    array = rel.df.columns == [VALUE] and isinstance(kinds[0], T.ArrayType)
    as_text = lambda c: F.coalesce(c.cast("string"), F.lit("nil"))
    if array and _simple(kinds[0].elementType):
        line: Column = F.array_join(F.transform(F.col(VALUE), as_text), delimiter)
    elif not array and all(map(_simple, kinds)):
        line = F.concat_ws(delimiter, *[as_text(F.col(quoted(c))) for c in rel.df.columns])
    else:
        show = lambda x: delimiter.join(edn.display(v) for v in (x if isinstance(x, list) else x.values() if isinstance(x, dict) else [x]))
        _text(_edn_lines(rel.df, show), location)
        return rel
    _text(rel.df.select(line.alias(VALUE)), location)
    return rel


def store_csv(location: str, rel: Relation | DataFrame, separator: str = ",") -> Relation:
    rel = relation(rel)
    rel.df.write.mode("overwrite").csv(location, sep=separator, escape='"')
    return rel


def store_clj(location: str, rel: Relation | DataFrame) -> Relation:
    """One EDN form for each line; the columns are keywords."""
    rel = relation(rel)
    _text(_edn_lines(rel.df, edn.dumps), location)
    return rel


def store_json(location: str, rel: Relation | DataFrame, key_fn: Callable[[str], str] | None = None, value_fn: Callable | None = None) -> Relation:
    """One JSON object for each line, nulls included."""
    rel = relation(rel)
    cols = [(value_fn(c, F.col(quoted(c))) if value_fn else F.col(quoted(c))).alias(key_fn(c) if key_fn else c) for c in rel.df.columns]
    _text(rel.df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias(VALUE)), location)
    return rel


def store_binary(location: str, rel: Relation | DataFrame) -> Relation:
    rel = relation(rel)
    rel.df.write.mode("overwrite").parquet(location)
    return rel


def store_parquet(location: str, schema: T.StructType | None, rel: Relation | DataFrame) -> Relation:
    """The fields of ``schema``, cast to its types."""
    rel = relation(rel)
    if rel.df.columns == [VALUE] and (schema is None or schema.names != [VALUE]):
        raise ValueError("expected rows with named columns")
    df = rel.df.select(*[F.col(quoted(f.name)).cast(f.dataType).alias(f.name) for f in schema]) if schema else rel.df
    df.write.mode("overwrite").parquet(location)
    return rel


def store_tap(format: str, location: str, rel: Relation | DataFrame, **options: Any) -> Relation:
    """Any Spark sink."""
    rel = relation(rel)
    rel.df.write.format(format).options(**options).mode("overwrite").save(location)
    return rel


_STORES: dict[str, Callable] = {
    "string": store_string, "tsv": store_tsv, "csv": store_csv, "clj": store_clj, "json": store_json,
    "binary": store_binary, "parquet": lambda location, rel, schema=None: store_parquet(location, schema, rel),
}


def register_store(storage: str, writer: Callable[..., Relation]) -> None:
    """Adds a storage for :func:`store`."""
    _STORES[storage] = writer


def store(location: str, storage: str, rel: Relation | DataFrame, **options: Any) -> Relation:
    if storage not in _STORES:
        raise ValueError(f"no storage {storage!r}; there are {sorted(_STORES)}")
    return _STORES[storage](location, rel, **options)


def store_many(*outputs: tuple[Callable[[Relation], Relation], Relation], shared: DataFrame | None = None) -> Relation:
    """Runs several stores, given as (store of one relation, relation), and returns all their rows.

    ``shared`` is a common parent to hold in memory and on disk meanwhile.
    """
    if not outputs:
        raise ValueError("at least one output is needed")
    if shared is not None:
        shared.persist()
    try:
        return concat(*[write(rel) for write, rel in outputs])
    finally:
        if shared is not None:
            shared.unpersist()
