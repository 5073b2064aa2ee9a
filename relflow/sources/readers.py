"""Loaders: text, delimited text, JSON, EDN, Parquet, Avro, and any Spark format.

Text loaders read a file or a folder and its subfolders, ``.gz`` included.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Iterable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from relflow.functions.lambdas import VALUE
from relflow.relation import Relation
from relflow.sources import edn
from relflow.sources.avro import avro_schema, read_avro_file


def _lines(spark: SparkSession, location: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").text(location)


def load_string(spark: SparkSession, location: str) -> Relation:
    """One string for each line."""
    return Relation(_lines(spark, location))


def split_fields(c: Any, delimiter: str | re.Pattern) -> Any:
    """Fields of a line.  A string delimiter is literal (blank: tab), a pattern is a regex; empty fields stay."""
    if isinstance(delimiter, re.Pattern):
        return F.split(c, delimiter.pattern, -1)
    d = delimiter if delimiter and (delimiter.strip() or "\t" in delimiter) else "\t"
    return F.split(c, "\\Q" + d + "\\E", -1)


def load_tsv(spark: SparkSession, location: str, delimiter: str | re.Pattern = "\t") -> Relation:
    """An array of strings for each line."""
    return Relation(_lines(spark, location).select(split_fields(F.col(VALUE), delimiter).alias(VALUE)))


def load_lazy(spark: SparkSession, location: str, delimiter: str | re.Pattern = "\t") -> Relation:
    """As load_tsv: every relation is lazy."""
    return load_tsv(spark, location, delimiter)


def load_csv(spark: SparkSession, location: str, separator: str = ",", quotor: str = '"', schema: str | T.StructType | None = None) -> Relation:
    """RFC-4180 lines without line breaks in cells: an array of strings, ragged rows too; with a schema, columns."""
    if schema is not None:
        return Relation(spark.read.option("recursiveFileLookup", "true").schema(schema).csv(location, sep=separator, quote=quotor, escape=quotor))
    kind = T.StructType([T.StructField(VALUE, T.ArrayType(T.StringType()))])
    arrow = to_arrow_schema(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            cells = [next(csv.reader([x], delimiter=separator, quotechar=quotor, doublequote=True), [""]) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(cells, arrow.field(0).type)], schema=arrow)

    return Relation(_lines(spark, location).mapInArrow(run, kind))


def load_clj(spark: SparkSession, location: str, schema: str | T.StructType | None = None) -> Relation:
    """One EDN form for each line: columns if there is a schema, else a variant ``value``."""
    if schema is None:
        kind = T.StructType([T.StructField(VALUE, T.StringType())])
        return Relation(_parse(_lines(spark, location), kind, lambda x, _: {VALUE: edn.to_json(x)}).select(F.parse_json(VALUE).alias(VALUE)))
    kind = schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema
    whole = kind.names == [VALUE]
    return Relation(_parse(_lines(spark, location), kind, lambda x, a: {VALUE: edn.plain(x, a.field(0).type)} if whole else edn.plain(x, pa.struct(list(a)))))


def _parse(lines: DataFrame, kind: T.StructType, f: Callable) -> DataFrame:
    arrow = to_arrow_schema(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([f(edn.loads(x), arrow) for x in batch.column(0).to_pylist()], arrow)

    return lines.mapInArrow(run, kind)


def load_json(spark: SparkSession, location: str, schema: str | T.StructType | None = None, key_fn: Callable[[str], str] | None = None, value_fn: Callable | None = None) -> Relation:
    """One JSON value for each line: columns by the schema, else a variant ``value``.

    ``key_fn`` renames columns, ``value_fn(name, column)`` maps them; both need a schema.
    """
    if schema is None:
        if key_fn or value_fn:
            raise ValueError("key_fn and value_fn need a schema: a variant has no columns")
        return Relation(_lines(spark, location).select(F.parse_json(VALUE).alias(VALUE)))
    df = spark.read.option("recursiveFileLookup", "true").schema(schema).json(location)
    return Relation(df.select(*[(value_fn(c, F.col(c)) if value_fn else F.col(c)).alias(key_fn(c) if key_fn else c) for c in df.columns]))


def load_parquet(spark: SparkSession, location: str, schema: T.StructType | None = None) -> Relation:
    """The columns of ``schema`` only, or all."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return Relation(reader.option("recursiveFileLookup", "true").parquet(location))


def load_binary(spark: SparkSession, location: str, fields: list[str] | None = None) -> Relation:
    """The internal format: Parquet."""
    df = spark.read.parquet(location)
    return Relation(df.select(*fields) if fields else df)


def load_avro(spark: SparkSession, location: str, schema: str | dict) -> Relation:
    """Records by a reader schema: its defaults fill fields that the files lack.

    Enums and text become strings; false stays false.  Files are read whole, one
    to a task at least, so they should not exceed some hundred MB.
    """
    kind, parsed = avro_schema(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list = []
                for row in read_avro_file(content.as_py(), parsed):
                    rows.append(row)
                    if len(rows) == 5_000:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, arrow)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(location)
    return Relation(files.select("content").mapInArrow(run, kind))


def load_tap(spark: SparkSession, format: str, location: str | None = None, f: Callable | None = None, **options: Any) -> Relation:
    """Any Spark source."""
    rel = Relation(spark.read.format(format).options(**options).load(location))
    return rel.map(f) if f else rel


_LOADERS: dict[str, Callable] = {
    "string": load_string, "tsv": load_tsv, "csv": load_csv, "lazy": load_lazy, "clj": load_clj,
    "json": load_json, "parquet": load_parquet, "binary": load_binary, "avro": load_avro,
}


def register_loader(storage: str, loader: Callable[..., Relation]) -> None:
    """Adds a storage for :func:`load`."""
    _LOADERS[storage] = loader


def load(spark: SparkSession, location: str, storage: str, filter: str | None = None, **options: Any) -> Relation:
    """By storage name, with an optional SQL predicate that the source may push down."""
    if storage not in _LOADERS:
        raise ValueError(f"no storage {storage!r}; there are {sorted(_LOADERS)}")
    rel = _LOADERS[storage](spark, location, **options)
    return rel.native_filter(filter) if filter else rel
