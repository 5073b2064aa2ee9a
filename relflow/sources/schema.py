"""Parquet schema builders: ``message("m", int32("a"), binary("s", "optional"))``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import types as T


def _field(kind: T.DataType) -> Callable[..., T.StructField]:
    def build(name: str, repetition: str = "required") -> T.StructField:
        if repetition not in ("required", "optional", "repeated"):
            raise ValueError("repetition must be 'required', 'optional' or 'repeated'")
        return T.StructField(name, T.ArrayType(kind) if repetition == "repeated" else kind, repetition != "required")

    return build


int32 = _field(T.IntegerType())
int64 = _field(T.LongType())
float_ = _field(T.FloatType())
double = _field(T.DoubleType())
boolean = _field(T.BooleanType())
#: Binary columns hold text.
binary = _field(T.StringType())


def message(name: str, *fields: T.StructField) -> T.StructType:
    for f in fields:
        if not isinstance(f, T.StructField):
            raise TypeError(f"{name}: not a field: {f!r}")
    return T.StructType(list(fields))
