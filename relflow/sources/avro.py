"""Avro object container files: decoding by the writer's schema, resolved to a reader's."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from typing import Any

from pyspark.sql import types as T

MAGIC = b"Obj\x01"
_PRIMITIVE = {
    "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(),
    "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType(), "null": T.NullType(),
}


def avro_schema(schema: str | dict) -> tuple[T.StructType, dict]:
    """The Spark type of a reader schema, and the schema parsed."""
    parsed = json.loads(schema) if isinstance(schema, str) else schema
    if parsed.get("type") != "record":
        raise ValueError("the schema of a file must be a record")
    return _spark_type(parsed, {}), parsed


def _named(schema: Any, names: dict) -> Any:
    """The definition behind a name."""
    while isinstance(schema, dict) and isinstance(schema.get("type"), (dict, list)) and "fields" not in schema:
        schema = schema["type"]
    if isinstance(schema, dict) and schema.get("name"):
        names[schema["name"]] = schema
        if schema.get("namespace"):
            names[f"{schema['namespace']}.{schema['name']}"] = schema
    return names.get(schema, schema) if isinstance(schema, str) else schema


def _spark_type(schema: Any, names: dict) -> T.DataType:
    schema = _named(schema, names)
    if isinstance(schema, list):
        rest = [s for s in schema if s != "null"]
        if len(rest) != 1:
            raise ValueError("only unions of null and one type are supported")
        return _spark_type(rest[0], names)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if kind == "record":
        return T.StructType([T.StructField(f["name"], _spark_type(f["type"], names), True) for f in schema["fields"]])
    if kind == "array":
        return T.ArrayType(_spark_type(schema["items"], names))
    if kind == "map":
        return T.MapType(T.StringType(), _spark_type(schema["values"], names))
    if kind == "enum":
        return T.StringType()
    if kind == "fixed":
        return T.BinaryType()
    return _PRIMITIVE[kind]


class _Bytes:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("the Avro file ends too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def long(self) -> int:
        """A zig-zag varint."""
        value = shift = 0
        while True:
            b = self.take(1)[0]
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return (value >> 1) ^ -(value & 1)
            shift += 7


def _blocks(data: _Bytes) -> Iterator[None]:
    """Once for each item of an array or map."""
    while n := data.long():
        if n < 0:
            n = -n
            data.long()
        for _ in range(n):
            yield


def _decode(data: _Bytes, schema: Any, names: dict) -> Any:
    schema = _named(schema, names)
    if isinstance(schema, list):
        return _decode(data, schema[data.long()], names)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if kind == "record":
        return {f["name"]: _decode(data, f["type"], names) for f in schema["fields"]}
    if kind == "array":
        return [_decode(data, schema["items"], names) for _ in _blocks(data)]
    if kind == "map":
        return {data.take(data.long()).decode(): _decode(data, schema["values"], names) for _ in _blocks(data)}
    if kind == "enum":
        return schema["symbols"][data.long()]
    if kind == "fixed":
        return data.take(schema["size"])
    if kind in ("int", "long"):
        return data.long()
    if kind in ("string", "bytes"):
        raw = data.take(data.long())
        return raw.decode() if kind == "string" else raw
    if kind == "boolean":
        return data.take(1) == b"\x01"
    if kind in ("float", "double"):
        return struct.unpack("<f", data.take(4))[0] if kind == "float" else struct.unpack("<d", data.take(8))[0]
    if kind == "null":
        return None
    raise ValueError(f"unknown Avro type {kind!r}")


def _resolve(value: Any, schema: Any, names: dict) -> Any:
    """A decoded value as the reader's schema has it."""
    schema = _named(schema, names)
    if value is None:
        return None
    if isinstance(schema, list):
        return _resolve(value, next(s for s in schema if s != "null"), names)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if kind == "record":
        return {f["name"]: _resolve(value.get(f["name"], f.get("default")), f["type"], names) for f in schema["fields"]}
    if kind == "array":
        return [_resolve(v, schema["items"], names) for v in value]
    if kind == "map":
        return [(k, _resolve(v, schema["values"], names)) for k, v in value.items()]
    return float(value) if kind in ("float", "double") else value


def read_avro_file(content: bytes, reader: dict) -> Iterator[dict]:
    """The rows of a container file (codecs null and deflate)."""
    data = _Bytes(content)
    if data.take(4) != MAGIC:
        raise ValueError("not an Avro container file")
    meta = _decode(data, {"type": "map", "values": "bytes"}, {})
    sync, codec = data.take(16), meta.get("avro.codec", b"null")
    if codec not in (b"null", b"deflate"):
        raise ValueError(f"unsupported Avro codec {codec!r}")
    writer = json.loads(meta["avro.schema"])
    while data.at < len(content):
        n, block = data.long(), data.take(data.long())
        rows, names, own = _Bytes(zlib.decompress(block, -15) if codec == b"deflate" else block), {}, {}
        for _ in range(n):
            yield _resolve(_decode(rows, writer, names), reader, own)
        if data.take(16) != sync:
            raise ValueError("an Avro block is damaged")
