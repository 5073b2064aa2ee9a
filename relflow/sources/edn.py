"""EDN, the text format of nested data, to and from Python values.

Keywords are :class:`Keyword` (a str without its colon), symbols :class:`Symbol`,
characters one-letter strings, sets frozensets, lists tuples, vectors lists.
Tagged values keep their value and lose the tag; ``#_`` drops the next form.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal
from fractions import Fraction
from typing import Any

import pyarrow as pa


class Keyword(str):
    """A keyword."""

    __slots__ = ()


class Symbol(str):
    """A symbol."""

    __slots__ = ()


class EdnError(ValueError):
    """Text that is not EDN."""


_SPACE = re.compile(r"(?:[\s,]|;[^\n]*)*")
_ATOM = re.compile(r"[^\s,;()\[\]{}\"]+")
_TEXT = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S)
#: The names that the format gives to characters and its string escapes.
_CHARS = {"newline": "\n", "return": "\r", "space": " ", "tab": "\t", "formfeed": "\f", "backspace": "\b"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", '"': '"', "\\": "\\"}
_CLOSE = {"(": ")", "[": "]", "{": "}"}


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def skip(self) -> str:
        self.at = _SPACE.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def until(self, close: str) -> list:
        items = []
        while (c := self.skip()) != close:
            if not c:
                raise EdnError(f"{close!r} is missing")
            if self.text.startswith("#_", self.at):
                self.at += 2
                self.form()
            else:
                items.append(self.form())
        self.at += 1
        return items

    def form(self) -> Any:
        c = self.skip()
        if not c:
            raise EdnError("nothing to read")
        if c == '"':
            if not (m := _TEXT.match(self.text, self.at)):
                raise EdnError("a string does not end")
            self.at = m.end()
            return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda e: chr(int(e[1][1:], 16)) if len(e[1]) == 5 else _escape(e[1]), m[1], flags=re.S)
        if c in _CLOSE:
            self.at += 1
            items = self.until(_CLOSE[c])
            return {"(": tuple, "[": list}[c](items) if c != "{" else _pairs(items)
        if c == "#":
            return self.dispatch()
        if c == "\\":
            m = re.compile(r"\\(\w+|.)", re.S).match(self.text, self.at)
            self.at = m.end()
            return _CHARS.get(m[1], chr(int(m[1][1:], 16)) if re.fullmatch("u[0-9a-fA-F]{4}", m[1]) else m[1][:1])
        if not (m := _ATOM.match(self.text, self.at)):
            raise EdnError(f"unexpected {c!r}")
        self.at = m.end()
        return atom(m[0])

    def dispatch(self) -> Any:
        if self.text.startswith("#{", self.at):
            self.at += 2
            return frozenset(_hashable(x) for x in self.until("}"))
        if self.text.startswith("#_", self.at):
            self.at += 2
            self.form()
            return self.form()
        m = _ATOM.match(self.text, self.at + 1)
        if not m:
            raise EdnError("a tag is missing")
        self.at = m.end()
        return self.form()


def _escape(c: str) -> str:
    if c not in _ESCAPES:
        raise EdnError(f"unknown escape \\{c}")
    return _ESCAPES[c]


def _hashable(x: Any) -> Any:
    return tuple(map(_hashable, x)) if isinstance(x, (list, tuple)) else x


def _pairs(items: list) -> dict:
    if len(items) % 2:
        raise EdnError("a map needs an even number of forms")
    return {_hashable(k): v for k, v in zip(items[::2], items[1::2], strict=True)}


def atom(s: str) -> Any:
    """A literal: nil, boolean, number, keyword or symbol."""
    if s in ("nil", "true", "false"):
        return {"nil": None, "true": True, "false": False}[s]
    if s[0] == ":":
        return Keyword(s[1:])
    if re.fullmatch(r"[+-]?\d+N?", s):
        return int(s.rstrip("N"))
    if re.fullmatch(r"[+-]?\d+/\d+", s):
        return Fraction(s)
    if re.fullmatch(r"[+-]?\d+(\.\d*)?([eE][+-]?\d+)?M?", s):
        return Decimal(s[:-1]) if s.endswith("M") else float(s)
    return Symbol(s)


def loads(text: str) -> Any:
    """The first form of ``text``."""
    return _Reader(text).form()


def dumps(x: Any) -> str:
    """Readable EDN; strings are quoted."""
    if x is None:
        return "nil"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, Keyword):
        return f":{x}"
    if isinstance(x, Symbol):
        return str(x)
    if isinstance(x, str):
        return '"' + "".join({v: "\\" + k for k, v in _ESCAPES.items()}.get(c, c) for c in x) + '"'
    if isinstance(x, dict):
        return "{" + ", ".join(f"{dumps(k)} {dumps(v)}" for k, v in x.items()) + "}"
    if isinstance(x, (set, frozenset)):
        return "#{" + " ".join(sorted(map(dumps, x))) + "}"
    if isinstance(x, tuple):
        return "(" + " ".join(map(dumps, x)) + ")"
    if isinstance(x, list):
        return "[" + " ".join(map(dumps, x)) + "]"
    if isinstance(x, Fraction):
        return f"{x.numerator}/{x.denominator}"
    if isinstance(x, Decimal):
        return f"{x}M"
    return str(x)


def display(x: Any) -> str:
    """As dumps, with a string at the top as it is."""
    return str(x) if isinstance(x, str) and not isinstance(x, Keyword) else dumps(x)


def plain(x: Any, kind: pa.DataType) -> Any:
    """A value as Arrow takes it for ``kind``; keyword keys become names, misfits become text."""
    if x is None:
        return None
    if pa.types.is_struct(kind):
        return {f.name: plain(x.get(Keyword(f.name)) if isinstance(x, dict) else None, f.type) for f in kind}
    if pa.types.is_map(kind):
        return [(plain(k, kind.key_type), plain(v, kind.item_type)) for k, v in x.items()]
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return [plain(v, kind.value_type) for v in (sorted(x, key=dumps) if isinstance(x, frozenset) else x)]
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return str(x) if isinstance(x, str) else dumps(x)
    if pa.types.is_floating(kind):
        return float(x)
    return x


def from_row(x: Any) -> Any:
    """A row's value as EDN data: struct fields are keywords."""
    if isinstance(x, dict):
        return {Keyword(k): from_row(v) for k, v in x.items()}
    if isinstance(x, list):
        return [from_row(v) for v in x]
    return x


def to_json(x: Any) -> str:
    """EDN data as JSON text, for variant columns."""
    return json.dumps(_jsonable(x), ensure_ascii=False)


def _jsonable(x: Any) -> Any:
    if isinstance(x, dict):
        return {k if isinstance(k, str) else dumps(k): _jsonable(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, frozenset)):
        return [_jsonable(v) for v in (sorted(x, key=dumps) if isinstance(x, frozenset) else x)]
    return float(x) if isinstance(x, (Fraction, Decimal)) else x
