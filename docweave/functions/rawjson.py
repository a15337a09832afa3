"""JSON values as their own text: one level is read at a time, everything else is skipped and kept as it stands.

This is what the exact tier works on. Key order, duplicate keys, number lexemes and white space within kept values survive, and what is not asked
for is not validated.
"""

from __future__ import annotations

import json
import re
from json.encoder import encode_basestring as quoted

import numpy as np

from docweave.errors import DecodeError, IndexOutOfBounds, InvalidSyntax, PathNotFound, TypeMismatch

_SPACE = re.compile(r"[ \t\n\r]*")
_QUOTED = r'"[^"\\]*(?:\\.[^"\\]*)*"'
_STRING = re.compile(_QUOTED, re.DOTALL)
_SCALAR = re.compile(r"[^\s,\]}:\[{\"]+")
#: A member up to its value, or with it where that is a string or scalar; an element likewise.
_PLAIN = rf'({_QUOTED}|[^\s,\]}}:\[{{"]+)[ \t\n\r]*'
_MEMBER = re.compile(rf"[ \t\n\r]*({_QUOTED})[ \t\n\r]*:[ \t\n\r]*(?:{_PLAIN}(?=[,}}]))?", re.DOTALL)
_ELEMENT = re.compile(rf"[ \t\n\r]*(?:{_PLAIN}(?=[,\]]))?", re.DOTALL)
_STRUCTURE = re.compile(_QUOTED + r"|[][{}]", re.DOTALL)
_DEEP = re.compile(_QUOTED + r'|[][{}]|[^\s,:\][{}"]+', re.DOTALL)
_BLANKS = re.compile(f"({_QUOTED})" + r"|[ \t\n\r]+", re.DOTALL)
#: The standard library's scanner of one value, which says where it ends, and the most text that it is given: it builds what it reads.
_SCAN, _SCANNED = json.JSONDecoder(strict=False).scan_once, 1 << 24
#: What a byte adds to the depth.
_NESTS = np.zeros(256, np.int8)
_NESTS[list(b"{[")], _NESTS[list(b"}]")] = 1, -1
NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")


def skip_space(text: str, at: int) -> int:
    return _SPACE.match(text, at).end()


def value_end(text: str, at: int) -> int:
    """Where the value that starts at `at` ends."""
    first = text[at : at + 1]
    if first == '"':
        found = _STRING.match(text, at)
        if not found:
            raise InvalidSyntax("an unfinished string")
        return found.end()
    if first in ("{", "["):
        if len(text) - at <= _SCANNED:
            try:
                return _SCAN(text, at)[1]
            except (ValueError, StopIteration, RecursionError):
                pass  # not valid throughout, or too deep: where its brackets close counts
        depth = 0
        for found in _STRUCTURE.finditer(text, at):
            sign = found[0]
            if sign in "{[":
                depth += 1
            elif sign in "}]":
                depth -= 1
                if not depth:
                    return found.end()
        raise InvalidSyntax("an unfinished container")
    found = _SCALAR.match(text, at)
    if not found:
        raise InvalidSyntax(f"no value at {at}")
    return found.end()


def kind_of(text: str) -> str:
    """object, array, string, boolean, null or number, by the first character."""
    kind = {"{": "object", "[": "array", '"': "string", "t": "boolean", "f": "boolean", "n": "null"}.get(text[:1])
    if kind is None:
        if text[:1] == "-" or text[:1].isdigit():
            return "number"
        raise InvalidSyntax("no JSON value")
    return kind


def member_spans(text: str):
    """(key start, key end, value start, value end) of each member of an object, in order; keys with their quotes."""
    at = skip_space(text, 1)
    if text[at : at + 1] == "}":
        return
    while True:
        found = _MEMBER.match(text, at)
        if not found:
            raise InvalidSyntax(f"no key and colon at {at}")
        start, end = found.span(2)
        if start >= 0:  # a string or scalar
            at = found.end()
        else:
            start = found.end()
            end = value_end(text, start)
            at = skip_space(text, end)
        yield *found.span(1), start, end
        sign = text[at : at + 1]
        if sign == "}":
            return
        if sign != ",":
            raise InvalidSyntax(f"no comma at {at}")
        at += 1


def element_spans(text: str):
    """(start, end) of each element of an array, in order."""
    at = skip_space(text, 1)
    if text[at : at + 1] == "]":
        return
    while True:
        found = _ELEMENT.match(text, at)
        start, end = found.span(1)
        if start >= 0:
            at = found.end()
        else:
            start = found.end()
            end = value_end(text, start)
            at = skip_space(text, end)
        yield start, end
        sign = text[at : at + 1]
        if sign == "]":
            return
        if sign != ",":
            raise InvalidSyntax(f"no comma at {at}")
        at += 1


def key_token(key: str) -> str:
    """A key as it stands in a document."""
    return quoted(key)


def same_key(token: str, key: str) -> bool:
    """Whether a key of a document, with its quotes, is this key; escapes that need not be are understood."""
    if "\\" not in token:
        return token[1:-1] == key
    return unquoted(token) == key


def unquoted(text: str) -> str:
    """The string that a JSON string stands for; lone surrogates and raw control characters are errors."""
    try:
        out = json.loads(text)
        out.encode()
        return out
    except (ValueError, UnicodeEncodeError):
        raise InvalidSyntax("a bad string") from None


def members(text: str) -> list[tuple[str, str]]:
    """(key token, value) of each member."""
    return [(text[a:b], text[c:d]) for a, b, c, d in member_spans(text)]


def elements(text: str) -> list[str]:
    return [text[a:b] for a, b in element_spans(text)]


def member(text: str, key: str) -> tuple[int, int] | None:
    """Where the value of the first member of this key stands; what follows it is not read."""
    for a, b, c, d in member_spans(text):
        if same_key(text[a:b], key):
            return c, d
    return None


def find_span(text: str, steps) -> tuple[int, int]:
    """Where the value at a path stands in a document.

    A root of the wrong kind is an InvalidSyntax, a nested value of the wrong kind a TypeMismatch, a missing key a PathNotFound and an index
    past the end an IndexOutOfBounds.
    """
    start = skip_space(text, 0)
    end = value_end(text, start)
    for depth, step in enumerate(steps):
        want = "array" if isinstance(step, int) else "object"
        value = text[start:end]
        if kind_of(value) != want:
            raise TypeMismatch(f"no {want} where {step!r} is looked up") if depth else InvalidSyntax(f"the document is no {want}")
        if isinstance(step, int):
            found = next((s for i, s in enumerate(element_spans(value)) if i == step), None)
            if found is None:
                raise IndexOutOfBounds(f"no element {step}")
        else:
            found = member(value, step)
            if found is None:
                raise PathNotFound(f"no key {step!r}")
        start, end = start + found[0], start + found[1]
    return start, end


def find(text: str, steps) -> str:
    start, end = find_span(text, steps)
    return text[start:end]


def compacted(text: str) -> str:
    """The value without white space outside strings."""
    return _BLANKS.sub(lambda m: m[1] or "", text)


def indented(text: str, indent: int) -> str:
    """A whole document, indented."""
    try:
        out = json.dumps(json.loads(text), ensure_ascii=False, indent=indent)
        out.encode()
        return out
    except UnicodeEncodeError:
        raise DecodeError("a lone surrogate") from None
    except ValueError as e:
        raise DecodeError(str(e)) from None


def depth_of(text: str) -> int:
    """How many containers the deepest value lies in: 1 for {"a":1} and [[]], 3 for [[[1]]], 0 for a scalar or an empty container."""
    depth = deepest = 0
    for found in _DEEP.finditer(text):
        sign = found[0]
        if sign in "}]":
            depth -= 1
            if depth < 0:
                raise InvalidSyntax("an unopened container")
            continue
        deepest = max(deepest, depth)
        depth += sign in "{["
    if depth:
        raise InvalidSyntax("an unfinished container")
    return deepest


def deeper(text: str, most: int) -> bool:
    """depth_of(text) > most. Brackets are counted by array operations; ill-formed texts, and those on the edge, are left to depth_of."""
    plain = _STRING.sub("", text) if '"' in text else text
    depths = np.cumsum(_NESTS[np.frombuffer(plain.encode(errors="surrogatepass"), np.uint8)], dtype=np.int32)
    if not len(depths) or depths.min() < 0 or depths[-1] or depths.max() == most + 1:  # there it counts whether the deepest containers are empty
        return depth_of(text) > most
    return bool(depths.max() > most)


def number_text(x: float) -> str:
    """A computed number: whole ones below 1e15 without a point, others with the fewest digits that give them back, no exponent."""
    if abs(x) < 1e15 and x == int(x):
        return str(int(x))
    text = repr(float(x))
    if "e" in text or "E" in text:
        from decimal import Decimal

        text = format(Decimal(text), "f")
    return text[:-2] if text.endswith(".0") else text
