"""Checks of one document: required paths, closed objects, types and limits."""

from __future__ import annotations

from dataclasses import dataclass

from docweave.errors import DecodeError, IndexOutOfBounds, LimitExceeded, MissingField, PathNotFound, TypeMismatch, UnknownField
from docweave.functions import rawjson as J
from docweave.plans.paths import parse_path

KINDS = ("object", "array", "string", "number", "boolean", "null")


def presence(text: str, path: str) -> str:
    """missing, null or value; a path that leads through the wrong kind is an error."""
    try:
        return "null" if J.find(text, parse_path(path)) == "null" else "value"
    except (PathNotFound, IndexOutOfBounds):
        return "missing"


def require_paths(text: str, paths, non_null: bool = False) -> None:
    for p in paths:
        found = presence(text, p)
        if found == "missing":
            raise MissingField(p)
        if non_null and found == "null":
            raise DecodeError(f"{p} has no non-null value")


def deny_unknown_keys(text: str, path: str, allowed) -> None:
    value = J.find(text, parse_path(path))
    if J.kind_of(value) != "object":
        raise TypeMismatch(f"no object at {path!r}")
    for token, _ in J.members(value):
        if J.unquoted(token) not in allowed:
            raise UnknownField(J.unquoted(token))


def validate_open(text: str, required) -> None:
    require_paths(text, required)


def validate_closed(text: str, fields) -> None:
    require_paths(text, fields)
    deny_unknown_keys(text, "", fields)


def type_at(text: str, path: str) -> str:
    return J.kind_of(J.find(text, parse_path(path)))


def require_type(text: str, path: str, kind: str) -> None:
    if type_at(text, path) != kind:
        raise TypeMismatch(f"{path!r} is no {kind}")


@dataclass(frozen=True)
class Limits:
    max_depth: int | None = 128
    max_bytes: int | None = 64 * 1024 * 1024

    @classmethod
    def strict(cls) -> Limits:
        return cls(32, 1024 * 1024)

    @classmethod
    def unlimited(cls) -> Limits:
        return cls(None, None)

    def check(self, text: str) -> None:
        if self.max_bytes is not None and len(text.encode(errors="surrogatepass")) > self.max_bytes:
            raise LimitExceeded(f"more than {self.max_bytes} bytes")
        if self.max_depth is not None and J.depth_of(text) > self.max_depth:
            raise LimitExceeded(f"deeper than {self.max_depth}")
