"""Paths into documents: find paths (`a.b[0]`), JSON pointers and keep-list paths (with wildcards, slices, negative indices).

A path is a tuple of steps: a str is an object key, an int an array index. Keep-list paths also have Every and Cut steps.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from docweave.errors import InvalidPath



@dataclass(frozen=True)
class Every:
    """All elements of an array."""


@dataclass(frozen=True)
class Cut:
    """A slice of an array; bounds and step as in Python."""

    start: int | None
    stop: int | None
    step: int | None


Step = str | int | Every | Cut
_BRACKET = re.compile(r"\[([^\[\]]*)\]")


def parse_path(text: str, strict: bool = True) -> tuple[str | int, ...]:
    """Steps of a find path. Empty parts between dots are skipped; strict=False drops brackets that hold no index."""
    steps: list[str | int] = []
    for part in text.split("."):
        at = part.find("[")
        key = part if at < 0 else part[:at]
        if strict and "]" in key:
            raise InvalidPath(f"']' without '[' in {text!r}")
        if key:
            steps.append(key)
        while 0 <= at < len(part):
            found = _BRACKET.match(part, at)
            if found and found[1].isascii() and found[1].isdigit():
                steps.append(int(found[1]))
            elif strict:
                raise InvalidPath(f"bad index in {text!r}")
            at = found.end() if found else len(part)
            if strict and at < len(part) and part[at] != "[":
                raise InvalidPath(f"text after ']' in {text!r}")
            if not strict:
                at = part.find("[", at) if at < len(part) else len(part)
    return tuple(steps)


def parse_pointer(text: str) -> tuple[str | int, ...]:
    """Steps of a JSON pointer (RFC 6901); a token of digits alone is always an index."""
    if text == "":
        return ()
    if not text.startswith("/"):
        raise InvalidPath(f"a pointer starts with '/': {text!r}")
    steps: list[str | int] = []
    for token in text[1:].split("/"):
        if re.search(r"~(?![01])", token):
            raise InvalidPath(f"bad escape in {text!r}")
        token = token.replace("~1", "/").replace("~0", "~")
        steps.append(int(token) if token.isascii() and token.isdigit() else token)
    return tuple(steps)


def path_text(steps) -> str:
    """The text of a find path."""
    out = ""
    for s in steps:
        out += f"[{s}]" if isinstance(s, int) else ("." if out else "") + s
    return out


_INSIDE = re.compile(r"\s*(?:(?P<every>\*?)|(?P<index>-?\d+)|(?P<a>-?\d+)?\s*:\s*(?P<b>-?\d+)?\s*(?::\s*(?P<c>-?\d+)?)?)\s*$")


def parse_keep_path(text: str) -> tuple[Step, ...]:
    """Steps of a keep-list path: keys, `[n]`, `[-n]`, `[]` or `[*]`, `[a:b:c]`."""
    steps: list[Step] = []
    at, need_key = 0, True
    text = text.strip()
    if not text:
        raise InvalidPath("an empty path")
    while at < len(text):
        c = text[at]
        if c == "[":
            end = text.find("]", at)
            inside = _INSIDE.match(text[at + 1 : end]) if end > 0 else None
            if not inside:
                raise InvalidPath(f"bad brackets in {text!r}")
            if inside["index"]:
                steps.append(int(inside["index"]))
            elif inside["every"] is not None:
                steps.append(Every())
            else:
                a, b, c = (int(x) if x else None for x in inside.group("a", "b", "c"))
                if c == 0:
                    raise InvalidPath(f"a step of zero in {text!r}")
                steps.append(Cut(a, b, c))
            at, need_key = end + 1, False
        elif c == ".":
            if need_key:
                raise InvalidPath(f"an empty key in {text!r}")
            at, need_key = at + 1, True
        else:
            if not need_key:
                raise InvalidPath(f"a key must follow a dot in {text!r}")
            end = min((i for i in (text.find(".", at), text.find("[", at)) if i >= 0), default=len(text))
            if "]" in text[at:end]:
                raise InvalidPath(f"']' without '[' in {text!r}")
            steps.append(text[at:end])
            at, need_key = end, False
    if need_key:
        raise InvalidPath(f"a path can't end with a dot: {text!r}")
    return tuple(steps)


def array_prefixes(path: str) -> list[str]:
    """The array paths that a find path goes through, outermost first: for `a[0].b[1]` these are `a` and `a[0].b`."""
    steps = parse_path(path, strict=False)
    return [path_text(steps[:i]) for i, s in enumerate(steps) if isinstance(s, int)]


def resolve_index(index: int, size: int) -> int | None:
    at = index + size if index < 0 else index
    return at if 0 <= at < size else None
