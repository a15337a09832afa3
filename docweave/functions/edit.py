"""Edits of JSON text. What an edit does not touch keeps its bytes.

An operation is a dict: {"op": name, ...} (see Edits); a list of them runs in order, each on what the one before left.
"""

from __future__ import annotations

import json

from docweave.errors import ROW_ERRORS, DecodeError, IndexOutOfBounds, InvalidPath, InvalidSyntax, PathNotFound, TypeMismatch, described
from docweave.functions import rawjson as J
from docweave.functions.evaluate import shallow
from docweave.plans.paths import parse_path, path_text


def encoded(value: object) -> str:
    """A Python value as compact JSON text."""
    try:
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
    except (TypeError, ValueError) as e:
        raise DecodeError(str(e)) from None


def one_value(text: str) -> str:
    """The text, if it is one JSON value; InvalidSyntax otherwise."""
    try:
        json.loads(text, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
    except ValueError:
        raise InvalidSyntax("not one JSON value") from None
    return text.strip()


def _container(text: str, steps, kind: str) -> tuple[int, int]:
    start, end = J.find_span(text, steps)
    if J.kind_of(text[start:end]) != kind:
        raise TypeMismatch(f"no {kind} at {path_text(steps) or 'the root'!r}")
    return start, end


def set_value(text: str, steps, value: str) -> str:
    """Replaces the value at a path, which must exist."""
    start, end = J.find_span(text, steps)
    return text[:start] + value + text[end:]


def upsert_key(text: str, steps, key: str, value: str) -> str:
    """Replaces a member of the object at a path, or adds it at the end."""
    start, end = _container(text, steps, "object")
    found = J.member(text[start:end], key)
    if found:
        return text[: start + found[0]] + value + text[start + found[1] :]
    comma = "," if text[start + 1 : end - 1].strip() else ""
    return text[: end - 1] + f"{comma}{J.key_token(key)}:{value}" + text[end - 1 :]


def upsert(text: str, steps, value: str) -> str:
    """Sets the value at a path, making missing parent objects; an index may be one past the end, arrays are never made."""
    if not steps:
        return set_value(text, steps, value)
    for i in range(1, len(steps)):
        try:
            start, end = J.find_span(text, steps[:i])
            want = "array" if isinstance(steps[i], int) else "object"
            if J.kind_of(text[start:end]) != want:
                raise TypeMismatch(f"no {want} at {path_text(steps[:i])!r}")
        except PathNotFound:
            if isinstance(steps[i - 1], int) or isinstance(steps[i], int):
                raise InvalidPath("array elements and arrays are not made") from None
            text = upsert_key(text, steps[: i - 1], steps[i - 1], "{}")
    if isinstance(steps[-1], str):
        return upsert_key(text, steps[:-1], steps[-1], value)
    start, end = _container(text, steps[:-1], "array")
    size = len(J.elements(text[start:end]))
    if steps[-1] < size:
        return set_value(text, steps, value)
    if steps[-1] == size:
        return insert(text, steps[:-1], size, value)
    raise IndexOutOfBounds(f"no element {steps[-1]}")


def _without(text: str, spans: list[tuple[int, int]], at: int) -> str:
    """Text without one member or element and the comma and white space that go with it."""
    start, end = spans[at]
    if at + 1 < len(spans):
        end = spans[at + 1][0]
    elif at:
        start = spans[at - 1][1]
        end = J.skip_space(text, end)
    else:
        end = J.skip_space(text, end)
    if not at:
        start = 1
    return text[:start] + text[end:]


def delete_key(text: str, steps, key: str) -> str:
    start, end = _container(text, steps, "object")
    spans = list(J.member_spans(text[start:end]))
    at = next((i for i, (a, b, _, _) in enumerate(spans) if J.same_key(text[start + a : start + b], key)), None)
    if at is None:
        raise PathNotFound(f"no key {key!r}")
    return text[:start] + _without(text[start:end], [(a, d) for a, _, _, d in spans], at) + text[end:]


def delete_index(text: str, steps, index: int) -> str:
    start, end = _container(text, steps, "array")
    spans = list(J.element_spans(text[start:end]))
    if index >= len(spans):
        raise IndexOutOfBounds(f"no element {index}")
    return text[:start] + _without(text[start:end], spans, index) + text[end:]


def delete(text: str, steps) -> str:
    if not steps:
        raise InvalidPath("the root can't be deleted")
    return (delete_index if isinstance(steps[-1], int) else delete_key)(text, steps[:-1], steps[-1])


def insert(text: str, steps, index: int, value: str) -> str:
    """Puts a value before an element; index may be the length."""
    start, end = _container(text, steps, "array")
    spans = list(J.element_spans(text[start:end]))
    if index > len(spans):
        raise PathNotFound(f"no place {index}")
    if index < len(spans):
        at = start + spans[index][0]
        return text[:at] + value + "," + text[at:]
    return text[: end - 1] + ("," if spans else "") + value + text[end - 1 :]


def append(text: str, steps, value: str) -> str:
    start, end = _container(text, steps, "array")
    return insert(text, steps, len(J.elements(text[start:end])), value)


def prepend(text: str, steps, value: str) -> str:
    return insert(text, steps, 0, value)


def rename(text: str, steps, old: str, new: str) -> str:
    """Renames a member where it stands. The same name is no change; a name that is taken is an error."""
    start, end = _container(text, steps, "object")
    spans = list(J.member_spans(text[start:end]))
    found = next(((a, b) for a, b, _, _ in spans if J.same_key(text[start + a : start + b], old)), None)
    if found is None:
        raise PathNotFound(f"no key {old!r}")
    if old == new:
        return text
    if any(J.same_key(text[start + a : start + b], new) for a, b, _, _ in spans):
        raise InvalidPath(f"key {new!r} is there already")
    return text[: start + found[0]] + J.key_token(new) + text[start + found[1] :]


def merge_shallow(text: str, steps, patch: str) -> str:
    """Upserts each member of the patch into the object at a path."""
    patch = patch.strip()
    if J.kind_of(patch) != "object":
        raise TypeMismatch("the patch is no object")
    for token, value in J.members(patch):
        text = upsert_key(text, steps, J.unquoted(token), value)
    return text


def merge_patch(text: str, steps, patch: str) -> str:
    """RFC 7396 at a path: null deletes, objects merge, anything else replaces."""
    start, end = J.find_span(text, steps)
    shallow(patch)
    return text[:start] + _patched(text[start:end], patch.strip()) + text[end:]


def _patched(target: str, patch: str) -> str:
    if J.kind_of(patch) != "object":
        return patch
    if J.kind_of(target) != "object":
        target = "{}"
    for token, value in J.members(patch):
        key = J.unquoted(token)
        if value == "null":
            try:
                target = delete_key(target, (), key)
            except PathNotFound:
                pass
            continue
        found = J.member(target, key)
        target = upsert_key(target, (), key, _patched(target[found[0] : found[1]] if found else "null", value))
    return target


_RUN = {
    "set": lambda t, o: set_value(t, o["path"], o["value"]),
    "set_checked": lambda t, o: set_value(t, o["path"], one_value(o["value"])),
    "upsert": lambda t, o: upsert(t, o["path"], o["value"]),
    "delete": lambda t, o: delete(t, o["path"]),
    "append": lambda t, o: append(t, o["path"], o["value"]),
    "prepend": lambda t, o: prepend(t, o["path"], o["value"]),
    "insert": lambda t, o: insert(t, o["path"], o["index"], o["value"]),
    "rename": lambda t, o: rename(t, o["path"], o["old"], o["new"]),
    "merge_shallow": lambda t, o: merge_shallow(t, o["path"], o["value"]),
    "merge_patch": lambda t, o: merge_patch(t, o["path"], o["value"]),
}


class Edits:
    """Operations in order, built by chaining: Edits().set("a.b", 1).delete("c"). Values are Python values; raw=True takes JSON text.

    Paths and values are checked when the list is built, on the driver.
    """

    def __init__(self, ops: tuple[dict, ...] = ()):
        self.ops = ops

    def _with(self, op: str, path: str | tuple, value=None, raw: bool = False, **more) -> Edits:
        steps = path if isinstance(path, tuple) else parse_path(path)
        if op not in ("delete", "rename"):
            more["value"] = one_value(value) if raw else encoded(value)
        return Edits((*self.ops, {"op": op, "path": steps, **more}))

    def set(self, path, value, raw=False):
        return self._with("set", path, value, raw)

    def upsert(self, path, value, raw=False):
        return self._with("upsert", path, value, raw)

    def delete(self, path):
        return self._with("delete", path)

    def append(self, path, value, raw=False):
        return self._with("append", path, value, raw)

    def prepend(self, path, value, raw=False):
        return self._with("prepend", path, value, raw)

    def insert(self, path, index, value, raw=False):
        return self._with("insert", path, value, raw, index=index)

    def rename(self, path, old, new):
        return self._with("rename", path, old=old, new=new)

    def merge_shallow(self, path, patch, raw=False):
        return self._with("merge_shallow", path, patch, raw)

    def merge_patch(self, path, patch, raw=False):
        return self._with("merge_patch", path, patch, raw)

    def __add__(self, other: Edits) -> Edits:
        return Edits(self.ops + other.ops)

    def __len__(self) -> int:
        return len(self.ops)

    def apply(self, text: str) -> str:
        for o in self.ops:
            text = _RUN[o["op"]](text, o)
        return text

    def attempt(self, text: str) -> tuple[str, str | None]:
        """The edited text and no error, or the text as it was and the error: a failing list changes nothing."""
        try:
            return self.apply(text), None
        except ROW_ERRORS as e:
            return text, described(e)
