"""Keep lists over JSON text, in three styles: compact, pretty, and as the source is spaced. Kept leaves stand as in the source."""

from __future__ import annotations

from docweave.errors import PathNotFound, TypeMismatch
from docweave.functions import rawjson as J
from docweave.functions.evaluate import slice_positions
from docweave.plans import keep as K
from docweave.plans.paths import resolve_index

COMPACT, PRESERVE = "compact", "preserve"


def kept(tree: K.Keep, document: str, strict: bool = False, style: str | int = COMPACT) -> str:
    """What a keep list leaves of a document. style: COMPACT, PRESERVE, or the number of spaces of an indentation.

    Missing members are left out and values of the wrong kind become null, unless strict: then they are errors.
    """
    value = document.strip(" \t\n\r")
    J.kind_of(value)
    return _kept(tree, value, strict, style, 0)


def _wrong(want: str, strict: bool) -> str:
    if strict:
        raise TypeMismatch(f"no {want} where one is kept")
    return "null"


def _kept(tree: K.Keep, value: str, strict: bool, style, depth: int) -> str:
    if isinstance(tree, K.Whole):
        return value
    if isinstance(tree, K.Members):
        return _members(tree, value, strict, style, depth)
    if value[:1] != "[":
        return _wrong("array", strict)
    spans = list(J.element_spans(value))
    if isinstance(tree, K.Picked):
        if len(tree.at) == 1:
            index, child = tree.at[0]
            at = resolve_index(index, len(spans))
            if at is None:
                if strict:
                    raise PathNotFound(f"no element {index}")
                return "null"
            return _kept(child, value[slice(*spans[at])], strict, style, depth)
        chosen = [(resolve_index(i, len(spans)), child) for i, child in sorted(tree.at, key=lambda x: x[0])]
        if strict and any(at is None for at, _ in chosen):
            raise PathNotFound("an element is missing")
        chosen = [(at, child) for at, child in chosen if at is not None]
    elif isinstance(tree, K.Range):
        chosen = [(at, tree.then) for at in slice_positions(len(spans), tree.cut.start, tree.cut.stop, tree.cut.step)]
    else:
        chosen = [(at, tree.then) for at in range(len(spans))]
    pieces = [(at, _kept(child, value[slice(*spans[at])], strict, style, depth + 1)) for at, child in chosen]
    if not isinstance(tree, K.Picked):
        pieces = [(at, p) for at, p in pieces if p != "null"]
    if style == PRESERVE:
        return "[" + ",".join(_gap(value, spans, at, 0) + p + _gap(value, spans, at, 1) for at, p in pieces) + "]"
    return _joined("[]", [p for _, p in pieces], style, depth)


def _gap(value: str, spans, at: int, side: int) -> str:
    """White space of the source before or after an element, up to its comma or bracket."""
    if side == 0:
        edge = spans[at][0]
        start = edge
        while value[start - 1] in " \t\n\r":
            start -= 1
        return value[start:edge]
    edge = spans[at][1]
    return value[edge : J.skip_space(value, edge)]


def _joined(ends: str, pieces: list[str], style, depth: int) -> str:
    if not isinstance(style, int) or not pieces:
        return ends[0] + ",".join(pieces) + ends[1]
    pad = "\n" + " " * style * (depth + 1)
    return ends[0] + pad + ("," + pad).join(pieces) + ("\n" + " " * style * depth if style else "") + ends[1]


def _members(tree: K.Members, value: str, strict: bool, style, depth: int) -> str:
    if value[:1] != "{":
        return _wrong("object", strict)
    wanted = dict(tree.fields)
    found, pieces = set(), []
    for a, b, c, d in J.member_spans(value):
        key = J.unquoted(value[a:b]) if "\\" in value[a:b] else value[a + 1 : b - 1]
        if key not in wanted:
            continue
        found.add(key)
        piece = _kept(wanted[key], value[c:d], strict, style, depth + 1)
        if style == PRESERVE:
            start = a
            while value[start - 1] in " \t\n\r":
                start -= 1
            pieces.append(value[start:c] + piece + value[d : J.skip_space(value, d)])
        else:
            pieces.append(value[a:b] + (": " if isinstance(style, int) else ":") + piece)
    if strict and len(found) < len(wanted):
        raise PathNotFound(f"missing {sorted(set(wanted) - found)}")
    return "{" + ",".join(pieces) + "}" if style == PRESERVE else _joined("{}", pieces, style, depth)
