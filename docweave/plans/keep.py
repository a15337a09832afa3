"""Keep lists: paths merged into one tree that says what of a document stays.

Ancestors of kept values stay and members keep the document's order. A wider path takes in narrower ones; a wildcard widens indices and slices of
the same array; a slice that differs from what was there replaces it. One index alone yields the element itself, two or more an array.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from docweave.errors import InvalidPath
from docweave.plans.paths import Cut, Every, parse_keep_path


class Keep:
    pass


@dataclass(frozen=True)
class Whole(Keep):
    pass


@dataclass(frozen=True)
class Members(Keep):
    fields: tuple[tuple[str, Keep], ...] = ()


@dataclass(frozen=True)
class All(Keep):
    then: Keep


@dataclass(frozen=True)
class Picked(Keep):
    """Elements by signed index."""

    at: tuple[tuple[int, Keep], ...] = ()


@dataclass(frozen=True)
class Range(Keep):
    cut: Cut
    then: Keep


NOTHING = Members()


def _put(pairs: tuple, key, child: Keep) -> tuple:
    out = dict(pairs)
    out[key] = child
    return tuple(out.items())


def added(node: Keep, steps: tuple) -> Keep:
    """The tree with one more path."""
    if not steps:
        return Whole()
    if isinstance(node, Whole):
        return node
    step, rest = steps[0], steps[1:]
    if isinstance(step, str):
        if not isinstance(node, Members):
            raise InvalidPath(f"key {step!r} where an array was selected")
        return Members(_put(node.fields, step, added(dict(node.fields).get(step, NOTHING), rest)))
    if isinstance(step, Cut):
        if isinstance(node, Range) and node.cut == step:
            return replace(node, then=added(node.then, rest))
        return Range(step, added(NOTHING, rest))
    if isinstance(node, Members):
        if node.fields:
            raise InvalidPath("an array step where an object was selected")
        node = Picked() if isinstance(step, int) else All(NOTHING)
    if isinstance(step, Every):
        return All(added(_each_of(node), rest))
    if isinstance(node, Picked):
        return Picked(_put(node.at, step, added(dict(node.at).get(step, NOTHING), rest)))
    return replace(node, then=added(node.then, rest))


def _each_of(node: Keep) -> Keep:
    """What a selection of an array keeps of its elements, as one tree."""
    if isinstance(node, (All, Range)):
        return node.then
    out: Keep = NOTHING
    for _, child in node.at:
        out = _union(out, child)
    return out


def _union(a: Keep, b: Keep) -> Keep:
    if isinstance(a, Whole) or isinstance(b, Whole):
        return Whole()
    if isinstance(a, Members) and isinstance(b, Members):
        fields = dict(a.fields)
        for k, v in b.fields:
            fields[k] = _union(fields.get(k, NOTHING), v)
        return Members(tuple(fields.items()))
    if isinstance(a, All) and isinstance(b, All):
        return All(_union(a.then, b.then))
    return b if a == NOTHING else a


def keep_tree(paths: list[str]) -> Keep:
    """The tree of a keep list; an empty list keeps an empty object."""
    node: Keep = NOTHING
    for p in paths:
        node = added(node, parse_keep_path(p))
    return node


def keep_arrays(node: Keep, prefix: str = "") -> list[str]:
    """Paths of the arrays that a keep list goes through, sorted."""
    found: set[str] = set()

    def visit(n: Keep, at: str) -> None:
        if isinstance(n, Members):
            for k, v in n.fields:
                visit(v, f"{at}.{k}" if at else k)
        elif not isinstance(n, Whole):
            if at:
                found.add(at)
            for v in [n.then] if isinstance(n, (All, Range)) else [v for _, v in n.at]:
                visit(v, at)

    visit(node, prefix)
    return sorted(found)
