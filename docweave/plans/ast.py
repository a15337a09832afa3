"""Expressions over one JSON value. A projection (Each, Where, Sliced, Values) applies `then` to each element of what `of` gives."""

from __future__ import annotations

from dataclasses import dataclass


class Expr:
    pass


@dataclass(frozen=True)
class Current(Expr):
    pass


@dataclass(frozen=True)
class Field(Expr):
    name: str


@dataclass(frozen=True)
class Index(Expr):
    at: int


@dataclass(frozen=True)
class Sub(Expr):
    """then, applied to what of gives; null stays null."""

    of: Expr
    then: Expr


@dataclass(frozen=True)
class Pipe(Expr):
    of: Expr
    then: Expr


@dataclass(frozen=True)
class Each(Expr):
    of: Expr
    then: Expr = Current()


@dataclass(frozen=True)
class Where(Expr):
    of: Expr
    test: Expr
    then: Expr = Current()


@dataclass(frozen=True)
class Sliced(Expr):
    of: Expr
    start: int | None
    stop: int | None
    step: int | None
    then: Expr = Current()


@dataclass(frozen=True)
class Values(Expr):
    of: Expr
    then: Expr = Current()


@dataclass(frozen=True)
class Flatten(Expr):
    of: Expr


@dataclass(frozen=True)
class Hash(Expr):
    fields: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class Listed(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class Compare(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class And(Expr):
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Or(Expr):
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Not(Expr):
    of: Expr


@dataclass(frozen=True)
class Literal(Expr):
    """JSON text."""

    text: str


@dataclass(frozen=True)
class Ref(Expr):
    """An expression handed to a function (`&e`)."""

    of: Expr


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Paren(Expr):
    of: Expr


PROJECTIONS = (Each, Where, Sliced, Values)


def children(e: Expr) -> tuple[Expr, ...]:
    """The direct parts of an expression."""
    if isinstance(e, Hash):
        return tuple(x for _, x in e.fields)
    if isinstance(e, Listed):
        return e.items
    if isinstance(e, Call):
        return e.args
    return tuple(v for v in vars(e).values() if isinstance(v, Expr))


def walk(e: Expr):
    yield e
    for c in children(e):
        yield from walk(c)
