"""Which tier runs an expression, and what can be told from an expression before it runs."""

from __future__ import annotations

from pyspark.sql import types as T

from docweave.errors import ExpressionError
from docweave.plans import ast as A
from docweave.plans.typed import TypedCompiler, Unsupported

TYPED, VARIANT, EXACT = "typed", "variant", "exact"


def choose_tier(e: A.Expr, schema: T.DataType | None = None, ordered: bool = False) -> str:
    """typed if a schema is known and decides every type; exact where key order is asked for and the expression depends on it; else variant."""
    if schema is not None:
        from pyspark.sql import functions as F

        try:
            TypedCompiler().run(e, (F.col("x"), schema))
            return TYPED
        except Unsupported:
            pass
    depends = any(isinstance(x, A.Values) or isinstance(x, A.Call) and x.name in ("keys", "values") for x in A.walk(e))
    return EXACT if ordered and depends else VARIANT


def prefers_rows(e: A.Expr) -> bool:
    """Whether the work for each element is heavy (filters, functions, anything but plain fields in hashes), so that exploding the elements and
    dealing them out pays; thin cards stay in their document's row."""
    if isinstance(e, (A.Call, A.Where)):
        return True
    if isinstance(e, A.Hash):
        return any(prefers_rows(x) for _, x in e.fields if not isinstance(x, (A.Field, A.Current, A.Literal)))
    return any(map(prefers_rows, A.children(e)))


def _chain(e: A.Expr, prefix: str) -> str | None:
    """The path that a chain of fields leads to."""
    if isinstance(e, A.Field):
        return f"{prefix}.{e.name}" if prefix else e.name
    if isinstance(e, A.Current):
        return prefix or None
    if isinstance(e, A.Paren):
        return _chain(e.of, prefix)
    if isinstance(e, (A.Sub, A.Pipe)):
        left = _chain(e.of, prefix)
        return None if left is None else _chain(e.then, left)
    return None


def array_paths(e: A.Expr) -> list[str]:
    """Paths of the arrays that an expression walks over, sorted."""
    found: set[str] = set()

    def visit(x: A.Expr, prefix: str) -> None:
        if isinstance(x, A.PROJECTIONS) and not isinstance(x, A.Values):
            at = _chain(x.of, prefix)
            if at is None:
                visit(x.of, prefix)
                at = prefix
            elif at:
                found.add(at)
            if isinstance(x, A.Where):
                visit(x.test, at)
            visit(x.then, at)
        elif isinstance(x, A.Index):
            if prefix:
                found.add(prefix)
        elif isinstance(x, (A.Sub, A.Pipe)):
            left = _chain(x.of, prefix)
            if left is None:
                visit(x.of, prefix)
            visit(x.then, prefix if left is None else left)
        else:
            for c in A.children(x):
                visit(c, prefix)

    visit(e, "")
    return sorted(found)


def peeled(e: A.Expr) -> A.Expr:
    """The projection that `each` streams: path and [*], filter or slice. Anything else is an error."""
    while isinstance(e, A.Paren):
        e = e.of
    if not isinstance(e, (A.Each, A.Where, A.Sliced)) or isinstance(e.of, A.Flatten) or _chain(e.of, "") is None and not isinstance(e.of, A.Current):
        raise ExpressionError("only path[*], path[?...] and path[a:b] can be streamed element by element")
    return e


def card_expression(array_path: str, fields: list[str]) -> str:
    """The expression of thin cards: path[*].{f: f, ...}; "" or "@" is the root array."""
    if not fields:
        raise ExpressionError("cards need a field")
    inner = ", ".join(f"{f}: {f}" for f in fields)
    return f"{'' if array_path in ('', '@') else array_path}[*].{{{inner}}}"


