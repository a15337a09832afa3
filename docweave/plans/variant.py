"""Expressions compiled to VARIANT columns, of built-in functions only.

A document is parsed once, by try_parse_json; a chain of keys and indices becomes one try_variant_get. Missing and JSON null are both null
here, as in projections. VARIANT keeps objects sorted by key and normalises numbers, so results equal the exact evaluator's as values, not as
text. Lists stay arrays of VARIANT and computed values stay typed until they are stored in a document.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.errors import ExpressionError
from docweave.plans import ast as A

_NULL_TEXTS = ["null", "false", '""', "[]", "{}"]


@dataclass(frozen=True)
class Val:
    """A column and what it is: v (VARIANT), a (array of VARIANT), b, d, s (boolean, double, string)."""

    col: Column
    kind: str
    path: tuple | None = None  # for v: where it lies below root
    root: Column | None = None


def key_path(key: str) -> str | None:
    """The step of a VARIANT path for a key, if one can be written."""
    if "'" not in key and "\\" not in key:
        return f"['{key}']"
    return f'["{key}"]' if '"' not in key and "\\" not in key else None


def bind(col: Column, make) -> Column:
    """make(x) with x standing for col, which is then computed once."""
    return F.get(F.transform(F.array(col), make), F.lit(0))


def kind_name(col: Column) -> Column:
    """object, array, string, boolean, null or number; NULL for a missing value."""
    kind = F.schema_of_variant(col)
    named = F.when(kind.startswith("OBJECT<"), "object").when(kind.startswith("ARRAY<"), "array").when(kind == "STRING", "string")
    return named.when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.isNotNull(), "number")


def is_number(col: Column) -> Column:
    kind = F.schema_of_variant(col)
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


class VariantCompiler:
    """on_error: what a function does with a value of the wrong kind: "null" or "raise"."""

    def __init__(self, on_error: str = "null"):
        self.on_error = on_error

    # conversions

    def v(self, x: Val) -> Column:
        if x.kind == "v":
            return x.col
        if x.kind == "a":
            return F.to_variant_object(x.col)
        if x.kind == "d":
            whole = (x.col == F.floor(x.col)) & (F.abs(x.col) < 1e15)
            return F.when(whole, x.col.cast("long").cast("variant")).otherwise(x.col.cast("variant"))
        return x.col.cast("variant")

    def a(self, x: Val) -> Column:
        """As an array of VARIANT; NULL for anything else."""
        if x.kind == "a":
            return x.col
        return F.try_variant_get(x.col, "$", "array<variant>") if x.kind == "v" else F.lit(None).cast("array<variant>")

    def is_null(self, x: Val) -> Column:
        return x.col.isNull() | F.is_variant_null(x.col) if x.kind == "v" else x.col.isNull()

    def text(self, x: Val) -> Column:
        """Canonical JSON text, "null" for null: what equality compares."""
        return F.coalesce(F.to_json(self.v(x)), F.lit("null"))

    def truthy(self, x: Val) -> Column:
        if x.kind == "b":
            return F.coalesce(x.col, F.lit(False))
        if x.kind == "d":
            return x.col.isNotNull()
        if x.kind == "s":
            return F.coalesce(F.length(x.col) > 0, F.lit(False))
        if x.kind == "a":
            return F.coalesce(F.size(x.col) > 0, F.lit(False))
        return ~self.text(x).isin(_NULL_TEXTS)

    def number(self, x: Val) -> Column:
        """As a double; NULL unless it is a number."""
        if x.kind == "d":
            return x.col
        if x.kind != "v":
            return F.lit(None).cast("double")
        return F.when(is_number(x.col), F.try_variant_get(x.col, "$", "double"))

    def string(self, x: Val) -> Column:
        """As a string; NULL unless it is one."""
        if x.kind == "s":
            return x.col
        if x.kind != "v":
            return F.lit(None).cast("string")
        return F.when(F.schema_of_variant(x.col) == "STRING", F.try_variant_get(x.col, "$", "string"))

    def wrong(self, name: str, like: str) -> Column:
        if self.on_error == "raise":
            return F.raise_error(F.lit(f"{name}() can't take a value of this type")).cast(like)
        return F.lit(None).cast(like)

    # expressions

    def run(self, e: A.Expr, x: Val) -> Val:
        return getattr(self, "_" + type(e).__name__.lower())(e, x)

    def _current(self, e, x):
        return x

    def _paren(self, e, x):
        return self.run(e.of, x)

    _ref = _paren

    def _literal(self, e, x):
        try:
            value = json.loads(e.text)
        except ValueError:
            raise ExpressionError(f"a literal that is no JSON: {e.text!r}") from None
        if isinstance(value, str):
            return Val(F.lit(value), "s")
        if isinstance(value, bool):
            return Val(F.lit(value), "b")
        if isinstance(value, (int, float)):
            return Val(F.lit(float(value)), "d")
        return Val(F.parse_json(F.lit(e.text)), "v")

    def step(self, x: Val, text: str) -> Val:
        if x.path is not None:
            path, root = (*x.path, text), x.root
        else:
            path, root = (text,), self.v(x)
        return Val(F.try_variant_get(root, "$" + "".join(path), "variant"), "v", path, root)

    def _field(self, e, x):
        if x.kind != "v":
            return Val(F.lit(None).cast("variant"), "v")
        step = key_path(e.name)
        if step is None:
            return Val(F.try_element_at(F.try_variant_get(x.col, "$", "map<string,variant>"), F.lit(e.name)), "v")
        return self.step(x, step)

    def _index(self, e, x):
        if e.at >= 0 and x.kind == "v":
            return self.step(x, f"[{e.at}]")
        return Val(F.get(self.a(x), F.lit(e.at)) if e.at >= 0 else F.try_element_at(self.a(x), F.lit(e.at)), "v")

    def _sub(self, e, x):
        return self.run(e.then, self.run(e.of, x))

    _pipe = _sub

    def each(self, array: Column, then: A.Expr) -> Val:
        """then for each element, without nulls."""
        if not isinstance(then, A.Current):
            array = F.transform(array, lambda y: self.v(self.run(then, Val(y, "v"))))
        return Val(F.filter(array, lambda y: y.isNotNull() & ~F.is_variant_null(y)), "a")

    def _each(self, e, x):
        return self.each(self.a(self.run(e.of, x)), e.then)

    def _where(self, e, x):
        array = F.filter(self.a(self.run(e.of, x)), lambda y: self.truthy(self.run(e.test, Val(y, "v"))))
        return self.each(array, e.then)

    def _sliced(self, e, x):
        return self.each(sliced(self.a(self.run(e.of, x)), e.start, e.stop, e.step), e.then)

    def _values(self, e, x):
        left = self.run(e.of, x)
        if left.kind != "v":
            return Val(F.lit(None).cast("array<variant>"), "a")
        return self.each(F.map_values(F.try_variant_get(left.col, "$", "map<string,variant>")), e.then)

    def _flatten(self, e, x):
        opened = F.transform(self.a(self.run(e.of, x)), lambda y: F.coalesce(F.try_variant_get(y, "$", "array<variant>"), F.array(y)))
        return Val(F.flatten(opened), "a")

    def _hash(self, e, x):
        fields = {k: self.v(self.run(y, x)) for k, y in e.fields}
        if not fields:
            return Val(F.when(~self.is_null(x), F.parse_json(F.lit("{}"))), "v")
        made = F.to_variant_object(F.struct(*(c.alias(k) for k, c in fields.items())))
        return Val(F.when(~self.is_null(x), made), "v")

    def _listed(self, e, x):
        return Val(F.when(~self.is_null(x), F.array(*(self.v(self.run(y, x)) for y in e.items))), "a")

    def _compare(self, e, x):
        left, right = self.run(e.left, x), self.run(e.right, x)
        ops = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
        op, equality = ops[e.op], e.op in ("==", "!=")
        kinds = {left.kind, right.kind}
        if "s" in kinds and equality:
            same = F.coalesce(self.string(left) == self.string(right), F.lit(False))
            return Val(same if e.op == "==" else ~same, "b")
        if "d" in kinds:
            out = op(self.number(left), self.number(right))
            return Val(F.coalesce(out, F.lit(e.op == "!=")) if equality else out, "b")
        if "s" in kinds:
            return Val(op(self.string(left), self.string(right)), "b")
        numbers = self.number(left), self.number(right)
        strings = self.string(left), self.string(right)
        typed = F.coalesce(op(*numbers), op(*strings))
        return Val(F.coalesce(typed, op(self.text(left), self.text(right))) if equality else typed, "b")

    def _and(self, e, x):
        left, right = self.run(e.left, x), self.run(e.right, x)
        if left.kind == right.kind == "b":
            return Val(F.when(self.truthy(left), right.col).otherwise(left.col), "b")
        return Val(F.when(self.truthy(left), self.v(right)).otherwise(self.v(left)), "v")

    def _or(self, e, x):
        left, right = self.run(e.left, x), self.run(e.right, x)
        if left.kind == right.kind == "b":
            return Val(F.when(self.truthy(left), left.col).otherwise(right.col), "b")
        return Val(F.when(self.truthy(left), self.v(left)).otherwise(self.v(right)), "v")

    def _not(self, e, x):
        return Val(~self.truthy(self.run(e.of, x)), "b")

    def _call(self, e, x):
        args = [a.of if isinstance(a, A.Ref) else self.run(a, x) for a in e.args]
        if not args and e.name != "merge":
            args = [x]
        return getattr(self, "fn_" + e.name)(*args)

    # functions

    def fn_length(self, x):
        if x.kind == "s":
            return Val(F.char_length(x.col).cast("double"), "d")
        if x.kind == "a":
            return Val(F.when(x.col.isNotNull(), F.size(x.col)).cast("double"), "d")
        kind = kind_name(x.col)
        size = F.when(kind == "string", F.char_length(F.try_variant_get(x.col, "$", "string"))).when(kind == "array", F.size(F.try_variant_get(x.col, "$", "array<variant>")))
        size = size.when(kind == "object", F.size(F.try_variant_get(x.col, "$", "map<string,variant>"))).otherwise(self.wrong("length", "int"))
        return Val(size.cast("double"), "d")

    def fn_keys(self, x):
        keys = F.map_keys(F.try_variant_get(self.v(x), "$", "map<string,variant>"))
        keys = F.transform(keys, lambda k: k.cast("variant"))
        return Val(F.when(kind_name(self.v(x)) == "object", keys).otherwise(self.wrong("keys", "array<variant>")), "a")

    def fn_values(self, x):
        values = F.map_values(F.try_variant_get(self.v(x), "$", "map<string,variant>"))
        return Val(F.when(kind_name(self.v(x)) == "object", values).otherwise(self.wrong("values", "array<variant>")), "a")

    def fn_type(self, x):
        fixed = {"s": "string", "b": "boolean", "d": "number", "a": "array"}.get(x.kind)
        return Val(F.when(x.col.isNotNull(), F.lit(fixed)).otherwise("null") if fixed else F.coalesce(kind_name(x.col), F.lit("null")), "s")

    def fn_to_string(self, x):
        return Val(F.coalesce(self.string(x), self.text(x)), "s")

    def fn_to_number(self, x):
        text = F.trim(self.string(x))
        parsed = F.when(text.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
        return Val(F.coalesce(self.number(x), parsed), "d")

    def _of_strings(self, name, x, y, make):
        a, b = self.string(x), self.string(y)
        return Val(F.when(a.isNotNull() & b.isNotNull(), make(a, b)).otherwise(self.wrong(name, "boolean")), "b")

    def fn_starts_with(self, x, y):
        return self._of_strings("starts_with", x, y, F.startswith)

    def fn_ends_with(self, x, y):
        return self._of_strings("ends_with", x, y, F.endswith)

    def fn_contains(self, x, y):
        a, b, array = self.string(x), self.string(y), self.a(x)
        within = F.exists(array, lambda z: self.text(Val(z, "v")) == self.text(y))
        return Val(F.when(a.isNotNull() & b.isNotNull(), F.contains(a, b)).when(array.isNotNull(), within).otherwise(self.wrong("contains", "boolean")), "b")

    def fn_not_null(self, *args):
        return Val(F.coalesce(*(F.when(~self.is_null(x), self.v(x)) for x in args)), "v")

    def fn_reverse(self, x):
        if x.kind == "a":
            return Val(F.reverse(x.col), "a")
        text, array = self.string(x), self.a(x)
        made = F.when(text.isNotNull(), F.reverse(text).cast("variant")).when(array.isNotNull(), F.to_variant_object(F.reverse(array)))
        return Val(made.otherwise(self.wrong("reverse", "variant")), "v")

    def _uniform(self, name, array: Column, numbers, strings, like: str) -> Column:
        """numbers(array of doubles) or strings(array of strings), whichever all elements are."""
        def pick(items):
            doubles = F.transform(items, lambda y: self.number(Val(y, "v")))
            texts = F.transform(items, lambda y: self.string(Val(y, "v")))
            out = F.when(~F.exists(doubles, lambda y: y.isNull()), numbers(doubles))
            if strings is not None:
                out = out.when(~F.exists(texts, lambda y: y.isNull()), strings(texts))
            return out.otherwise(self.wrong(name, like))

        return F.when(array.isNotNull(), bind(array, pick)).otherwise(self.wrong(name, like))

    def fn_sort(self, x):
        as_array = lambda make: lambda items: F.transform(F.array_sort(items), make)
        return Val(self._uniform("sort", self.a(x), as_array(lambda y: self.v(Val(y, "d"))), as_array(lambda y: y.cast("variant")), "array<variant>"), "a")

    def fn_join(self, separator, x):
        parted = lambda items: F.transform(items, lambda s, i: F.when(i == 0, s).otherwise(F.concat(self.string(separator), s)))
        joined = lambda items: F.array_join(parted(items), "")
        array = self.a(x)

        def pick(items):
            texts = F.transform(items, lambda y: self.string(Val(y, "v")))
            return F.when(~F.exists(texts, lambda y: y.isNull()) & self.string(separator).isNotNull(), joined(texts)).otherwise(self.wrong("join", "string"))

        return Val(F.when(array.isNotNull(), bind(array, pick)).otherwise(self.wrong("join", "string")), "s")

    def fn_max(self, x):
        return Val(self._uniform("max", self.a(x), lambda n: self.v(Val(F.array_max(n), "d")), lambda s: F.array_max(s).cast("variant"), "variant"), "v")

    def fn_min(self, x):
        return Val(self._uniform("min", self.a(x), lambda n: self.v(Val(F.array_min(n), "d")), lambda s: F.array_min(s).cast("variant"), "variant"), "v")

    def fn_sum(self, x):
        total = lambda n: F.aggregate(n, F.lit(0.0), lambda a, b: a + b)
        return Val(self._uniform("sum", self.a(x), total, None, "double"), "d")

    def fn_avg(self, x):
        mean = lambda n: F.when(F.size(n) > 0, F.aggregate(n, F.lit(0.0), lambda a, b: a + b) / F.size(n))
        return Val(self._uniform("avg", self.a(x), mean, None, "double"), "d")

    def _of_number(self, name, x, make):
        n = self.number(x)
        return Val(F.when(n.isNotNull(), make(n).cast("double")).otherwise(self.wrong(name, "double")), "d")

    def fn_abs(self, x):
        return self._of_number("abs", x, F.abs)

    def fn_ceil(self, x):
        return self._of_number("ceil", x, F.ceil)

    def fn_floor(self, x):
        return self._of_number("floor", x, F.floor)

    def fn_to_array(self, x):
        return Val(F.coalesce(self.a(x), F.array(F.coalesce(self.v(x), F.parse_json(F.lit("null"))))), "a")

    def fn_merge(self, *args):
        maps = [F.coalesce(F.try_variant_get(self.v(x), "$", "map<string,variant>"), F.expr("map()").cast("map<string,variant>")) for x in args]
        entries = F.flatten(F.array(*(F.map_entries(m) for m in maps)))

        def last(entries):
            """Of entries in order of key and place, those that the next key differs from."""
            order = F.array_sort(F.transform(entries, lambda en, i: F.struct(en["key"].alias("k"), i.alias("i"))))
            kept = lambda order: F.filter(order, lambda o, n: ~(F.get(order, n + 1)["k"].eqNullSafe(o["k"])))
            return F.map_from_entries(F.transform(bind(order, kept), lambda o: F.get(entries, o["i"])))

        return Val(F.to_variant_object(bind(entries, last)), "v")

    def fn_map(self, key, x):
        array = self.a(x)
        made = F.transform(array, lambda y: F.coalesce(self.v(self.run(key, Val(y, "v"))), F.parse_json(F.lit("null"))))
        return Val(F.when(array.isNotNull(), made).otherwise(self.wrong("map", "array<variant>")), "a")

    def _keyed(self, name, x, key, numbers, like):
        """numbers(items, array of (key, position)), for doubles or strings as keys."""
        def pick(items):
            keys = F.transform(items, lambda y: self.v(self.run(key, Val(y, "v"))))

            def by(keys):
                doubles = F.transform(keys, lambda k, i: F.struct(self.number(Val(k, "v")).alias("k"), i.alias("i")))
                texts = F.transform(keys, lambda k, i: F.struct(self.string(Val(k, "v")).alias("k"), i.alias("i")))
                out = F.when(~F.exists(keys, lambda k: self.number(Val(k, "v")).isNull()), numbers(items, doubles))
                return out.when(~F.exists(keys, lambda k: self.string(Val(k, "v")).isNull()), numbers(items, texts)).otherwise(self.wrong(name, like))

            return bind(keys, by)

        array = self.a(x)
        return F.when(array.isNotNull(), bind(array, pick))

    def fn_sort_by(self, x, key):
        order = lambda items, pairs: F.transform(F.array_sort(pairs), lambda p: F.get(items, p["i"]))
        return Val(self._keyed("sort_by", x, key, order, "array<variant>"), "a")

    def fn_group_by(self, x, key):
        def groups(items):
            """Elements in order of key and place, cut where the key changes; the cuts in order of their first elements."""
            order = F.array_sort(F.transform(items, lambda y, i: F.struct(self.text(self.run(key, Val(y, "v"))).alias("k"), i.alias("i"))))

            def cut(order):
                starts = F.filter(F.transform(order, lambda o, n: n), lambda n: (n == 0) | (F.get(order, n)["k"] != F.get(order, n - 1)["k"]))

                def parts(starts):
                    ends = F.transform(starts, lambda n, i: F.struct(F.get(order, n)["i"].alias("first"), n.alias("n"), (F.coalesce(F.get(starts, i + 1), F.size(order)) - n).alias("size")))
                    return F.transform(F.array_sort(ends), lambda p: F.to_variant_object(F.transform(F.slice(order, p["n"] + 1, p["size"]), lambda o: F.get(items, o["i"]))))

                return bind(starts, parts)

            return bind(order, cut)

        array = self.a(x)
        return Val(F.when(array.isNotNull(), bind(array, groups)).otherwise(self.wrong("group_by", "array<variant>")), "a")

    def fn_max_by(self, x, key):
        first = lambda items, pairs: F.get(items, F.aggregate(pairs, F.get(pairs, F.lit(0)), lambda a, b: F.when(b["k"] > a["k"], b).otherwise(a))["i"])
        return Val(self._keyed("max_by", x, key, first, "variant"), "v")

    def fn_min_by(self, x, key):
        first = lambda items, pairs: F.get(items, F.aggregate(pairs, F.get(pairs, F.lit(0)), lambda a, b: F.when(b["k"] < a["k"], b).otherwise(a))["i"])
        return Val(self._keyed("min_by", x, key, first, "variant"), "v")


def sliced(array: Column, start: int | None, stop: int | None, step: int | None) -> Column:
    """A slice of an array column, by Python's rules."""
    step = 1 if step is None else step
    size = F.size(array)
    if step == 1 and (start or 0) >= 0 and (stop is None or stop >= 0):
        start = start or 0
        length = size if stop is None else F.lit(max(0, stop - start))
        return F.slice(array, start + 1, length)

    def bound(n, default, low, high):
        if n is None:
            return default
        at = F.lit(n) if n >= 0 else size + n
        return F.greatest(low, F.least(high, at))

    if step > 0:
        lo, hi = bound(start, F.lit(0), F.lit(0), size), bound(stop, size, F.lit(0), size)
        inside = lambda i: (i >= lo) & (i < hi) & (F.pmod(i - lo, F.lit(step)) == 0)
        return F.filter(array, lambda _, i: inside(i))
    lo, hi = bound(start, size - 1, F.lit(-1), size - 1), bound(stop, F.lit(-1), F.lit(-1), size - 1)
    inside = lambda i: (i <= lo) & (i > hi) & (F.pmod(lo - i, F.lit(-step)) == 0)
    return F.reverse(F.filter(array, lambda _, i: inside(i)))


def compile_variant(e: A.Expr, document: Column, on_error: str = "null") -> Val:
    """An expression over a VARIANT column."""
    return VariantCompiler(on_error).run(e, Val(document, "v", (), document))
