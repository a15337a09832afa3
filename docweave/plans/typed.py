"""Expressions compiled to columns of known types: the fastest tier, where a schema is declared.

What an expression needs is read by one from_json (Catalyst prunes its schema) and navigated as structs, arrays and maps. Nodes whose type
depends on the data raise Unsupported; the planner then takes the VARIANT tier.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.plans import ast as A
from docweave.plans.variant import bind, sliced


class Unsupported(Exception):
    """The expression has no static type over this schema."""


NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
Typed = tuple[Column, T.DataType]


def _array(x: Typed) -> Typed:
    if not isinstance(x[1], T.ArrayType):
        raise Unsupported(f"{x[1].simpleString()} is no array")
    return x


def _number(x: Typed) -> bool:
    return isinstance(x[1], NUMBERS)


class TypedCompiler:
    def run(self, e: A.Expr, x: Typed) -> Typed:
        make = getattr(self, "_" + type(e).__name__.lower(), None)
        if make is None:
            raise Unsupported(type(e).__name__)
        return make(e, x)

    def truthy(self, x: Typed) -> Column:
        c, t = x
        if isinstance(t, T.BooleanType):
            return F.coalesce(c, F.lit(False))
        if isinstance(t, T.StringType):
            return F.coalesce(F.length(c) > 0, F.lit(False))
        if isinstance(t, (T.ArrayType, T.MapType)):
            return F.coalesce(F.size(c) > 0, F.lit(False))
        return c.isNotNull()

    def _current(self, e, x):
        return x

    def _paren(self, e, x):
        return self.run(e.of, x)

    def _literal(self, e, x):
        value = json.loads(e.text)
        if value is None:
            return F.lit(None), T.NullType()
        kinds = {str: T.StringType, bool: T.BooleanType, int: T.LongType, float: T.DoubleType}
        if type(value) not in kinds:
            raise Unsupported("a literal container")
        return F.lit(value), kinds[type(value)]()

    def _field(self, e, x):
        c, t = x
        if isinstance(t, T.MapType):
            return F.try_element_at(c, F.lit(e.name)), t.valueType
        if isinstance(t, T.StructType) and e.name in t.names:
            return c.getField(f"`{e.name}`" if not e.name.isidentifier() else e.name), t[e.name].dataType
        raise Unsupported(f"no field {e.name!r} in {t.simpleString()}")

    def _index(self, e, x):
        c, t = _array(x)
        return (F.get(c, F.lit(e.at)) if e.at >= 0 else F.try_element_at(c, F.lit(e.at))), t.elementType

    def _sub(self, e, x):
        return self.run(e.then, self.run(e.of, x))

    _pipe = _sub

    def each(self, array: Column, element: T.DataType, then: A.Expr) -> Typed:
        kind = [element]

        def make(y):
            made, kind[0] = self.run(then, (y, element))
            return made

        if not isinstance(then, A.Current):
            array = F.transform(array, make)
        return F.filter(array, lambda y: y.isNotNull()), T.ArrayType(kind[0])

    def _each(self, e, x):
        c, t = _array(self.run(e.of, x))
        return self.each(c, t.elementType, e.then)

    def _where(self, e, x):
        c, t = _array(self.run(e.of, x))
        return self.each(F.filter(c, lambda y: self.truthy(self.run(e.test, (y, t.elementType)))), t.elementType, e.then)

    def _sliced(self, e, x):
        c, t = _array(self.run(e.of, x))
        return self.each(sliced(c, e.start, e.stop, e.step), t.elementType, e.then)

    def _values(self, e, x):
        c, t = self.run(e.of, x)
        if not isinstance(t, T.MapType):
            raise Unsupported("* needs a map")
        return self.each(F.map_values(c), t.valueType, e.then)

    def _flatten(self, e, x):
        c, t = _array(self.run(e.of, x))
        if isinstance(t.elementType, T.ArrayType):
            return F.flatten(F.filter(c, lambda y: y.isNotNull())), t.elementType
        return c, t

    def _hash(self, e, x):
        made = [(k, *self.run(y, x)) for k, y in dict(e.fields).items()]
        if not made:
            raise Unsupported("an empty hash")
        struct = F.struct(*(c.alias(k) for k, c, _ in made))
        return F.when(x[0].isNotNull(), struct), T.StructType([T.StructField(k, t) for k, _, t in made])

    def _listed(self, e, x):
        made = [self.run(y, x) for y in e.items]
        if len({t.simpleString() for _, t in made}) != 1:
            raise Unsupported("a list of several types")
        return F.when(x[0].isNotNull(), F.array(*(c for c, _ in made))), T.ArrayType(made[0][1])

    def _compare(self, e, x):
        left, right = self.run(e.left, x), self.run(e.right, x)
        if isinstance(left[1], T.NullType) or isinstance(right[1], T.NullType):
            if e.op not in ("==", "!="):
                return F.lit(None).cast("boolean"), T.BooleanType()
            other = right[0] if isinstance(left[1], T.NullType) else left[0]
            return (other.isNull() if e.op == "==" else other.isNotNull()), T.BooleanType()
        alike = _number(left) and _number(right) or left[1].simpleString() == right[1].simpleString()
        if not alike or isinstance(left[1], T.MapType):
            raise Unsupported("a comparison of several types")
        a, b = left[0], right[0]
        if e.op in ("==", "!="):
            return (a.eqNullSafe(b) if e.op == "==" else ~a.eqNullSafe(b)), T.BooleanType()
        if not (_number(left) or isinstance(left[1], T.StringType)):
            return F.lit(None).cast("boolean"), T.BooleanType()
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[e.op], T.BooleanType()

    def _either(self, e, x, take_left):
        left, right = self.run(e.left, x), self.run(e.right, x)
        if left[1].simpleString() != right[1].simpleString():
            raise Unsupported("operands of several types")
        return F.when(take_left(self.truthy(left)), left[0]).otherwise(right[0]), left[1]

    def _and(self, e, x):
        return self._either(e, x, lambda t: ~t)

    def _or(self, e, x):
        return self._either(e, x, lambda t: t)

    def _not(self, e, x):
        return ~self.truthy(self.run(e.of, x)), T.BooleanType()

    def _call(self, e, x):
        make = getattr(self, "fn_" + e.name, None)
        if make is None:
            raise Unsupported(f"{e.name}()")
        args = [a.of if isinstance(a, A.Ref) else self.run(a, x) for a in e.args] or [x]
        return make(*args)

    def fn_length(self, x):
        if isinstance(x[1], T.StringType):
            return F.char_length(x[0]).cast("long"), T.LongType()
        if isinstance(x[1], (T.ArrayType, T.MapType)):
            return F.when(x[0].isNotNull(), F.size(x[0])).cast("long"), T.LongType()
        raise Unsupported("length()")

    def fn_keys(self, x):
        if isinstance(x[1], T.MapType):
            return F.map_keys(x[0]), T.ArrayType(T.StringType())
        raise Unsupported("keys()")

    def fn_values(self, x):
        if isinstance(x[1], T.MapType):
            return F.map_values(x[0]), T.ArrayType(x[1].valueType)
        raise Unsupported("values()")

    def _strings(self, name, x, y, make):
        if not isinstance(x[1], T.StringType) or not isinstance(y[1], T.StringType):
            raise Unsupported(f"{name}()")
        return make(x[0], y[0]), T.BooleanType()

    def fn_starts_with(self, x, y):
        return self._strings("starts_with", x, y, F.startswith)

    def fn_ends_with(self, x, y):
        return self._strings("ends_with", x, y, F.endswith)

    def fn_contains(self, x, y):
        if isinstance(x[1], T.ArrayType):
            if x[1].elementType.simpleString() != y[1].simpleString() and not (isinstance(x[1].elementType, NUMBERS) and _number(y)):
                raise Unsupported("contains()")
            return F.exists(x[0], lambda z: z.eqNullSafe(y[0])), T.BooleanType()
        return self._strings("contains", x, y, F.contains)

    def fn_not_null(self, *args):
        if len({t.simpleString() for _, t in args}) != 1:
            raise Unsupported("not_null()")
        return F.coalesce(*(c for c, _ in args)), args[0][1]

    def fn_reverse(self, x):
        if isinstance(x[1], (T.ArrayType, T.StringType)):
            return F.reverse(x[0]), x[1]
        raise Unsupported("reverse()")

    def _orderable(self, name, x) -> Typed:
        c, t = _array(x)
        if not isinstance(t.elementType, NUMBERS + (T.StringType,)):
            raise Unsupported(f"{name}()")
        return c, t

    def fn_sort(self, x):
        c, t = self._orderable("sort", x)
        return F.array_sort(c), t

    def fn_max(self, x):
        c, t = self._orderable("max", x)
        return F.array_max(c), t.elementType

    def fn_min(self, x):
        c, t = self._orderable("min", x)
        return F.array_min(c), t.elementType

    def fn_sum(self, x):
        c, t = self._orderable("sum", x)
        kind = "double" if isinstance(t.elementType, (T.DoubleType, T.FloatType)) else "long"
        if isinstance(t.elementType, (T.StringType, T.DecimalType)):
            raise Unsupported("sum()")
        return F.aggregate(c, F.lit(0).cast(kind), lambda a, b: a + b), T.DoubleType() if kind == "double" else T.LongType()

    def fn_avg(self, x):
        total, _ = self.fn_sum(x)
        return F.when(F.size(x[0]) > 0, total.cast("double") / F.size(x[0])), T.DoubleType()

    def _numeric(self, name, x, make, kind):
        if not _number(x):
            raise Unsupported(f"{name}()")
        return make(x[0]), kind or x[1]

    def fn_abs(self, x):
        return self._numeric("abs", x, F.abs, None)

    def fn_ceil(self, x):
        return self._numeric("ceil", x, lambda c: F.ceil(c).cast("long"), T.LongType())

    def fn_floor(self, x):
        return self._numeric("floor", x, lambda c: F.floor(c).cast("long"), T.LongType())

    def fn_join(self, separator, x):
        c, t = _array(x)
        if not isinstance(t.elementType, T.StringType):
            raise Unsupported("join()")
        parted = F.transform(c, lambda s, i: F.when(i == 0, s).otherwise(F.concat(separator[0], s)))
        return F.array_join(parted, ""), T.StringType()

    def fn_map(self, key, x):
        c, t = _array(x)
        kind: list = []

        def make(y):
            made, k = self.run(key, (y, t.elementType))
            kind.append(k)
            return made

        return F.transform(c, make), T.ArrayType(kind[0])

    def _keyed(self, key, x, make):
        c, t = _array(x)

        def pick(items):
            pairs = F.transform(items, lambda y, i: F.struct(self.run(key, (y, t.elementType))[0].alias("k"), i.alias("i")))
            return make(items, pairs)

        return F.when(c.isNotNull(), bind(c, pick)), t

    def fn_sort_by(self, x, key):
        return self._keyed(key, x, lambda items, pairs: F.transform(F.array_sort(pairs), lambda p: F.get(items, p["i"])))

    def fn_max_by(self, x, key):
        c, t = self._keyed(key, x, lambda items, pairs: F.get(items, F.aggregate(pairs, F.get(pairs, F.lit(0)), lambda a, b: F.when(b["k"] > a["k"], b).otherwise(a))["i"]))
        return c, t.elementType

    def fn_min_by(self, x, key):
        c, t = self._keyed(key, x, lambda items, pairs: F.get(items, F.aggregate(pairs, F.get(pairs, F.lit(0)), lambda a, b: F.when(b["k"] < a["k"], b).otherwise(a))["i"]))
        return c, t.elementType

    def fn_to_array(self, x):
        return x if isinstance(x[1], T.ArrayType) else (F.array(x[0]), T.ArrayType(x[1]))


def compile_typed(e: A.Expr, column: Column, kind: T.DataType) -> Typed:
    """An expression over a column of this type: the resulting column and its type."""
    return TypedCompiler().run(e, (column, kind))
