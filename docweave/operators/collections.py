"""Typed collections as columns: lists, maps and nested values of a declared type, read by one pruned from_json."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.operators.frames import at_path


def _type(kind: str | T.DataType) -> T.DataType:
    return kind if isinstance(kind, T.DataType) else T._parse_datatype_string(kind)


class Policy(Enum):
    """How a list is collected: as rows to stream, as an owned array, or as JSON cards."""

    STREAM = "stream"
    OWNED = "owned"
    PROJECTED = "projected"


class ListView:
    """An array of values or of structs: ListView(text, "products", "struct<id: bigint, price: double>")."""

    def __init__(self, text: Column, path: str, element: str | T.DataType):
        self.element = _type(element)
        kind = T.ArrayType(self.element)
        self.items = F.from_json(text, kind) if path in ("", "@") else at_path(text, path, kind)

    def size(self) -> Column:
        return F.when(self.items.isNotNull(), F.size(self.items))

    def is_empty(self) -> Column:
        return F.size(self.items) == 0

    def get(self, index: int) -> Column:
        """One element, in constant time of the materialised array; NULL past the end."""
        return F.get(self.items, F.lit(index))

    def rows(self) -> Column:
        """A generator: one row an element."""
        return F.explode(self.items)

    def filtered(self, test) -> Column:
        return F.filter(self.items, test)

    def field(self, *names: str) -> Column:
        """One field, or a nested one, of each element."""

        def down(x):
            for n in names:
                x = x[n]
            return x

        return F.transform(self.items, down)

    def sum_field(self, *names: str) -> Column:
        """The sum of a whole-number field; NULL if an element lacks it. Overflow is an error."""
        values = self.field(*names)
        return F.when(~F.exists(values, lambda x: x.isNull()), F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x))

    def cards(self) -> Column:
        """Each element as JSON text."""
        return F.transform(self.items, lambda x: F.to_json(x, {"ignoreNullFields": "false"}))

    def collect(self, policy: Policy) -> Column:
        return {Policy.STREAM: self.rows, Policy.OWNED: lambda: self.items, Policy.PROJECTED: self.cards}[policy]()


class MapView:
    """An object of values of one type."""

    def __init__(self, text: Column, path: str, value: str | T.DataType):
        kind = T.MapType(T.StringType(), _type(value))
        self.map = F.from_json(text, kind) if path in ("", "@") else at_path(text, path, kind)

    def get(self, key: str | Column) -> Column:
        return F.try_element_at(self.map, F.lit(key) if isinstance(key, str) else key)

    def contains(self, key: str) -> Column:
        return F.map_contains_key(self.map, key)

    def size(self) -> Column:
        return F.when(self.map.isNotNull(), F.size(self.map))

    def is_empty(self) -> Column:
        return F.size(self.map) == 0

    def entries(self) -> Column:
        """Structs of key and value, in the document's order."""
        return F.map_entries(self.map)

    def rows(self) -> Column:
        return F.explode(self.map)


class Nested:
    """A value at a path as the root of further reads."""

    def __init__(self, text: Column, path: str, kind: str | T.DataType):
        self.kind = _type(kind)
        self.value = at_path(text, path, self.kind)

    def get(self, *names: str) -> Column:
        out = self.value
        for n in names:
            out = out[n]
        return out
