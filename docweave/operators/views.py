"""Views: partial, open schemas over documents. A view names some fields; the rest of a document is neither read nor changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.edit import Edits
from docweave.operators import columns as C
from docweave.plans.paths import array_prefixes, parse_path


@dataclass(frozen=True)
class ViewField:
    """One field: its type and where it comes from, a path or an expression.

    optional: missing and null are NULL. default: used where the value is missing, not where it is null. Otherwise the value is required.
    """

    name: str
    kind: str
    path: str | None = None
    jmes: str | None = None
    optional: bool = False
    default: object = None

    @property
    def where(self) -> str:
        return self.path or self.name


class View:
    """View(ViewField("id", "bigint"), ViewField("rank", "int", path="meta.rank", default=0), ...)"""

    def __init__(self, *fields: ViewField):
        self.fields = fields

    @property
    def field_paths(self) -> list[str]:
        return [f.where for f in self.fields if f.jmes is None]

    @property
    def field_jmes(self) -> dict[str, str]:
        return {f.name: f.jmes for f in self.fields if f.jmes is not None}

    @property
    def array_paths(self) -> list[str]:
        """Arrays that the fields' paths go through."""
        return sorted({p for f in self.fields if f.jmes is None for p in array_prefixes(f.where)})

    def _value(self, f: ViewField, doc: Column) -> Column:
        return C.jmes(doc, f.jmes) if f.jmes is not None else C.find(doc, f.where)

    def read(self, doc: Column, on_error: str = "null") -> Column:
        """The fields of a VARIANT document as a struct. A required field that is missing or of another kind makes the struct NULL, or fails with
        on_error="raise"."""
        made, bad = [], F.lit(False)
        for f in self.fields:
            value = self._value(f, doc)
            own = C.decoded(value, f.kind)
            if f.default is not None:
                own = F.when(value.isNull(), F.lit(f.default).cast(f.kind)).otherwise(own)
            if not f.optional:
                bad = bad | own.isNull()
            elif f.default is None:
                bad = bad | (own.isNull() & value.isNotNull() & ~F.is_variant_null(value))
            made.append(own.alias(f.name))
        struct = F.struct(*made)
        if on_error == "raise":
            return F.when(doc.isNotNull() & bad, F.raise_error(F.lit("MissingField or Decode: a required field")).cast(self.ddl)).when(doc.isNotNull(), struct)
        return F.when(doc.isNotNull() & ~bad, struct)

    @property
    def ddl(self) -> str:
        return "struct<" + ", ".join(f"`{f.name}`: {f.kind}" for f in self.fields) + ">"

    def read_each(self, doc: Column, array_path: str) -> Column:
        """The view of each element of an array; explode it for rows."""
        return F.transform(C.elements(doc, array_path), lambda x: self.read(x))

    def expression(self) -> str | None:
        """The hash of all fields, if one of them has an expression; otherwise the view projects as a keep list."""
        if not self.field_jmes:
            return None
        return "{" + ", ".join(f"{f.name}: {f.jmes or f.where}" for f in self.fields) + "}"

    def project(self, text: Column) -> Column:
        """Documents cut down to the view: a keep list of its paths, or, with expressions, an object of its fields."""
        expression = self.expression()
        return C.keep(text, self.field_paths) if expression is None else C.jmes_exact(text, expression)

    def write(self, text: Column, values: dict[str, object]) -> Column:
        """Documents with constant values written to the fields' paths; everything else keeps its bytes."""
        edits = Edits()
        for f in self.fields:
            if f.name in values and f.jmes is None:
                edits = edits.upsert(f.where, values[f.name])
        return C.edited(text, edits)

    def to_json(self, struct: Column) -> Column:
        """A struct of the view's fields as a document of its own, nested by their paths; optional fields that are NULL are left out."""
        tree: dict = {}
        for f in self.fields:
            node = tree
            *parents, last = parse_path(f.where)
            for p in parents:
                node = node.setdefault(p, {})
            node[last] = struct[f.name]

        def made(node):
            return F.struct(*((made(v) if isinstance(v, dict) else v).alias(k) for k, v in node.items()))

        return F.to_json(made(tree))

    # generated editors

    def set_field(self, text: Column, name: str, value: object) -> Column:
        return C.edited(text, Edits().set(self._path(name), value))

    def delete_field(self, text: Column, name: str) -> Column:
        return C.edited(text, Edits().delete(self._path(name)))

    def append_field(self, text: Column, name: str, value: object) -> Column:
        return C.edited(text, Edits().append(self._path(name), value))

    def prepend_field(self, text: Column, name: str, value: object) -> Column:
        return C.edited(text, Edits().prepend(self._path(name), value))

    def insert_field(self, text: Column, name: str, index: int, value: object) -> Column:
        return C.edited(text, Edits().insert(self._path(name), index, value))

    def delete_at(self, text: Column, name: str, index: int) -> Column:
        return C.edited(text, Edits().delete((*parse_path(self._path(name)), index)))

    def _path(self, name: str) -> str:
        return next(f.where for f in self.fields if f.name == name)
