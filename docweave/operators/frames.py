"""DataFrame operators: documents to rows and back.

A document is a row; its elements become rows by explode, so that filters, joins and aggregates on them are Spark's own. `cards` and `typed` read by a
declared schema (one pruned from_json), `each` by expressions over VARIANT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.operators import columns as C
from docweave.plans.parser import parse
from docweave.plans.paths import parse_path
from docweave.plans.planner import card_expression, peeled, prefers_rows
from docweave.plans.typed import compile_typed
from docweave.plans.variant import VariantCompiler, compile_variant


def _fields(spec: str | T.StructType) -> T.StructType:
    return spec if isinstance(spec, T.StructType) else T._parse_datatype_string(f"struct<{spec}>")


def nested_type(path: str, leaf: T.DataType) -> T.DataType:
    """The schema that reads only what lies at a path of keys."""
    for key in reversed(parse_path(path)):
        leaf = T.StructType([T.StructField(key, leaf)])
    return leaf


def at_path(text: Column, path: str, kind: T.DataType) -> Column:
    """The value at a path of keys of a text column, read by one from_json."""
    column = F.from_json(text, nested_type(path, kind))
    for key in parse_path(path):
        column = column[key]
    return column


def typed(df: DataFrame, doc: str, expression: str, schema: str | T.StructType, name: str) -> DataFrame:
    """df with an expression over documents of a declared schema, as a typed column."""
    kind = _fields(schema)
    column, _ = compile_typed(parse(expression), F.from_json(F.col(doc), kind), kind)
    return df.withColumn(name, column)


def cards(df: DataFrame, doc: str, array_path: str, fields: str | T.StructType, keep: list[str] | None = None, index: str | None = None, spread: int | None = None) -> DataFrame:
    """A row for each element of an array of objects, with the named fields as typed columns beside the columns keep of df.

    Missing fields are null. Null elements are skipped; index, if named, numbers the elements that are left, within their document.
    spread deals the documents out over so many partitions first, for few large ones.
    """
    kind = T.ArrayType(_fields(fields))
    keep = [c for c in df.columns if c != doc] if keep is None else keep
    array = F.filter(F.from_json(F.col(doc), kind) if array_path in ("", "@") else at_path(F.col(doc), array_path, kind), lambda x: x.isNotNull())
    rows = df.repartition(spread) if spread else df
    rows = rows.select(*keep, F.posexplode(array).alias("_i", "_x"))
    return rows.select(*keep, *([F.col("_i").alias(index)] if index else []), "_x.*")


def each(df: DataFrame, doc: Column | str, expression: str, keep: list[str] | None = None, strict: bool = False, spread: int | None = None) -> DataFrame:
    """A row (i, card) for each value that a projection gives; card is VARIANT, i counts the values kept of a document.

    The expression must be path[*], path[?...] or path[a:b] with what follows. A document without the array gives no rows; strict fails there.
    Where the planner finds the work on an element heavy, spread deals documents out over so many partitions first.
    """
    e = peeled(parse(expression))
    document = C.parsed(doc) if isinstance(doc, str) and dict(df.dtypes)[doc] == "string" else F.col(doc) if isinstance(doc, str) else doc
    keep = df.columns if keep is None else keep
    rows = df.repartition(spread) if spread and prefers_rows(e) else df
    rows = rows.select(*keep, document.alias("_d"))
    compiler = VariantCompiler()
    array = compiler.a(compile_variant(e, F.col("_d")))
    if strict:
        root = compiler.a(compile_variant(e.of, F.col("_d")))
        array = F.when(root.isNull() & F.col("_d").isNotNull(), F.raise_error(F.lit(f"TypeMismatch: no array for {expression}")).cast("array<variant>")).otherwise(array)
    return rows.select(*keep, F.posexplode(array).alias("i", "card"))


def each_card(df: DataFrame, doc: str, array_path: str, fields: list[str], **more) -> DataFrame:
    """each, for thin cards of the named fields."""
    return each(df, doc, card_expression(array_path, fields), **more)


def card_lines(df: DataFrame, doc: str, expression: str, **more) -> DataFrame:
    """One column value: the JSON text of each card, a line each when written as text."""
    return each(df, doc, expression, keep=[], **more).select(F.to_json("card").alias("value"))


def explode_entries(df: DataFrame, doc: str, path: str, value_type: str, keep: list[str]) -> DataFrame:
    """A row (key, value) for each member of an object, by a map schema; keys in the document's order within a row."""
    kind = T.MapType(T.StringType(), T._parse_datatype_string(value_type))
    column = F.from_json(F.col(doc), kind) if path in ("", "@") else at_path(F.col(doc), path, kind)
    return df.select(*keep, F.explode(column).alias("key", "value"))


def to_documents(df: DataFrame, by: list[str], array: str, order: list[str], fields: list[str]) -> DataFrame:
    """Documents built from rows: one a group of `by`, with an array of objects of `fields`, ordered by `order`."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("_x"))))
    return df.groupBy(*by).agg(F.transform(items, lambda r: r["_x"]).alias(array))


class JsonFrame:
    """A DataFrame and the name of its document column, with the operators as methods. Documents are parsed once, on first use as VARIANT."""

    def __init__(self, df: DataFrame, doc: str = "value"):
        self.df, self.doc = df, doc

    def with_df(self, df: DataFrame) -> JsonFrame:
        return JsonFrame(df, self.doc)

    def indexed(self) -> JsonFrame:
        """Documents parsed and cached, for several queries over them, until release(). See operators.index for reads by position."""
        return self.with_df(self.df.withColumn(self.doc, self.variant()).cache())

    def release(self) -> None:
        """Gives back what indexed() cached."""
        self.df.unpersist()

    def variant(self) -> Column:
        return F.col(self.doc) if dict(self.df.dtypes)[self.doc] == "variant" else C.parsed(F.col(self.doc))

    def get(self, name: str, path: str, kind: str = "variant") -> JsonFrame:
        return self.with_df(self.df.withColumn(name, C.find(self.variant(), path, kind)))

    def jmes(self, name: str, expression: str, kind: str | None = None) -> JsonFrame:
        return self.with_df(self.df.withColumn(name, C.jmes_as(self.variant(), expression, kind) if kind else C.jmes(self.variant(), expression)))

    def keep(self, paths: list[str], style="compact") -> JsonFrame:
        return self.with_df(self.df.withColumn(self.doc, C.keep(F.col(self.doc), paths, style)))

    def edit(self, edits, on_error: str = "keep") -> JsonFrame:
        return self.with_df(self.df.withColumn(self.doc, C.edited(F.col(self.doc), edits, on_error)))

    def each(self, expression: str, **more) -> DataFrame:
        return each(self.df, self.doc, expression, **more)

    def cards(self, array_path: str, fields: str, **more) -> DataFrame:
        return cards(self.df, self.doc, array_path, fields, **more)
