"""Indices of documents: where elements and members stand in the text, found once and kept beside it.

A read through an index is a substring by position, of built-in functions alone, however long the document and however many reads there are.
An index holds the hash of the text that it was built from: reads of a text that has changed since give NULL, and `rebuilt` makes a new one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.deploy import ship
from docweave.errors import ROW_ERRORS, TypeMismatch
from docweave.functions import batch
from docweave.functions import rawjson as J
from docweave.plans.paths import parse_path

SPAN = "struct<begin: bigint, stop: bigint>"


def _elements_of(text: str, steps) -> list[tuple[int, int]]:
    """batch.element_spans of one text."""
    start, end = J.find_span(text, steps)
    if J.kind_of(text[start:end]) != "array":
        raise TypeMismatch("no array to index")
    size = lambda at: len(text[:at].encode())
    return [(size(start + s), size(start + e)) for s, e in J.element_spans(text[start:end])]


def _members_of(text: str, steps) -> list[tuple[str, int, int]]:
    """batch.member_spans of one text."""
    start, end = J.find_span(text, steps)
    if J.kind_of(text[start:end]) != "object":
        raise TypeMismatch("no object to index")
    size = lambda at: len(text[:at].encode())
    return [(J.unquoted(text[start + a : start + b]), size(start + c), size(start + d)) for a, b, c, d in J.member_spans(text[start:end])]


def _spans(text: Column, kind: str, many, single, made) -> Column:
    """Spans of each text; NULL where there is no such container or the text can't be read."""
    ship()

    @F.pandas_udf(kind)
    def apply(texts: pd.Series) -> pd.Series:
        known = [i for i, t in enumerate(texts) if t is not None]
        out: list = [None] * len(texts)
        own = texts.tolist()
        for i, found in zip(known, batch.chunked([own[i].encode() for i in known], many)):
            try:
                out[i] = made(single(own[i]) if found is None else found)
            except ROW_ERRORS:
                out[i] = None
        return pd.Series(out, dtype=object)

    return apply(text)


def array_index(text: Column, path: str = "") -> Column:
    """Spans of the elements of the array at a path, as array<struct<begin, stop>> of bytes; NULL if there is none."""
    steps = parse_path(path)
    return _spans(text, f"array<{SPAN}>", lambda b: batch.element_spans(b, steps), lambda t: _elements_of(t, steps), lambda found: [{"begin": s, "stop": e} for s, e in found])


def key_index(text: Column, path: str = "") -> Column:
    """Spans of the members of the object at a path by key, the first of repeated keys; NULL if there is no object."""
    steps = parse_path(path)

    def made(found):
        out: dict = {}
        for key, s, e in found:
            out.setdefault(key, {"begin": s, "stop": e})
        return out

    return _spans(text, f"map<string,{SPAN}>", lambda b: batch.member_spans(b, steps), lambda t: _members_of(t, steps), made)


def spanned(text: Column, span: Column) -> Column:
    """The text at a span of bytes."""
    part = F.substring(F.encode(text, "UTF-8"), (span["begin"] + 1).cast("int"), (span["stop"] - span["begin"]).cast("int"))
    return F.when(span.isNotNull(), F.decode(part, "UTF-8"))


class Indexed:
    """A DataFrame whose documents have indices: Indexed(df, "value", arrays=["lines"], objects=["", "meta"])."""

    def __init__(self, df: DataFrame, doc: str = "value", arrays: list[str] = (), objects: list[str] = ()):
        self.doc, self.arrays, self.objects = doc, list(arrays), list(objects)
        self.df = self._built(df)

    def _built(self, df: DataFrame) -> DataFrame:
        text = F.col(self.doc)
        found = [array_index(text, p).alias(f"a{i}") for i, p in enumerate(self.arrays)] + [key_index(text, p).alias(f"o{i}") for i, p in enumerate(self.objects)]
        return df.withColumn("index_", F.struct(F.xxhash64(text).alias("stamp"), *found))

    def _of(self, df: DataFrame | None) -> Indexed:
        out = object.__new__(Indexed)
        out.__dict__ = self.__dict__ | {"df": df}
        return out

    def kept(self) -> Indexed:
        """The index in memory, for several queries; release() gives the memory back."""
        return self._of(self.df.persist())

    def release(self) -> None:
        self.df.unpersist()

    def edited(self, text: Column) -> Indexed:
        """With other texts: the indices stay and are stale where a text is another."""
        return self._of(self.df.withColumn(self.doc, text))

    def rebuilt(self) -> Indexed:
        return self._of(self._built(self.df.drop("index_")))

    def fresh(self) -> Column:
        """Whether a row's index is of the text that it has now."""
        return F.col("index_.stamp").eqNullSafe(F.xxhash64(F.col(self.doc)))

    def _array(self, path: str) -> Column:
        return F.col(f"index_.a{self.arrays.index(path)}")

    def _object(self, path: str) -> Column:
        return F.col(f"index_.o{self.objects.index(path)}")

    def size(self, path: str) -> Column:
        """Elements of an indexed array."""
        spans = self._array(path)
        return F.when(self.fresh() & spans.isNotNull(), F.size(spans))

    def element(self, path: str, at: int) -> Column:
        """The text of an element; negative numbers count from the end."""
        spans = self._array(path)
        span = F.get(spans, F.lit(at) if at >= 0 else F.size(spans) + at)
        return F.when(self.fresh(), spanned(F.col(self.doc), span))

    def keys(self, path: str = "") -> Column:
        """Keys of an indexed object, in the order of the text."""
        return F.when(self.fresh(), F.map_keys(self._object(path)))

    def member(self, path: str, key: str) -> Column:
        """The text of a member's value."""
        return F.when(self.fresh(), spanned(F.col(self.doc), F.try_element_at(self._object(path), F.lit(key))))

    def counts(self) -> Column:
        """How many elements and members the indices of a row hold, by path."""
        sizes = [x for p in self.arrays for x in (F.lit(p), F.size(self._array(p)))] + [x for p in self.objects for x in (F.lit(p or "@"), F.size(self._object(p)))]
        return F.create_map(*sizes)
