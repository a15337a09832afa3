"""Column functions over JSON text or VARIANT documents.

The native ones are compositions of built-in functions. The exact ones (names ending in _exact, edits, keep lists, depth) are Arrow-batched
functions over text: they keep bytes, order and number lexemes. A document that can't be read gives NULL.

Documents: `doc` may be a string column of JSON text, parsed here, or a VARIANT column parsed before with `parsed` (parse once, read often).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.deploy import ship
from docweave.errors import ROW_ERRORS, described
from docweave.functions import batch as batch_
from docweave.functions import checks, edit, keeping, rawjson
from docweave.functions.evaluate import evaluate
from docweave.plans import ast as A
from docweave.plans.keep import Members, keep_tree
from docweave.plans.parser import parse
from docweave.plans.paths import parse_path, parse_pointer
from docweave.plans.variant import VariantCompiler, compile_variant, is_number, key_path, kind_name


def parsed(text: Column | str) -> Column:
    """The VARIANT of a text column; NULL where it is no JSON. Cache it, and every later read is a lookup in its offsets."""
    return F.try_parse_json(text)


# reading by path


def _at(doc: Column, steps) -> Column:
    """The VARIANT at a path, NULL if it is missing or the way leads through another kind."""
    plain = [f"[{s}]" if isinstance(s, int) else key_path(s) for s in steps]
    if all(p is not None for p in plain):
        return F.try_variant_get(doc, "$" + "".join(plain), "variant")
    for s, p in zip(steps, plain):
        doc = F.try_variant_get(doc, "$" + p, "variant") if p else F.try_element_at(F.try_variant_get(doc, "$", "map<string,variant>"), F.lit(s))
    return doc


def _steps(path) -> tuple:
    return path if isinstance(path, tuple) else parse_path(path)


def find(doc: Column, path, kind: str = "variant", strict: bool = False) -> Column:
    """The value at a path as a type; NULL if it is missing, null or of another kind. strict raises for missing values.

    Numbers are not read from strings, nor whole numbers from fractions.
    """
    value = _at(doc, _steps(path))
    out = value if kind == "variant" else decoded(value, kind)
    if strict:
        out = F.when(value.isNull() & doc.isNotNull(), F.raise_error(F.lit(f"PathNotFound: {path}")).cast(kind)).otherwise(out)
    return out


def decoded(value: Column, kind: str) -> Column:
    """A VARIANT as a type, without the conversions that a cast would make between kinds."""
    low = kind.lower()
    whole = low in ("tinyint", "smallint", "int", "bigint", "byte", "short", "integer", "long")
    if whole:
        number = F.try_variant_get(value, "$", "double")
        return F.when(is_number(value) & (number == F.floor(number)), F.try_variant_get(value, "$", kind))
    if low in ("float", "double") or low.startswith("decimal"):
        return F.when(is_number(value), F.try_variant_get(value, "$", kind))
    if low == "string":
        return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.when(~F.is_variant_null(value), F.to_json(value)))
    if low == "boolean":
        return F.when(F.schema_of_variant(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
    return F.try_variant_get(value, "$", kind)


def find_pointer(doc: Column, pointer: str, kind: str = "variant") -> Column:
    """find, by a JSON pointer."""
    return find(doc, parse_pointer(pointer), kind)


def raw(text: Column, path) -> Column:
    """The text of the value at a path, exactly as it stands."""
    steps = _steps(path)
    return _exact(text, lambda t: rawjson.find(t, steps), many=lambda b: batch_.values(b, steps))


def presence(doc: Column, path) -> Column:
    """missing, null or value."""
    value = _at(doc, _steps(path))
    return F.when(doc.isNull(), None).when(value.isNull(), "missing").when(F.is_variant_null(value), "null").otherwise("value")


def contains(doc: Column, path) -> Column:
    return presence(doc, path) != "missing"


def is_null(doc: Column, path) -> Column:
    return presence(doc, path) == "null"


def type_at(doc: Column, path="") -> Column:
    """object, array, string, number, boolean, null; NULL if missing."""
    return kind_name(_at(doc, _steps(path)))


def array_len(doc: Column, path="") -> Column:
    """The number of elements; NULL for anything but an array."""
    return F.size(F.try_variant_get(_at(doc, _steps(path)), "$", "array<variant>"))


def elements(doc: Column, path="", kind: str = "variant") -> Column:
    """The elements of an array, decoded as a type; explode them for rows."""
    array = F.try_variant_get(_at(doc, _steps(path)), "$", "array<variant>")
    return array if kind == "variant" else F.transform(array, lambda x: decoded(x, kind))


def elements_get(doc: Column, path, field, kind: str = "variant") -> Column:
    """One value of each element."""
    steps = _steps(field)
    array = F.try_variant_get(_at(doc, _steps(path)), "$", "array<variant>")
    return F.transform(array, lambda x: find(x, steps, kind))


def entries(doc: Column, path="", kind: str = "variant") -> Column:
    """The members of an object as structs of key and value, sorted by key."""
    members = F.map_entries(F.try_variant_get(_at(doc, _steps(path)), "$", "map<string,variant>"))
    if kind == "variant":
        return members
    return F.transform(members, lambda m: F.struct(m["key"].alias("key"), decoded(m["value"], kind).alias("value")))


def ordered_keys(text: Column) -> Column:
    """The keys of a document's root object in its order, of the text itself."""
    return F.json_object_keys(text)


# expressions


def jmes(doc: Column, expression: str | A.Expr, on_error: str = "null") -> Column:
    """An expression over a VARIANT column, as VARIANT. on_error="raise" fails where a function gets a value of the wrong kind."""
    e = parse(expression) if isinstance(expression, str) else expression
    compiler = VariantCompiler(on_error)
    return compiler.v(compile_variant(e, doc, on_error))


def jmes_as(doc: Column, expression: str, kind: str, on_error: str = "null") -> Column:
    """An expression over a VARIANT column, decoded as a type."""
    val = compile_variant(parse(expression), doc, on_error)
    if (val.kind, kind) in (("b", "boolean"), ("d", "double"), ("s", "string")):
        return val.col
    if val.kind == "d" and kind in ("int", "bigint", "long"):
        return val.col.cast(kind)
    if val.kind == "a" and kind.startswith("array<"):
        inner = kind[6:-1]
        return val.col if inner == "variant" else F.transform(val.col, lambda x: decoded(x, inner))
    return decoded(VariantCompiler(on_error).v(val), kind)


def jmes_rows(doc: Column, expression: str | A.Expr) -> Column:
    """An expression whose result is a list, as an array of VARIANT."""
    e = parse(expression) if isinstance(expression, str) else expression
    return VariantCompiler().a(compile_variant(e, doc))


def jmes_exact(text: Column, expression: str, strict: bool = False, on_error: str = "null") -> Column:
    """An expression over text, as text: order, lexemes and inner white space survive. strict makes missing values errors."""
    e = parse(expression)
    shape = None if strict else _simple(e)
    return _exact(text, lambda t: evaluate(e, t, strict), on_error, many=shape and (lambda b: batch_.projected(b, *shape)))


def _keys(e: A.Expr) -> list[str] | None:
    """The keys of a chain of fields."""
    if isinstance(e, A.Field):
        return [e.name]
    if isinstance(e, A.Sub):
        left, right = _keys(e.of), _keys(e.then)
        return left + right if left and right else None
    return None


def _simple(e: A.Expr) -> tuple | None:
    """The path and the keys of an expression a.b[*].c.d; None for any other."""
    if not isinstance(e, A.Each):
        return None
    path, steps = _keys(e.of), [] if isinstance(e.then, A.Current) else _keys(e.then)
    return (path, steps) if path and steps is not None else None


def _exact(text: Column, function, on_error: str = "null", many=None, kind: str = "string") -> Column:
    """function, over Arrow batches of text. on_error: "null", "raise", or "column" for a struct of value and error.

    many, if given, is the same for a list of UTF-8 texts at once; what it leaves out, as None, goes through function.
    """
    ship()
    decode = kind == "string"

    def all_of(texts: list) -> list:
        if many is None:
            return [run(t) for t in texts]
        at = [i for i, t in enumerate(texts) if t is not None]
        out: list = [(None, None)] * len(texts)
        for i, made in zip(at, batch_.chunked([texts[i].encode() for i in at], many)):
            out[i] = run(texts[i]) if made is None else (made.decode() if decode else made, None)
        return out

    def run(t):
        try:
            return (function(t), None) if t is not None else (None, None)
        except ROW_ERRORS as e:
            if on_error == "raise":
                raise
            return None, described(e)

    if on_error == "column":

        @F.pandas_udf("value string, error string")
        def apply(batch: pd.Series) -> pd.DataFrame:
            return pd.DataFrame(all_of(batch.tolist()), columns=["value", "error"])
    else:

        @F.pandas_udf(kind)
        def apply(batch: pd.Series) -> pd.Series:
            return pd.Series([x for x, _ in all_of(batch.tolist())], dtype=object if decode else "Int64")

    return apply(text)


# keep lists


def keep(text: Column, paths: list[str], style: str | int = keeping.COMPACT, strict: bool = False, on_error: str = "null") -> Column:
    """What a keep list leaves of each document. style: "compact", "preserve", or spaces of an indentation."""
    tree = keep_tree(paths)
    many = None if strict or style != keeping.COMPACT or not isinstance(tree, Members) or not batch_.plain(tree) else lambda b: batch_.kept(tree, b)
    return _exact(text, lambda t: keeping.kept(tree, t, strict, style), on_error, many)


def pretty(text: Column, indent: int = 2) -> Column:
    """Whole documents, indented; NULL for what is no JSON, nests too deep or holds a lone surrogate."""
    return _exact(text, lambda t: rawjson.indented(t, indent))


def projected_len(projected: Column) -> Column:
    """Bytes of projected text."""
    return F.octet_length(projected).cast("long")


def values_len(text: Column, paths: list[str]) -> Column:
    """Bytes of the values at the paths together; NULL if one is missing."""
    steps = [parse_path(p) for p in paths]
    return _exact(text, lambda t: sum(len(rawjson.find(t, s).encode()) for s in steps), many=lambda b: batch_.lengths(b, steps), kind="long")


def estimated_len(text: Column, paths: list[str]) -> Column:
    """About the size of a flat object of the values at the paths: 2 for none; NULL if one is missing."""
    steps = [parse_path(p) for p in paths]
    own = [2 + next((len(s.encode()) for s in reversed(p) if isinstance(s, str)), 0) for p in steps]
    fixed = 2 + len(steps) - 1 + sum(own) + len(steps) if steps else 2
    return F.lit(fixed).cast("long") + values_len(text, paths)


# edits


def edited(text: Column, edits: edit.Edits, on_error: str = "keep") -> Column:
    """Documents after a list of edits, parsed once each. on_error: "keep" the document as it was, "null", "raise", or "column" for a struct of value
    (the document as it was, if a step fails) and error."""
    many = lambda b: batch_.edited(b, edits.ops)
    if on_error == "column":
        ship()

        @F.pandas_udf("value string, error string")
        def both(batch: pd.Series) -> pd.DataFrame:
            texts = batch.tolist()
            at = [i for i, t in enumerate(texts) if t is not None]
            out: list = [(None, None)] * len(texts)
            for i, made in zip(at, batch_.chunked([texts[i].encode() for i in at], many)):
                out[i] = edits.attempt(texts[i]) if made is None else (made.decode(), None)
            return pd.DataFrame(out, columns=["value", "error"])

        return both(text)
    return _exact(text, (lambda t: edits.attempt(t)[0]) if on_error == "keep" else edits.apply, "null" if on_error == "keep" else on_error, many)


def merge_patched(text: Column, patch: Column) -> Column:
    """RFC 7396, each document with the patch of its row; NULL if either is."""
    ship()

    @F.pandas_udf("string")
    def apply(docs: pd.Series, patches: pd.Series) -> pd.Series:
        def run(t, p):
            try:
                return None if t is None or p is None else edit.merge_patch(t, (), p)
            except ROW_ERRORS:
                return None

        return pd.Series([run(t, p) for t, p in zip(docs, patches)], dtype=object)

    return apply(text, patch)


# checks


def _error_of(check, text: str) -> str | None:
    try:
        check(text)
    except ROW_ERRORS as e:
        return described(e)
    return None


def violation(text: Column, check) -> Column:
    """The error that check(text) raises, as text; NULL if it raises none. check: a function of functions.checks, bound to its arguments."""
    ship()

    @F.pandas_udf("string")
    def apply(batch: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _error_of(check, t) for t in batch], dtype=object)

    return apply(text)


def missing_paths(doc: Column, paths: list[str], non_null: bool = False) -> Column:
    """Those of the paths that a VARIANT document lacks (or holds as null, with non_null). Built-in functions only."""
    bad = lambda p: presence(doc, p).isin(["missing", "null"]) if non_null else presence(doc, p) == "missing"
    return F.filter(F.array(*(F.when(bad(p), F.lit(p)) for p in paths)), lambda x: x.isNotNull())


def unknown_keys(doc: Column, path, allowed: list[str]) -> Column:
    """Keys of the object at a path that are not allowed, sorted; NULL if there is no object."""
    keys = F.map_keys(F.try_variant_get(_at(doc, _steps(path)), "$", "map<string,variant>"))
    return F.array_except(keys, F.array(*map(F.lit, allowed)).cast("array<string>"))


def depth(text: Column) -> Column:
    """How deep containers nest (see functions.rawjson.depth_of)."""
    return _exact(text, rawjson.depth_of, many=batch_.depths, kind="int")


def over_limits(text: Column, limits: checks.Limits) -> Column:
    """The limit that a document breaks, as text; NULL if none."""
    most = lambda b: [None if d is None or limits.max_depth is not None and d > limits.max_depth or limits.max_bytes is not None and len(t) > limits.max_bytes else b"" for t, d in zip(b, batch_.depths(b))]
    return F.nullif(_exact(text, lambda t: _error_of(limits.check, t) or "", many=most), F.lit(""))


# building


def object_of(omit_nulls: bool = False, **fields: Column) -> Column:
    """JSON text of an object; nulls are written unless omitted."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())), {"ignoreNullFields": str(omit_nulls).lower()})


def array_of(*items: Column) -> Column:
    """JSON text of an array of columns of one type; nulls are written."""
    return F.to_json(F.array(*items))


def escaped(text: Column) -> Column:
    """A string as JSON text, with its quotes."""
    json_array = F.to_json(F.array(text))
    return F.substring(json_array, F.lit(2), F.length(json_array) - 2)


def unescaped(text: Column) -> Column:
    """The string that JSON text of a string stands for; NULL if it is none."""
    value = F.try_parse_json(text)
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def literal(value: object) -> Column:
    """A Python value as JSON text."""
    return F.lit(edit.encoded(value))
