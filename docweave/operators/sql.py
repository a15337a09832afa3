"""The exact operators as SQL functions, for expressions that come as data: each row may bring its own."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docweave.deploy import ship
from docweave.errors import ROW_ERRORS
from docweave.functions import edit, keeping, rawjson
from docweave.functions.evaluate import evaluate
from docweave.plans.keep import keep_tree
from docweave.plans.parser import parse
from docweave.plans.paths import parse_path


@lru_cache(1024)
def _parse(text: str):
    return parse(text)


@lru_cache(1024)
def _path(text: str):
    return parse_path(text)


@lru_cache(1024)
def _tree(paths: str):
    return keep_tree([p for p in paths.split(",") if p])


def _column(function):
    """function of strings as an Arrow-batched SQL function; nulls and row-time errors give NULL."""

    def run(*batches: pd.Series) -> pd.Series:
        def one(row):
            try:
                return None if any(x is None for x in row) else function(*row)
            except ROW_ERRORS:
                return None

        return pd.Series([one(row) for row in zip(*batches)], dtype=object)

    return run


def _two(batch):
    @F.pandas_udf("string")
    def call(a: pd.Series, b: pd.Series) -> pd.Series:
        return batch(a, b)

    return call


def _three(batch):
    @F.pandas_udf("string")
    def call(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return batch(a, b, c)

    return call


def register(spark: SparkSession) -> None:
    """Registers json_jmes(text, expression), json_find(text, path), json_keep(text, 'path,path'), json_merge_patch(text, patch),
    json_set(text, path, value), json_upsert(text, path, value) and json_delete(text, path)."""
    ship(spark)
    two = {
        "json_jmes": lambda t, e: evaluate(_parse(e), t),
        "json_find": lambda t, p: rawjson.find(t, _path(p)),
        "json_keep": lambda t, p: keeping.kept(_tree(p), t),
        "json_merge_patch": lambda t, p: edit.merge_patch(t, (), p),
        "json_delete": lambda t, p: edit.delete(t, _path(p)),
    }
    three = {"json_set": lambda t, p, v: edit.set_value(t, _path(p), edit.one_value(v)), "json_upsert": lambda t, p, v: edit.upsert(t, _path(p), edit.one_value(v))}
    for name, function in two.items():
        spark.udf.register(name, _two(_column(function)))
    for name, function in three.items():
        spark.udf.register(name, _three(_column(function)))
