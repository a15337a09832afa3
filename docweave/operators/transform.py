"""Transform pipelines: top-level steps in order, run as one pass over each document."""

from __future__ import annotations

from pyspark.sql import Column

from docweave.errors import PathNotFound, TypeMismatch
from docweave.functions import batch, edit, keeping, rawjson
from docweave.functions.evaluate import evaluate
from docweave.operators.columns import _exact
from docweave.plans.keep import keep_tree
from docweave.plans.parser import parse


def _object(text: str) -> str:
    text = text.strip(" \t\n\r")
    if rawjson.kind_of(text) != "object":
        raise TypeMismatch("the document is no object")
    return text


def _rename(text: str, old: str, new: str) -> str:
    """Missing is no change, and a name that is taken is not looked for."""
    text = _object(text)
    for a, b, _, _ in rawjson.member_spans(text):
        if rawjson.same_key(text[a:b], old):
            return text[:a] + rawjson.key_token(new) + text[b:]
    return text


def _drop(text: str, key: str) -> str:
    try:
        return edit.delete_key(_object(text), (), key)
    except PathNotFound:
        return text


def _styled(text: str, style) -> str:
    return rawjson.indented(text, style) if isinstance(style, int) else text


class TransformPipeline:
    """Steps are added by chaining and run in order, each on what the one before gave. The last style given holds for all keep and jmes steps."""

    def __init__(self, steps: tuple = (), chosen: str | int = keeping.COMPACT):
        self.steps, self.chosen = steps, chosen

    def _then(self, *step) -> TransformPipeline:
        return TransformPipeline((*self.steps, step), self.chosen)

    def keep(self, paths: list[str]) -> TransformPipeline:
        return self._then("keep", keep_tree(paths))

    def jmes(self, expression: str) -> TransformPipeline:
        return self._then("jmes", parse(expression))

    def plan(self, function) -> TransformPipeline:
        """Any function of JSON text; styles don't reach it."""
        return self._then("plan", function)

    def rename(self, old: str, new: str) -> TransformPipeline:
        return self._then("rename", old, new)

    def drop(self, key: str) -> TransformPipeline:
        return self._then("drop", key)

    def inject(self, key: str, value: object, raw: bool = False) -> TransformPipeline:
        """Adds a member at the end; one of this key goes."""
        return self._then("inject", key, edit.one_value(value) if raw else edit.encoded(value))

    def style(self, style: str | int) -> TransformPipeline:
        return TransformPipeline(self.steps, style)

    def run(self, text: str) -> str:
        for name, *args in self.steps:
            if name == "keep":
                text = keeping.kept(args[0], text, style=self.chosen)
            elif name == "jmes":
                text = _styled(evaluate(args[0], text), self.chosen)
            elif name == "plan":
                text = args[0](text)
            elif name == "rename":
                text = _rename(text, *args)
            elif name == "drop":
                text = _drop(text, *args)
            else:
                text = edit.upsert_key(_drop(text, args[0]), (), *args)
        return text

    def apply(self, text: Column, on_error: str = "null") -> Column:
        """The pipeline over a text column, in one Arrow-batched pass without intermediate columns."""
        many = (lambda b: batch.transformed(b, self.steps, self.chosen)) if self.steps else None
        return _exact(text, self.run, on_error, many)
