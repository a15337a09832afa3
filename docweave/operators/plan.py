"""Projection plans: a keep list, an expression or the whole document, with a style and a policy for missing values."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column

from docweave.functions import keeping, rawjson
from docweave.functions.evaluate import evaluate
from docweave.operators.columns import _exact
from docweave.plans import ast as A
from docweave.plans.keep import Keep, Whole, keep_arrays, keep_tree
from docweave.plans.parser import parse
from docweave.plans.planner import array_paths, prefers_rows


@dataclass(frozen=True)
class Plan:
    """Built once on the driver, run for every document."""

    select: A.Expr | Keep
    style: str | int = keeping.COMPACT
    strict: bool = False

    @classmethod
    def identity(cls) -> Plan:
        return cls(Whole())

    @classmethod
    def of_paths(cls, paths: list[str]) -> Plan:
        return cls(keep_tree(paths))

    @classmethod
    def of_jmes(cls, expression: str) -> Plan:
        return cls(parse(expression))

    def with_style(self, style: str | int) -> Plan:
        return replace(self, style=style)

    def with_missing(self, strict: bool) -> Plan:
        return replace(self, strict=strict)

    def array_paths(self) -> list[str]:
        """Arrays that the plan walks over."""
        return keep_arrays(self.select) if isinstance(self.select, Keep) else array_paths(self.select)

    def prefers_rows(self) -> bool:
        """Whether the work on elements is heavy enough to deal them out as rows."""
        return isinstance(self.select, A.Expr) and prefers_rows(self.select)

    def run(self, text: str) -> str:
        if isinstance(self.select, Keep):
            return keeping.kept(self.select, text, self.strict, self.style)
        out = evaluate(self.select, text, self.strict)
        return rawjson.indented(out, self.style) if isinstance(self.style, int) else out

    def apply(self, text: Column, on_error: str = "null") -> Column:
        return _exact(text, self.run, on_error)
