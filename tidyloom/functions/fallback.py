"""Rules as Python, for what the compiled language can't say. Opt-in.

The code passes the same structural gate and runs in Arrow batches on the
executors, with ``re`` and a few harmless builtins in reach. That keeps mistakes
out; it is no security boundary.
"""

from __future__ import annotations

import builtins
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidyloom.functions.detector import ATTRIBUTES, FUNCTION, RuleRejected, function_of

CORRECTOR = "corrigir"
# The builtins that a rule may use.
BUILTINS = ("abs", "all", "any", "bool", "chr", "dict", "enumerate", "filter", "float", "int", "isinstance", "len", "list", "map", "max", "min", "ord", "range", "repr", "reversed", "round", "set", "sorted", "str", "sum", "tuple", "zip", "Exception", "ValueError", "TypeError", "IndexError", "KeyError", "True", "False", "None")


def load(code: str, name: str):
    function_of(code, name)
    scope = {"re": re, "__builtins__": {b: getattr(builtins, b) for b in BUILTINS if hasattr(builtins, b)}}
    exec(compile(code, f"<{name}>", "exec"), scope)  # noqa: S102  gated, and only where the user asked for it
    return scope[name]


def python_corrector(code: str, column: Column) -> Column:
    """A scalar function of a text; None counts as an empty text."""
    function_of(code, CORRECTOR)

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        f = load(code, CORRECTOR)
        cells = [v if isinstance(v, str) else None for v in values]
        new = {v: "" if (fixed := f(v)) is None else str(fixed) for v in set(cells) if v is not None}
        return pd.Series([new.get(v) for v in cells], dtype=object)

    return run(column)


def python_detector(code: str, column: Column) -> Column:
    """A function of a text column to truth values, row by row."""
    import ast

    for node in ast.walk(function_of(code, FUNCTION)):
        if isinstance(node, ast.Attribute) and node.attr not in ATTRIBUTES and not (isinstance(node.value, ast.Name) and node.value.id == "re"):
            raise RuleRejected(f"attribute {node.attr}")

    @F.pandas_udf("boolean")
    def run(values: pd.Series) -> pd.Series:
        found = load(code, FUNCTION)(pd.Series([v if isinstance(v, str) else None for v in values], dtype=object))
        if not isinstance(found, pd.Series) or len(found) != len(values):
            raise ValueError("a detector must return one truth value a row")
        return pd.Series(found.fillna(False).to_numpy(dtype=bool))

    return F.coalesce(run(column), F.lit(False))
