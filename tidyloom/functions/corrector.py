"""Correction rules: four kinds of change behind a guard, as Columns, and Python
functions for those who need them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidyloom.functions import regex
from tidyloom.functions.fallback import python_corrector
from tidyloom.plans.model import CorrectionRule

IDENTITY = CorrectionRule(kind="none")


class PythonNotAllowed(ValueError):
    pass


def compile_corrector(rule: CorrectionRule, column: Column, python: bool = False) -> Column:
    """The repaired value. Rules of kind "code" run only if ``python`` says so: a
    plan file alone must not be enough to run what stands in it."""
    if rule.kind == "none":
        return column
    if rule.kind == "regex_sub":
        changed = F.regexp_replace(column, F.lit(regex.search(rule.pattern or "")), F.lit(regex.java_replacement(rule.replacement or "")))
    elif rule.kind == "mapping":
        if not rule.mapping:
            return column
        table = F.create_map(*[F.lit(x) for pair in sorted(rule.mapping.items()) for x in pair])
        changed = F.coalesce(F.element_at(table, column), column)
    elif rule.kind == "constant":
        changed = F.lit(rule.value or "")
    elif rule.kind == "code":
        if not python:
            raise PythonNotAllowed("a rule in Python needs python=True (--allow-python)")
        changed = python_corrector(rule.code or "", column)
    else:
        raise ValueError(f"unknown kind of correction: {rule.kind}")
    if rule.guard is None:
        return changed
    return F.when(column.rlike(regex.search(rule.guard)), changed).otherwise(column)
