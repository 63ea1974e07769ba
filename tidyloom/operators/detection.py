"""Intra-column detection: every rule a boolean column on the same rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.functions.detector import NOTHING, RuleRejected, compile_detector
from tidyloom.functions.fallback import python_detector
from tidyloom.operators.names import col, mask, told


def intra_masks(df: DataFrame, rules: Mapping[str, str | None], log: list[str] | None = None, python: bool = False) -> DataFrame:
    """Add m__<column> for each data column of ``rules``. Columns without a rule
    are unmarked; a rule that can't be compiled or analysed leaves its column
    unmarked and is logged, without touching the others. With ``python``, rules
    outside the compiled language run as batched Python instead."""
    added = {}
    for name, code in rules.items():
        if name not in df.columns:
            continue
        try:
            try:
                found = compile_detector(code or NOTHING, col(name))
            except RuleRejected:
                if not python:
                    raise
                found = python_detector(code, col(name))
            df.select(found)  # analysed now, run later
        except (RuleRejected, PySparkException) as e:
            found = F.lit(False)
            if log is not None:
                log.append(f"{name}: {told(e)}")
        added[mask(name)] = found
    return df.withColumns(added)


def union_masks(df: DataFrame, columns: Sequence[str], first: str, second: str) -> DataFrame:
    """m__<column> = first<column> or second<column>."""
    return df.withColumns({mask(c): F.coalesce(col(first + c), F.lit(False)) | F.coalesce(col(second + c), F.lit(False)) for c in columns})
