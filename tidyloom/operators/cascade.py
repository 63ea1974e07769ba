"""Gates of the repair cascade: a layer is used only if every label agrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.functions.corrector import compile_corrector
from tidyloom.plans.model import CorrectionRule


def code_gate(labels: DataFrame, rule: CorrectionRule | None, python: bool = False) -> bool:
    """labels: dirty, clean. Every labelled row, clean ones too, must come out
    exactly; no rule fails, no label passes."""
    if rule is None:
        return False
    out = F.coalesce(compile_corrector(rule, F.col("dirty"), python), F.lit(""))
    return bool(labels.agg(F.coalesce(F.bool_and(out.eqNullSafe(F.col("clean"))), F.lit(True))).first()[0])
