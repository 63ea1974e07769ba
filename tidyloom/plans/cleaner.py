"""A plan compiled to one lazy DataFrame: masks, repairs, flags, trail.

All masks stand before any repair, and every mode is counted on the values as
they came: deviations read the rules' own marks, repairs read the marks of both.
A cell is settled by the first layer that changes it; marked cells that nothing
changed are flagged and keep their value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.functions.corrector import compile_corrector
from tidyloom.operators import dependency
from tidyloom.operators.detection import intra_masks, union_masks
from tidyloom.operators.names import col, fixed, flag, mask, trail
from tidyloom.plans.model import CleanerPlan

CODE, BY_DEPENDENCY, UNRESOLVED = "code", "dependency", "unresolved"


def masked(df: DataFrame, plan: CleanerPlan, log: list[str] | None = None, python: bool = False) -> DataFrame:
    """df with m__<column> for the plan's columns: rules, then deviations. With
    ``python``, rules outside the compiled language run as batched Python."""
    columns = [c for c in plan.columns if c in df.columns]
    df = intra_masks(df, {c: plan.detectors[c].code if c in plan.detectors else None for c in columns}, log, python)
    wanted = [d for d in plan.detect if d.determinant in df.columns and d.dependent in columns]
    if not wanted:
        return df
    kept = list(df.columns)
    df = dependency.deviations(df, wanted)
    return union_masks(df, sorted({d.dependent for d in wanted}), "m__", "d__").select(*[col(c) for c in kept])


def repaired(df: DataFrame, plan: CleanerPlan, python: bool = False) -> DataFrame:
    """masked rows with x__, f__ and t__<column>: value, flag and layer."""
    columns = [c for c in plan.columns if c in df.columns]
    usable = [d for d in plan.correct if d.determinant in df.columns and d.dependent in columns]
    kept = list(df.columns)
    df = dependency.with_modes(df, usable, "m__", "__mode")
    coded = {c: compile_corrector(plan.correctors[c], col(c), python) for c in columns if c in plan.correctors and plan.correctors[c].kind != "none"}
    df = df.withColumns({f"__code{k}": F.coalesce(coded[c], F.lit("")) for k, c in enumerate(coded)})
    code_of = {c: F.col(f"__code{k}") for k, c in enumerate(coded)}
    out = []
    for c in columns:
        value, layer = col(c), F.when(col(mask(c)), F.lit(UNRESOLVED))
        for k, d in reversed(list(enumerate(usable))):
            if d.dependent == c:
                changes = col(mask(c)) & F.col(f"__mode{k}").isNotNull() & ~F.col(f"__mode{k}").eqNullSafe(col(c))
                value, layer = F.when(changes, F.col(f"__mode{k}")).otherwise(value), F.when(changes, F.lit(BY_DEPENDENCY)).otherwise(layer)
        if c in code_of:
            changes = col(mask(c)) & ~code_of[c].eqNullSafe(col(c))
            value, layer = F.when(changes, code_of[c]).otherwise(value), F.when(changes, F.lit(CODE)).otherwise(layer)
        out += [value.alias(fixed(c)), layer.alias(trail(c))]
    df = df.select(*[col(c) for c in kept], *out)
    return df.withColumns({flag(c): F.coalesce(col(trail(c)) == UNRESOLVED, F.lit(False)) for c in columns})


def apply_plan(df: DataFrame, plan: CleanerPlan, log: list[str] | None = None, python: bool = False) -> DataFrame:
    return repaired(masked(df, plan, log, python), plan, python)


def corrected(applied: DataFrame, columns: Sequence[str], original: Sequence[str]) -> DataFrame:
    """The table as it came, with the plan's columns repaired."""
    done = set(columns)
    return applied.select(*[col(fixed(c)).alias(c) if c in done else col(c) for c in original])


def flags(applied: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return applied.select(*[col(k) for k in keys], *[col(flag(c)).alias(c) for c in columns])


def trail_counts(applied: DataFrame, columns: Sequence[str]) -> DataFrame:
    """col_name, marked, code, dependency, unresolved; the last three add up to
    the first. One pass for all columns."""
    parts = F.array(*[F.struct(F.lit(c).alias("col_name"), col(mask(c)).alias("marked"), col(trail(c)).alias("layer")) for c in columns])
    one = applied.select(F.explode(parts).alias("p")).groupBy("p.col_name")
    return one.agg(
        F.count_if("p.marked").alias("marked"),
        *[F.count_if(F.coalesce(F.col("p.layer") == x, F.lit(False))).alias(x) for x in (CODE, BY_DEPENDENCY, UNRESOLVED)],
    )
