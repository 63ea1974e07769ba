"""Plans on unbounded tables.

Rules are row-wise, so they run on a stream as they stand. Dependencies need
counts over many rows: a stream joins a snapshot of modes, taken from a bounded
table once or refreshed batch by batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.functions.corrector import compile_corrector
from tidyloom.operators.dependency import conditional_modes
from tidyloom.operators.detection import intra_masks
from tidyloom.operators.names import col, fixed, flag, mask, trail
from tidyloom.plans.cleaner import BY_DEPENDENCY, CODE, UNRESOLVED
from tidyloom.plans.model import CleanerPlan, Dependency


def mode_snapshot(table: DataFrame, plan: CleanerPlan, dependencies: Sequence[Dependency]) -> DataFrame:
    """fd, det, mode over a bounded table, under the plan's row-wise marks."""
    masked = intra_masks(table, {c: plan.detectors[c].code if c in plan.detectors else None for c in plan.columns})
    return conditional_modes(masked, dependencies)


def clean_stream(stream: DataFrame, plan: CleanerPlan, modes: DataFrame | None = None, dependencies: Sequence[Dependency] = ()) -> DataFrame:
    """stream with m__, x__, t__ and f__ columns. modes: a snapshot for
    ``dependencies``; their deviations are marked and repaired with it."""
    columns = [c for c in plan.columns if c in stream.columns]
    out = intra_masks(stream, {c: plan.detectors[c].code if c in plan.detectors else None for c in columns})
    by_column: dict[str, int] = {}
    for k, d in enumerate(dependencies if modes is not None else ()):
        own = modes.where(F.col("fd") == k).select(F.col("det").alias(f"__det{k}"), F.col("mode").alias(f"__mode{k}"))
        out = out.join(own, col(d.determinant).cast("string") == F.col(f"__det{k}"), "left_outer").drop(f"__det{k}")
        by_column.setdefault(d.dependent, k)
    added = {}
    for c in columns:
        now, marked, value, layer = col(c), col(mask(c)), col(c), None
        if (k := by_column.get(c)) is not None:
            differs = F.col(f"__mode{k}").isNotNull() & ~F.col(f"__mode{k}").eqNullSafe(now)
            marked = marked | differs
            value, layer = F.when(differs, F.col(f"__mode{k}")).otherwise(now), F.when(differs, F.lit(BY_DEPENDENCY))
        if c in plan.correctors and plan.correctors[c].kind != "none":
            code = compile_corrector(plan.correctors[c], now)
            changes = marked & ~code.eqNullSafe(now)
            value = F.when(changes, code).otherwise(value)
            layer = F.when(changes, F.lit(CODE)).otherwise(layer) if layer is not None else F.when(changes, F.lit(CODE))
        layer = F.coalesce(layer, F.when(marked, F.lit(UNRESOLVED))) if layer is not None else F.when(marked, F.lit(UNRESOLVED))
        added |= {mask(c): marked, fixed(c): value, trail(c): layer, flag(c): F.coalesce(layer == UNRESOLVED, F.lit(False))}
    kept = [x for x in out.columns if not x.startswith("__mode") and x not in added]
    return out.select(*[col(x) for x in kept], *[e.alias(n) for n, e in added.items()])
