"""Detection, correction and repair metrics, each one aggregation pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyloom.operators.names import RID, col, flag


def paired(applied: DataFrame, clean: DataFrame, columns: Sequence[str], key: str = RID) -> DataFrame:
    """applied with k__<column>, the clean values, joined on the row key once."""
    right = clean.select(col(key).alias("__key"), *[col(c).alias(f"k__{c}") for c in columns])
    return applied.join(right, col(key) == F.col("__key")).drop("__key")


def _melted(pairs: DataFrame, columns: Sequence[str], marked: str, value: str) -> DataFrame:
    cells = [
        F.struct(
            F.lit(c).alias("col_name"),
            col(c).alias("dirty"),
            col(f"k__{c}").alias("clean"),
            (col(marked + c) if marked + c in pairs.columns else F.lit(False)).alias("marked"),
            (col(value + c) if value + c in pairs.columns else col(c)).alias("now"),
            (col(flag(c)) if flag(c) in pairs.columns else F.lit(False)).alias("flagged"),
        )
        for c in columns
    ]
    return pairs.select(F.explode(F.array(*cells)).alias("c")).select("c.*").withColumn("wrong", ~F.col("dirty").eqNullSafe(F.col("clean")))


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p.isNotNull() & r.isNotNull(), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def detection_metrics(pairs: DataFrame, columns: Sequence[str], holdout: DataFrame | None = None, marked: str = "m__") -> DataFrame:
    """Per column tp, fp, fn, tn and precision, recall, f1 over the rows outside
    ``holdout`` (_rid); the ratios are null for a column without errors, and
    precision is 0 where there are errors but no marks."""
    if holdout is not None:
        pairs = pairs.join(holdout.select(RID).distinct(), RID, "left_anti")
    one = _melted(pairs, columns, marked, "x__").groupBy("col_name")
    m, w = F.coalesce("marked", F.lit(False)), F.col("wrong")
    counts = one.agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(m & w).alias("tp"), F.count_if(m & ~w).alias("fp"), F.count_if(~m & w).alias("fn"), F.count_if(~m & ~w).alias("tn")
    )
    real = F.col("tp") + F.col("fn") > 0
    counts = counts.withColumn("precision", F.when(real, F.coalesce(_ratio(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)))).withColumn(
        "recall", F.when(real, _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    )
    return counts.withColumn("f1", _f1(F.col("precision"), F.col("recall"))).withColumn("measurable", real)


def correction_metrics(pairs: DataFrame, columns: Sequence[str], holdout: DataFrame | None = None) -> DataFrame:
    """Per column wrong and right cells, hits, damage and their rates (null on
    an empty denominator)."""
    if holdout is not None:
        pairs = pairs.join(holdout.select(RID).distinct(), RID, "left_anti")
    good = F.col("now").eqNullSafe(F.col("clean"))
    counts = _melted(pairs, columns, "m__", "x__").groupBy("col_name").agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if("wrong").alias("wrong"),
        F.count_if(~F.col("wrong")).alias("right"),
        F.count_if(F.col("wrong") & good).alias("hits"),
        F.count_if(~F.col("wrong") & ~good).alias("damage"),
    )
    return counts.withColumn("hit_rate", _ratio(F.col("hits"), F.col("wrong"))).withColumn("damage_rate", _ratio(F.col("damage"), F.col("right")))


def repair_metrics(pairs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column errors, changes, tp, flags and the ratios; all null for a
    column without errors but its flags."""
    changed = ~F.col("now").eqNullSafe(F.col("dirty"))
    counts = _melted(pairs, columns, "m__", "x__").groupBy("col_name").agg(
        F.count_if("wrong").alias("errors"),
        F.count_if(changed).alias("changes"),
        F.count_if(changed & F.col("wrong") & F.col("now").eqNullSafe(F.col("clean"))).alias("tp"),
        F.count_if(F.coalesce("flagged", F.lit(False))).alias("flags"),
    )
    measurable = F.col("errors") > 0
    return (
        counts.withColumn("measurable", measurable)
        .withColumn("precision", F.when(measurable, _ratio(F.col("tp"), F.col("changes"))))
        .withColumn("recall", F.when(measurable, _ratio(F.col("tp"), F.col("errors"))))
        .withColumn("f1", F.when(measurable, _f1(F.col("precision"), F.col("recall"))))
    )


def repair_total(per_column: DataFrame) -> DataFrame:
    """Micro totals: errors, changes and tp of measurable columns, all flags."""
    own = lambda c: F.coalesce(F.sum(F.when(F.col("measurable"), F.col(c))), F.lit(0)).cast("long").alias(c)
    total = per_column.agg(own("errors"), own("changes"), own("tp"), F.sum("flags").alias("flags"))
    precision, recall = _ratio(F.col("tp"), F.col("changes")), F.coalesce(_ratio(F.col("tp"), F.col("errors")), F.lit(0.0))
    return total.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", _f1(F.col("precision"), F.col("recall")))
