"""Functional dependencies: discovery, gate, detection and repair.

Conditional modes are counts per (determinant, dependent) reduced to the most
frequent value, smallest on ties. Counting is map-side combined and the reduce
sees one row a distinct pair, so a determinant of a third of all rows costs no
more than another. All dependencies of a plan share one counting shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidyloom.operators.names import RID, col, mask
from tidyloom.plans.model import Dependency

THRESHOLD = 0.45  # a ratio that rounds to 0.5 at one decimal


def conditional_modes(df: DataFrame, dependencies: Sequence[Dependency], masks: str = "m__") -> DataFrame:
    """fd (position in ``dependencies``), det, mode. A row counts only if both of
    its cells are unmarked under ``masks``; determinants whose rows are all
    marked have no mode."""
    cells = F.array(
        *[
            F.struct(
                F.lit(k).alias("fd"),
                col(d.determinant).cast("string").alias("det"),
                F.when(~_marked(df, masks, d.determinant) & ~_marked(df, masks, d.dependent), col(d.dependent).cast("string")).alias("value"),
            )
            for k, d in enumerate(dependencies)
        ]
    )
    counted = df.select(F.explode(cells).alias("c")).where("c.value is not null and c.det is not null").groupBy("c.fd", "c.det", "c.value").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("value")))
    return counted.groupBy("fd", "det").agg(best.alias("best")).select("fd", "det", F.col("best.value").alias("mode"))


def _marked(df: DataFrame, masks: str, name: str) -> Column:
    return F.coalesce(col(masks + name), F.lit(False)) if masks + name in df.columns else F.lit(False)


def with_modes(df: DataFrame, dependencies: Sequence[Dependency], masks: str, prefix: str) -> DataFrame:
    """Add <prefix>k, the mode of dependency k for each row, by left equi-joins;
    small mode tables are broadcast by the planner at run time."""
    if not dependencies:
        return df
    modes = conditional_modes(df, dependencies, masks)
    for k, d in enumerate(dependencies):
        own = modes.where(F.col("fd") == k).select(F.col("det").alias(f"__det{k}"), F.col("mode").alias(f"{prefix}{k}"))
        df = df.join(own, col(d.determinant).cast("string") == F.col(f"__det{k}"), "left_outer").drop(f"__det{k}")
    return df


def deviations(df: DataFrame, dependencies: Sequence[Dependency], masks: str = "m__", out: str = "d__") -> DataFrame:
    """Add d__<dependent>: the cell differs from its group's mode. Modes read the
    masks as given, so marks of one dependency don't feed another."""
    kept = list(df.columns)
    joined = with_modes(df, dependencies, masks, "__mode")
    marks: dict[str, Column] = {}
    for k, d in enumerate(dependencies):
        now = F.col(f"__mode{k}").isNotNull() & ~col(d.dependent).cast("string").eqNullSafe(F.col(f"__mode{k}"))
        marks[d.dependent] = marks[d.dependent] | now if d.dependent in marks else now
    return joined.select(*[col(c) for c in kept], *[m.alias(out + c) for c, m in marks.items()])


def mutual_information(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """target, candidate, mi (nats) for all ordered pairs of columns. Of a pair
    only value combinations that occur twice count, of a column with itself all.
    Columns in which no value comes twice have no such combination and are left
    out of the pairs beforehand. Two counting shuffles serve all, one of columns
    and one of pairs (each unordered pair is counted once)."""
    texts = [col(c).cast("string") for c in columns]

    def counts(pairs: list[tuple[int, int]]) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), texts[i].alias("x"), texts[j].alias("y")) for i, j in pairs])
        return df.select(F.explode(cells).alias("c")).groupBy("c.i", "c.j", "c.x", "c.y").agg(F.count(F.lit(1)).cast("double").alias("k"))

    if not columns:
        return df.sparkSession.createDataFrame([], "target string, candidate string, mi double")
    counted = counts([(i, i) for i in range(len(columns))])
    repeated = sorted(r["i"] for r in counted.groupBy("i").agg(F.max("k").alias("k")).where("k >= 2").collect())  # columns
    pairs = [(i, j) for i in repeated for j in repeated if i < j]
    if pairs:
        counted = counted.unionByName(counts(pairs).where("k >= 2"))
    by_x = counted.groupBy(F.col("i").alias("xi"), F.col("j").alias("xj"), F.col("x").alias("xx")).agg(F.sum("k").alias("kx"))
    by_y = counted.groupBy(F.col("i").alias("yi"), F.col("j").alias("yj"), F.col("y").alias("yy")).agg(F.sum("k").alias("ky"))
    total = counted.groupBy("i", "j").agg(F.sum("k").alias("t"))
    joined = counted.join(by_x, (F.col("i") == F.col("xi")) & (F.col("j") == F.col("xj")) & F.col("x").eqNullSafe(F.col("xx")))
    joined = joined.join(by_y, (F.col("i") == F.col("yi")) & (F.col("j") == F.col("yj")) & F.col("y").eqNullSafe(F.col("yy")))
    joined = joined.select("i", "j", "k", "kx", "ky").join(F.broadcast(total), ["i", "j"])  # one row a pair of columns
    term = F.col("k") / F.col("t") * F.log(F.col("t") * F.col("k") / (F.col("kx") * F.col("ky")))
    found = joined.groupBy("i", "j").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mi"))
    names = F.array(*[F.lit(c) for c in columns])
    both = found.select("i", "j", "mi").unionByName(found.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "mi"))
    return both.select(F.element_at(names, F.col("i") + 1).alias("target"), F.element_at(names, F.col("j") + 1).alias("candidate"), "mi")


def determinant_candidates(df: DataFrame, columns: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """target, candidate, mi, ratio (mi over the target's largest, itself
    included) of the candidates at or over the threshold."""
    scored = mutual_information(df, columns).withColumn("most", F.max("mi").over(Window.partitionBy("target")))
    ratio = F.when(F.col("most") > 0, F.col("mi") / F.col("most")).otherwise(0.0)
    return scored.withColumn("ratio", ratio).where((F.col("ratio") >= threshold) & (F.col("target") != F.col("candidate"))).select("target", "candidate", "mi", "ratio")


def valid_names(dependency: Dependency | None, columns: Sequence[str]) -> bool:
    return bool(
        dependency
        and dependency.determinant in columns
        and dependency.dependent in columns
        and dependency.determinant.strip() not in ("", "None")
        and dependency.dependent.strip() not in ("", "None")
    )


def gate_rows(df: DataFrame, labels: DataFrame, dependency: Dependency, masks: str = "m__") -> DataFrame:
    """labels: _rid, clean, is_error of the dependent's labelled rows. For each
    the predicted value, the mode of its group without the row itself where its
    label says it is clean, its own value where there is none, and whether that
    is the clean value. Rows of df carry _rid."""
    pool = df.where(~_marked(df, masks, dependency.determinant) & ~_marked(df, masks, dependency.dependent))
    det, dep = col(dependency.determinant).cast("string"), col(dependency.dependent).cast("string")
    counts = pool.groupBy(det.alias("det"), dep.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    own = df.select(RID, det.alias("det"), dep.alias("own"), (~_marked(df, masks, dependency.determinant) & ~_marked(df, masks, dependency.dependent)).alias("in_pool"))
    asked = own.join(labels.select(RID, "clean", "is_error"), RID)
    ranked = asked.join(counts, "det", "left_outer").withColumn(
        "n", F.col("n") - F.when(~F.col("is_error") & F.col("in_pool") & (F.col("value") == F.col("own")), 1).otherwise(0)
    )
    best = F.min(F.when(F.col("n") > 0, F.struct((-F.col("n")).alias("n"), F.col("value").alias("value"))))
    found = ranked.groupBy(RID, "own", "clean", "is_error").agg(best.alias("best"))
    predicted = F.coalesce("best.value", "own")
    return found.select(RID, "own", "clean", "is_error", predicted.alias("predicted"), predicted.eqNullSafe(F.col("clean")).alias("passes"))


def gate(df: DataFrame, labels: DataFrame, dependency: Dependency, masks: str = "m__") -> bool:
    return bool(gate_rows(df, labels, dependency, masks).agg(F.coalesce(F.bool_and("passes"), F.lit(True))).first()[0])
