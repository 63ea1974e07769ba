"""Sources and sinks: literal CSV pairs, typed tables as text, results."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidyloom.operators.names import RID, col


class InvalidData(ValueError):
    pass


@dataclass(frozen=True)
class TablePair:
    """Dirty and clean table with the same columns and a row key in both."""

    dirty: DataFrame
    clean: DataFrame
    dataset: str
    columns: tuple[str, ...]
    targets: tuple[str, ...]


def dataset_name(path: str) -> str:
    """The file's stem without a dirty marker before ``_`` or the end."""
    return re.sub(r"_(?:dirty|sujo)(?=_|$)", "", PurePosixPath(path).stem, flags=re.I)


def read_literal_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Every cell as the text that stands in the file; empty stays empty. The row
    key is the row's place. A file whose cells may hold line ends is read by one
    task; ``multi_line=False`` lets very large files be split."""
    raw = spark.read.options(header=True, escape='"', multiLine=multi_line, inferSchema=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, encoding="UTF-8").csv(path)
    return with_row_key(raw.na.fill(""))


def with_row_key(df: DataFrame) -> DataFrame:
    """_rid from 0 in input order: a count per partition, and a join with the
    sums of the counts before (a row a partition)."""
    placed = df.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counted = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    starts = counted.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    local = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(starts), "__part").withColumn(RID, (F.col("__start") + local).cast("long")).drop("__part", "__at", "__start")


def load_pair(spark: SparkSession, dirty: str, clean: str, columns: Sequence[str] | None = None) -> TablePair:
    for path in (dirty, clean):
        file = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file):
            raise InvalidData(f"no such file: {path}")
    return make_pair(read_literal_csv(spark, dirty), read_literal_csv(spark, clean), dataset_name(dirty), columns)


def make_pair(dirty: DataFrame, clean: DataFrame, dataset: str, columns: Sequence[str] | None = None) -> TablePair:
    """None means every column but one called index; an empty list means none."""
    names = [c for c in dirty.columns if c != RID]
    if names != [c for c in clean.columns if c != RID]:
        raise InvalidData("the tables' columns differ")
    if dirty.count() != clean.count():
        raise InvalidData("the tables' lengths differ")
    targets = [c for c in names if c.lower() != "index"] if columns is None else list(columns)
    if missing := [c for c in targets if c not in names]:
        raise InvalidData(f"no such columns: {', '.join(missing)}")
    return TablePair(dirty, clean, dataset, tuple(names), tuple(targets))


def as_text(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """A typed table as literal cells with its key as _rid."""
    return df.select(col(key).cast("long").alias(RID), *[F.coalesce(col(c).cast("string"), F.lit("")).alias(c) for c in columns])


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).option("escape", '"').option("emptyValue", "").csv(path) if kind == "csv" else writer.format(kind).save(path)


def write_csv_file(df: DataFrame, path: str) -> None:
    """One CSV file at that very path, rows by _rid; for tables that are handed to people."""
    spark = df.sparkSession
    folder = f"{path}.parts"
    rows = df.orderBy(RID).drop(RID) if RID in df.columns else df
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(folder)
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in files.listStatus(at) if f.getPath().getName().startswith("part-"))
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files.delete(target, False)
    files.rename(part, target)
    files.delete(at, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small report, through the same file systems that Spark reads."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = file.getFileSystem(spark._jsc.hadoopConfiguration()).create(file, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_json(spark: SparkSession, path: str, value: object) -> None:
    write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=1))


def run_folder(base: str, stamp: str, mode: str) -> str:
    return f"{base.rstrip('/')}/{stamp}__{mode}"
