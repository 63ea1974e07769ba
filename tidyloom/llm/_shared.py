"""Helpers that the operators of this subpackage share: scratch tables in the
cluster's shared folder, unambiguous column handling, bounded caches."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Unset on a local master it falls back to a temp folder; unset on a cluster
    it is an error, because a machine-local folder would lose data there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "tidyloom-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tidyloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex[:12]}-{label}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write df to a scratch table and read it back: cuts lineage so that a lost
    executor costs one stage, and gives later joins real sizes."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the scratch files behind stashed frames that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/tidyloom/" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(df: DataFrame, batch_bytes: int = 4 << 20) -> DataFrame:
    """df, to be handed to Python in Arrow batches of at most that size: whole
    texts are held several times over on their way (a session setting; a smaller
    one is left alone)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(name).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= batch_bytes:
        df.sparkSession.conf.set(name, f"{batch_bytes}b")
    return df


def whole_rows(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """Each row as one struct, ``row``, beside the columns an operator works on,
    so that whatever else the rows hold can't clash with the operator's names.
    ``select("row.*")`` brings them back."""
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
    return docs.select(row.alias("row"), *columns)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; pure-ASCII texts take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


_resident: dict = {}
_kept: dict = {}


def kept(key: tuple, make):
    """What ``make()`` gives, kept beside what is resident until ``release``."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def resident(key: tuple, make):
    """What ``make()`` gives, kept by the Python worker for its next tasks: one
    thing at a time, so that a worker that outlives an operator doesn't hold the
    tables of the last one beside its own."""
    if _resident.get("key") != key:
        release()
        _resident.update(key=key, value=make())
    return _resident["value"]


def release() -> None:
    """Forget what the worker keeps and hand its memory back to the system."""
    _resident.clear()
    _kept.clear()
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class TwoGenerationCache(dict):
    """A dict whose misses call ``make(key)``, holding at most 2 * limit entries:
    when the young generation is full it becomes the old one, and entries that
    are asked for again move back. Results never depend on what is cached."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
