"""Exact deduplication as a stateful stream, in DataFrame operations only.

The stream keeps one entry a digest in a disk-backed state store (RocksDB),
without expiry: the digest, the stable identifier of the row that stays (the
largest doc_id so far), the locator of its content (a hash of the file's path and
the row's place in the file), and how many rows came. The input is any number of
micro-batches; the entries only grow, so their final values are the maxima of
what the batches wrote. Afterwards every row whose digest was hit more than once
is compared in full bytes with the content that the locator names; a digest under
which different texts met is grouped by the texts themselves. The locator also
tells repeated rows apart: the row that it names is the one that stays. Rows
that don't come from files are written first, so that there is a place to name.

Texts are equal when they are identical after lower-casing A-Z. Null counts as
empty. Rows with equal text and equal doc_id are ties: one of them stays, as
they are interchangeable. A null doc_id is smaller than any other. An empty
table gives an empty result. Only doc_id and text are read; ``drop_duplicates``
carries all other columns along, whatever their names.

Skew: a digest of a third of all rows is one state entry, fed by map-side
partial aggregates; the joins back to the rows are plain equi-joins with one row
a key on the small side, whose hot partitions the adaptive planner splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyloom.llm._shared import ascii_lower, scratch_path, stash, whole_rows

BROADCAST_ROWS = 200_000  # digests are 32 bytes: under 16 MB
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",  # all stores of an executor share
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: don't reserve disk
}


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast df if its counted rows allow it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def located(rows: DataFrame) -> DataFrame:
    """rows with ``at``, struct<file long, place long>: where each one lies."""
    if "_metadata" not in rows.columns:
        try:
            return rows.withColumn("at", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")))
        except AnalysisException:  # these rows don't come straight from files
            pass
    stored = stash(rows, "rows")
    if not stored.inputFiles():
        return rows.limit(0).withColumn("at", F.struct(F.lit(0).cast("long").alias("file"), F.lit(0).cast("long").alias("place")))
    return stored.withColumn("at", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")))


def streamed_state(arrivals: DataFrame, files_per_batch: int = 10_000) -> DataFrame:
    """arrivals: a stashed frame of digest, doc_id, at. Run it through the keyed
    state and return digest, keep (doc_id, at) and n."""
    spark = arrivals.sparkSession
    folder = arrivals.inputFiles()[0].rsplit("/", 1)[0] if arrivals.inputFiles() else None
    out, position = scratch_path(spark, "state"), scratch_path(spark, "stream")
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    entry = "digest binary, keep struct<doc_id:{}, at:struct<file:bigint, place:bigint>>, n long".format(dict(arrivals.dtypes)["doc_id"])
    if folder is None:
        return spark.createDataFrame([], entry)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that runs again replaces itself

    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        stream = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
        state = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "at")).alias("keep"), F.count(F.lit(1)).alias("n"))
        query = state.writeStream.outputMode("update").option("checkpointLocation", position).trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    changes = spark.read.schema(f"{entry}, batch int").parquet(f"{out}/batch=*")
    return changes.groupBy("digest").agg(F.max("keep").alias("keep"), F.max("n").alias("n"))


def duplicate_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_batch: int = 10_000) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    ``digest`` keys the state; the result does not depend on it, as full bytes
    are compared."""
    return _groups(located(docs.select("doc_id", "text")), digest, files_per_batch).drop("at")


def _groups(rows: DataFrame, digest: Callable[[Column], Column], files_per_batch: int) -> DataFrame:
    """rows: doc_id, text, at."""
    texts = rows.select("doc_id", "at", normalised(F.col("text")).alias("text"))
    arrivals = stash(texts.select(digest(F.col("text")).alias("digest"), "doc_id", "at", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")), "digests")
    state = stash(streamed_state(arrivals, files_per_batch), "final")
    hits = state.where("n > 1").select("digest", "keep")
    hit_rows = texts.withColumn("digest", digest(F.col("text"))).join(small(hits, n_hits := hits.count()), "digest")
    stays = stash(hit_rows.where(F.col("at") == F.col("keep.at")).select("digest", F.col("text").alias("staying")), "stays")  # written, so that the join below can split a digest that very many rows share
    differing = stash(hit_rows.join(stays, "digest").where(F.col("text") != F.col("staying")).select("digest"), "differing").distinct()
    clashes = differing.count() if n_hits else 0

    result = arrivals.join(state.select("digest", "keep", F.col("n").alias("group_size")), "digest")
    if clashes:
        met = hit_rows.drop("keep").join(small(differing, clashes), "digest", "left_semi")
        groups = met.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "at")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        regrouped = met.join(groups, ["digest", "text"]).withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256)).drop("text")
        result = result.join(small(differing, clashes), "digest", "left_anti").unionByName(regrouped)
    return result.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("at") == F.col("keep.at")).alias("kept"), "text_sha256", "at")


def drop_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_batch: int = 10_000) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    rows = located(whole_rows(docs, "doc_id", "text"))
    dropped = stash(_groups(rows, digest, files_per_batch).where("not kept").select("at"), "dropped")
    return rows.join(small(dropped, dropped.count()), "at", "left_anti").select("row.*")
