"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints have 64 bits and link at up to three differing bits. Cut into two
halves, two linked fingerprints have a half in which they differ by one bit at
most; so they agree on one of that half's 32 variants with a bit deleted. Every
distinct fingerprint is indexed under its 64 variants, an equality on the
variant brings candidates together, and their whole fingerprints are compared.

Within a variant only links that join something new are handed on (a spanning
forest found with a local union-find), never all pairs. Halves that very many
fingerprints share get longer keys: the variants they touch are divided by the
bytes of the other half, of which two linked fingerprints share one at least.
Components come from alternating large-star and small-star steps, each written
to the shared folder; links, labels and fingerprints never reach the driver.

Texts: A-Z lower-cased, words are runs of other than ASCII white space,
shingles of ``width`` words with repeats; a shorter text is one shingle, a text
without words (or null) has fingerprint zero and is linked like any other.
Repeated rows and equal doc_ids each get their row; a component's id is the
smallest doc_id in it. Only doc_id and text are read, ``drop_near_duplicates``
carries other columns along.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidyloom.llm._shared import discard, lean, release, stash, whole_rows

SEED = 42
SPACES = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)
BROADCAST_ROWS = 500_000


LONG_BYTES = 1 << 18


def hashes(text: str, width: int = 3) -> np.ndarray:
    """The shingles' hashes in order. Words of long texts are taken a part at a
    time, so that they don't all become objects at once."""
    data = text.encode("utf-8", "surrogatepass").lower()  # bytes.lower and .split know ASCII alone
    if len(data) <= LONG_BYTES:
        return _hashes(data.split(), width)
    edges = np.diff(np.isin(np.frombuffer(data, np.uint8), SPACES, invert=True).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    step = 20_000
    found = [np.zeros(0, np.uint64)]
    for k in range(0, max(1, len(starts) - width + 1) if len(starts) else 0, step):  # a shingle belongs to the part it starts in
        found.append(_hashes(data[starts[k] : ends[min(k + step + width - 1, len(ends)) - 1]].split(), width))
    return np.concatenate(found)


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :])], np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """Signed, as Spark's long."""
    return majority(hashes(text, width) if isinstance(text, str) else ())


def majority(h: np.ndarray) -> int:
    """The fingerprint of shingles' hashes."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "fp": pa.array([fingerprint(t, width) for t in batch["text"].to_pylist()], pa.int64())})

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return lean(docs).select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, fp long")


def low(fp: Column) -> Column:
    return fp.bitwiseAND(F.lit(0xFFFFFFFF))


def high(fp: Column) -> Column:
    return F.shiftrightunsigned(fp, 32)


def variants(half: Column, side: int) -> Column:
    """The half without each of its bits in turn; a key holds the side, the
    bit's place and the bits that stay."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(31)),
        lambda place: F.struct(
            (F.lit(side * 32) + place).cast("byte").alias("place"),
            half.bitwiseAND(F.lit(0xFFFFFFFF).bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))).cast("long").alias("rest"),
        ),
    )


def crowded(distinct: DataFrame, most: int) -> DataFrame:
    """Variants that halves shared by over ``most`` fingerprints touch."""
    halves = distinct.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), high(F.col("fp")).alias("half")), F.struct(F.lit(1).alias("side"), low(F.col("fp")).alias("half")))).alias("h"))
    hot = halves.groupBy("h.side", "h.half").count().where(F.col("count") > most)
    keys = F.when(F.col("side") == 0, variants(F.col("half"), 0)).otherwise(variants(F.col("half"), 1))
    return hot.select(F.explode(keys).alias("v")).select("v.place", "v.rest").distinct()


def candidates(distinct: DataFrame, most: int = 20_000) -> DataFrame:
    """fp, place, rest, part: linked fingerprints share a (place, rest, part)."""
    keyed = distinct.select("fp", F.explode(F.concat(variants(high(F.col("fp")), 0), variants(low(F.col("fp")), 1))).alias("v")).select("fp", "v.place", "v.rest")
    hot = stash(crowded(distinct, most), "crowded")
    n = hot.count()
    if not n:
        return keyed.withColumn("part", F.lit(-1))
    hot = hot.withColumn("hot", F.lit(True))
    keyed = keyed.join(F.broadcast(hot) if n <= BROADCAST_ROWS else hot, ["place", "rest"], "left_outer")
    other = F.when(F.col("place") < 32, low(F.col("fp"))).otherwise(high(F.col("fp")))
    parts = F.array(*[(F.lit(k * 256) + F.shiftrightunsigned(other, 8 * k).bitwiseAND(F.lit(255))).cast("int") for k in range(4)])
    return keyed.withColumn("part", F.explode(F.when(F.col("hot"), parts).otherwise(F.array(F.lit(-1))))).drop("hot")


class Forest:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True


def links(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints."""
    forest, out, u = Forest(len(fps)), [], fps.view(np.uint64)
    roots = np.arange(len(fps))
    for i in range(len(fps) - 1):
        near = np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= distance)
        for j in (near + i + 1).tolist():
            if forest.join(i, j):
                out.append((int(fps[i]), int(fps[j])))
        if len(out) == len(roots) - 1:
            break
    return out


def verified_links(keyed: DataFrame, distance: int) -> DataFrame:
    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        key = None

        def close() -> list[tuple[int, int]]:
            fps = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
            return links(fps, distance) if len(fps) > 1 else []

        for batch in batches:
            place, rest, part, fp = (batch[c].to_numpy() for c in ("place", "rest", "part", "fp"))
            cuts = np.flatnonzero((place[1:] != place[:-1]) | (rest[1:] != rest[:-1]) | (part[1:] != part[:-1])) + 1
            edges = [0, *cuts.tolist(), len(fp)]
            out: list[tuple[int, int]] = []
            lengths = np.diff(edges)
            last = len(lengths) - 1
            for k in [0, *(np.flatnonzero(lengths[1:last] > 1) + 1).tolist(), *([last] if last > 0 else [])]:
                a, b = edges[k], edges[k + 1]
                now = (place[a], rest[a], part[a])
                if now != key:
                    out += close()
                    held, key = [], now
                held.append(fp[a:b])
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)
        yield pd.DataFrame(close(), columns=["a", "b"], dtype=np.int64)

    keys = ["place", "rest", "part"]
    return keyed.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(rows, "a long, b long")


def components(pairs: DataFrame) -> DataFrame:
    """node, root for every node of the links (a, b); root is the smallest node.
    Large-star and small-star alternate until nothing changes."""
    edges = stash(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    total = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(both.where("u > v").join(least, "u").where("v = m").select("u", "v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = stash(small.select("e.u", "e.v").where("u <> v").distinct(), "stars")
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = new
        if now == total:
            break
        total = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3, crowd: int = 20_000) -> DataFrame:
    """doc_id, fingerprint, component_id for every row."""
    if distance > 3:
        raise ValueError("two halves with one wildcard find up to three differing bits")
    rows = stash(fingerprints(docs, width), "fingerprints")
    distinct = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(verified_links(candidates(distinct.select("fp"), crowd), distance))
    linked = distinct.join(roots, F.col("fp") == F.col("node"), "left_outer").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One document of each component stays, as in ``keep_first``."""
    return keep_first(docs, near_duplicates(docs, **options))


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """found: doc_id, component_id of every row. One document of each component
    stays, the one with the smallest doc_id (of repeated rows with that doc_id,
    the first by text); all columns stay."""
    groups = stash(found, "components")
    ids = groups.groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("first"))
    marked = stash(ids.where("n > 1 or not first"), "marked")
    n = marked.count()
    rows = whole_rows(docs, "doc_id").join(F.broadcast(marked) if n <= BROADCAST_ROWS else marked, F.col("doc_id").eqNullSafe(F.col("id")), "left_outer")
    repeated = rows.where("n > 1 and first").withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("row.text")))
    return rows.where("n is null").select("row.*").unionByName(repeated.where("place = 1").select("row.*"))
