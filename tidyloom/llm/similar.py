"""Near-duplicates by Jaccard similarity of word shingles, complete and exact.

Two texts are linked if their sets of shingles of ``width`` words (see
``simhash.hashes``) have a Jaccard similarity of ``similarity`` or more;
components of linked texts come out whole. No link is missed:

SimHash comes first: fingerprints of the same shingles go through the index of
deletion variants (``simhash.candidates``), and what it links at three bits is
verified on the full sets. Similar texts can differ in more bits than any index
over 64 has keys for, so the rest come by a prefix filter, and pairs that
SimHash has connected are passed over there.

Shingles are ordered, those that a sample finds common last. Of two similar sets
each shares one of its first size - ceil(similarity * size) + 1 with the other's
(prefix filter), whatever the order, so an equality on these brings all pairs
together. Pairs of a shared shingle must be near in size and in a sketch, the
parities of 1,024 buckets (of long texts 8,192 too): two sets differ in at least as many shingles as their
sketches in bits. A shingle that more than ``crowd`` texts have in front gives
pairs with its first text only; its other texts are compared by sketch, block by
block, once these are verified, and only those that aren't connected yet.
Pairs are verified one by one on the full sets. No task holds a group: pairs,
blocks and texts go out by key, so a group of any size takes no more memory.

Texts without words (or null) are equal to each other. Texts are compared once,
however many rows hold them; a component's id is the smallest doc_id in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyloom.llm import simhash
from tidyloom.llm._shared import discard, lean, release, stash
from tidyloom.llm.simhash import BROADCAST_ROWS, components, hashes, keep_first

SKETCH_BITS, WIDE_BITS = 1_024, 8_192
LONG = 600  # shingles from which the short sketch says little
BLOCK = 2_000  # texts of a crowded shingle that a task compares with as many others
PARTNERS = 4  # a text in a block, at first
SETS_KEPT = 64  # by a task that verifies pairs


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Ascending, signed as Spark's long."""
    return set_of(hashes(text, width) if isinstance(text, str) else ())


def set_of(found: np.ndarray) -> np.ndarray:
    return np.unique(found.view(np.int64)) if len(found) else np.zeros(1, np.int64)


def sketch(shingles: np.ndarray, n_bits: int) -> list[int]:
    bits = np.bincount((shingles.view(np.uint64) % np.uint64(n_bits)).astype(np.int64), minlength=n_bits) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def front(size: int, similarity: float) -> int:
    return size - math.ceil(round(similarity * size, 9)) + 1


def common_shingles(texts: DataFrame, width: int, sampled: int = 40_000, kept: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample holds twice or more, ascending, and their counts.
    They only steer the order, and with it the cost, never the result."""
    share = min(1.0, sampled / max(texts.count(), 1))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch["text"].to_pylist()]
            values, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_pydict({"shingle": pa.array(values), "n": pa.array(counts)})

    sample = texts.where(F.pmod(F.xxhash64("text", F.lit("common")), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    counted = lean(sample).mapInArrow(rows, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1")
    found = counted.orderBy(F.desc("n"), "shingle").limit(kept).toArrow().sort_by("shingle")
    return found["shingle"].to_numpy().astype(np.int64), found["n"].to_numpy().astype(np.int64)


def described(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """doc_id, node (the text), its fingerprint, size, sketch, wide (of long texts) and the front of the ordered set."""
    shared = texts.sparkSession.sparkContext.broadcast(common_shingles(texts, width))
    own = {"fp": pa.int64(), "size": pa.int32(), "sketch": pa.list_(pa.int64()), "wide": pa.list_(pa.int64()), "front": pa.list_(pa.int64())}

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        common, counts = shared.value
        for batch in batches:
            out = []
            for text in batch["text"].to_pylist():
                found = hashes(text, width) if isinstance(text, str) else ()
                s = set_of(found)
                ranks = np.zeros(len(s), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    ranks = np.where(common[at] == s, counts[at], 0)
                out.append((simhash.majority(found), len(s), sketch(s, SKETCH_BITS), sketch(s, WIDE_BITS) if len(s) > LONG else None, s[np.lexsort((s, ranks))[: front(len(s), similarity)]]))
            columns = {c: pa.array([r[i] for r in out], k) for i, (c, k) in enumerate(own.items())}
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "node": batch["node"]} | columns)

    kind = dict(texts.dtypes)["doc_id"]
    return lean(texts).mapInArrow(rows, f"doc_id {kind}, node long, fp long, size int, sketch array<long>, wide array<long>, front array<long>")


def met(entries: DataFrame, similarity: float, crowd: int) -> DataFrame:
    """entries: shingle, node, size. Pairs a < b that a shingle brings together;
    of a crowded one (tie is true, key is the shingle) each text b with the first, a."""

    def pairs(key: np.ndarray, node: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((node, key))
        key, node, size = key[order], node[order], size[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        key, node, size = key[new], node[new], size[new]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        lengths = np.diff(np.r_[starts, len(key)])
        first, many = np.repeat(node[starts], lengths), np.repeat(lengths > crowd, lengths)
        yield batch_of(first[many], node[many], True, key[many])
        few = ~many & np.repeat(lengths > 1, lengths)
        key, node, size = key[few], node[few], size[few]
        for step in range(1, crowd):
            same = key[step:] == key[:-step]
            if not same.any():
                break
            small, large = np.minimum(size[step:], size[:-step]), np.maximum(size[step:], size[:-step])
            near = same & (small >= similarity * large - 1e-6)
            yield batch_of(node[:-step][near], node[step:][near], False, np.zeros(int(near.sum()), np.int64))

    def batch_of(a: np.ndarray, b: np.ndarray, tie: bool, key: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "tie": pa.array(np.full(len(a), tie)), "key": pa.array(key, pa.int64())})

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # rows of the shingle that goes on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            now = tuple(batch[c].to_numpy() for c in ("shingle", "node", "size"))
            cut = int(np.searchsorted(now[0], now[0][-1]))
            if cut or held and held[-1][0][-1] != now[0][-1]:
                held.append(tuple(x[:cut] for x in now))
                yield from pairs(*(np.concatenate(x) for x in zip(*held)))
                held = []
            held.append(tuple(x[cut:] for x in now))
        if held:
            yield from pairs(*(np.concatenate(x) for x in zip(*held)))

    return entries.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(rows, "a long, b long, tie boolean, key long").distinct()


def close_sketches(found: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sketches allow the similarity."""

    def close(pairs: DataFrame, column: str) -> DataFrame:
        one, two = (texts.where(F.col(column).isNotNull()).select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col(column).alias(f"bits_{x}")) for x in "ab")
        differing: Column = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        most = (F.col("size_a") + F.col("size_b")) * ((1 - similarity) / (1 + similarity)) + 1e-6
        return pairs.join(one, "a").join(two, "b").where(differing <= most).select("a", "b", F.least("size_a", "size_b").alias("least"))

    near = stash(close(found, "sketch"), "near")
    return near.where(F.col("least") <= LONG).select("a", "b").unionByName(close(near.where(F.col("least") > LONG).select("a", "b"), "wide").select("a", "b"))


def fingerprint_pairs(rows: DataFrame) -> DataFrame:
    """a < b: a spanning forest of the texts whose fingerprints differ in three
    bits or fewer."""
    texts = stash(rows.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    linked = simhash.verified_links(simhash.candidates(texts.select("fp")), 3).distinct()
    one, two = (texts.select(F.col("fp").alias(x), F.col("first").alias(f"node_{x}")) for x in "ab")
    between = linked.join(one, "a").join(two, "b").select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    equal = rows.join(texts, "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return between.unionByName(equal).where("a < b").distinct()


def block_pairs(crowded: DataFrame, roots: DataFrame, own: DataFrame, similarity: float, partners: int) -> DataFrame:
    """crowded: key, node. Pairs a < b of texts that a key brings together, that
    aren't connected and whose sketches are near; each text in a block meets its
    first ``partners`` at most, and a row without a and b says that it had more.
    Keys with the same texts count once, those whose texts are connected not at all."""
    placed = crowded.join(roots.withColumnRenamed("node", "id"), F.col("node") == F.col("id"), "left_outer").select("key", "node", F.coalesce("root", "node").alias("root"))
    keys = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("least"), F.max("root").alias("most"), *[F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"digest_{i}") for i in range(2)])
    keys = keys.where("least < most").groupBy("n", "digest_0", "digest_1").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    dealt = placed.join(keys, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.join(own.select("node", "size", "sketch"), "node").select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "size", "sketch")

    def pairs(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        node, root, size, side = (group[c].to_numpy() for c in ("node", "root", "size", "own"))
        bits = group["sketch"].combine_chunks().flatten().to_numpy().reshape(len(node), -1).view(np.uint64)
        across, share, a, b, more = key[1].as_py() != key[2].as_py(), (1 - similarity) / (1 + similarity), [], [], False
        for x in range(1, len(node)):
            meets = np.flatnonzero((root[:x] != root[x]) & (np.minimum(size[:x], size[x]) >= similarity * np.maximum(size[:x], size[x]) - 1e-6) & ((side[:x] != side[x]) | (not across)))
            differing = np.bitwise_count(bits[meets] ^ bits[x]).sum(1, dtype=np.int64)
            meets = meets[differing <= (size[meets].astype(np.int64) + size[x]) * share + 1e-6]
            more |= len(meets) > partners
            a += node[meets[:partners]].tolist()
            b += [int(node[x])] * min(len(meets), partners)
        return pa.table({"a": pa.array([*a, *[None] * more], pa.int64()), "b": pa.array([*b, *[None] * more], pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(pairs, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of the pairs a, b that are similar. texts: node, text, each once."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def shingles(node: int, batch: pa.RecordBatch, column: str, i: int) -> np.ndarray:
            if node not in held:
                if len(held) >= SETS_KEPT:
                    held.clear()
                held[node] = shingle_set(batch[column][i].as_py(), width)
            return held[node]

        for batch in batches:
            a, b = batch["a"].to_pylist(), batch["b"].to_pylist()
            fit = []
            for i in range(len(a)):
                one, two = shingles(a[i], batch, "text_a", i), shingles(b[i], batch, "text_b", i)
                both = len(np.intersect1d(one, two, assume_unique=True))
                fit.append(both >= similarity * (len(one) + len(two) - both) - 1e-9)
            yield pa.RecordBatch.from_pydict({c: batch[c].filter(pa.array(fit, pa.bool_())) for c in "ab"})

    one, two = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return lean(pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")).mapInArrow(rows, "a long, b long")


def similar_documents(docs: DataFrame, width: int = 5, similarity: float = 0.8, crowd: int = 50) -> DataFrame:
    """doc_id, component_id for every row."""
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("node"))
    rows = stash(described(texts, width, similarity), "shingled")
    own = rows.select("node", "size", "sketch", "wide").dropDuplicates(["node"])
    hashed = stash(fingerprint_pairs(rows), "hashed")
    found = stash(met(rows.select("node", "size", F.explode("front").alias("shingle")), similarity, crowd), "met")
    near = stash(close_sketches(found.where("a < b").select("a", "b").distinct(), own, similarity), "close")
    crowded = found.where("tie").select("key", F.col("b").alias("node"))
    pairs = hashed.unionByName(near)
    asked = stash(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(crowded.select("node")).distinct(), "asked")
    few = asked.count() <= BROADCAST_ROWS
    whole = texts.join(F.broadcast(asked) if few else asked, F.col("node") == F.col("id")).select("node", "text")
    whole = stash(whole.dropDuplicates(["node"]), "compared")

    links = stash(verified(hashed, whole, width, similarity), "similar")
    roots = components(links)

    def settle(pairs: DataFrame) -> None:
        """Verify the pairs and take in what is similar."""
        nonlocal links, roots
        new = stash(verified(pairs, whole, width, similarity), "similar")
        if not new.isEmpty():
            links, before = links.unionByName(new), roots
            roots = components(links)
            discard(before)

    one, two = (roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    apart = near.join(one, "a", "left_outer").join(two, "b", "left_outer").where("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b")
    settle(apart)
    partners = PARTNERS
    while not crowded.isEmpty():
        left = stash(block_pairs(crowded, roots, own, similarity, partners), "left")
        settle(close_sketches(left.where("a is not null"), own, similarity))
        if left.where("a is null").isEmpty():
            break
        partners *= 16

    distinct = rows.groupBy("node").agg(F.min("doc_id").alias("first"))
    linked = distinct.join(roots.withColumnRenamed("node", "id"), F.col("node") == F.col("id"), "left_outer").select("node", "first", F.coalesce("root", "node").alias("root"))
    ids = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(ids, "root").select("node", "component_id")
    return rows.join(named, "node").select("doc_id", "component_id")


def drop_similar(docs: DataFrame, **options) -> DataFrame:
    """One document of each component stays, as in ``keep_first``."""
    return keep_first(docs, similar_documents(docs, **options))
