"""Suffix-array deduplication: remove every byte under a long repeated string.

A string of ``length`` bytes that starts at two places of the corpus (the same
document included) is repeated; all bytes under repeated strings go. The search
is exact and has three parts.

1. Routing. The smallest hash of the short strings inside a window of ``length``
   bytes depends on the window's bytes alone, so equal windows meet under it.
   Neighbouring windows with the same smallest hash form a run; the runs cover
   every window of a document once. Runs whose hash occurs at one place in the
   corpus are done. Of runs that two hashes of 64 bits (of the whole run and of
   its smallest short string) take for copies, the first and the last go on and
   speak for the others: of a passage with thousands of copies two are indexed.
2. Run-length index. The runs that share a hash go to index batches of bounded
   size. A batch's Burrows-Wheeler transform is run-compressed and keeps the
   suffix positions at its run ends only; texts of equal bytes lengthen its runs
   and are sorted once. Matching statistics (the longest match of each position
   with any other) are computed at those samples and streamed over the text:
   between samples a match shrinks by one byte a step, so a running maximum of
   position plus match length gives all others. What matches there, byte by byte,
   goes: equal digests of runs alone remove nothing.
3. Crowded hashes, whose distinct runs exceed a batch (the edge of a passage
   that very many documents share), are resolved by grouping the digests of
   their windows (128 bits): linear in the runs, and no group is gathered anywhere.

Texts are taken as UTF-8, null as empty; matches never cross documents. Repeated
rows count as places of their own, so equal texts of ``length`` bytes or more
vanish. Rows are told apart by doc_id and content; a null doc_id is fine. Only
doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.llm._shared import lean, stash

GRAM = 32
LONGEST_RUN = 4096
U = np.uint64


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on, by doubling."""
    h = (data.astype(U) + U(1)) * U(0x9E3779B97F4A7C15)
    width = 1
    factor = 0xC2B2AE3D27D4EB4F
    while width < GRAM:
        h = h[:-width] * U(factor) + h[width:]
        h ^= h >> U(29)
        factor = factor * 0x165667B19E3779F9 % (1 << 64) | 1
        width *= 2
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(32)
    return h


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` neighbours from each position on, by doubling."""
    step = 1
    while 2 * step <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    if step < width:
        h = np.minimum(h[: len(h) - (width - step)], h[width - step :])
    return h


def runs_of(data: bytes, length: int) -> Iterator[tuple[int, int, int, bool]]:
    """(hash, first window, windows, looped) of the runs of one document. A run is
    looped if its hash comes from several places in it: it may repeat itself."""
    n = len(data) - length + 1
    if n < 1:
        return
    for at in range(0, n, 1 << 20):  # bounded pieces of long documents
        piece = np.frombuffer(data[at : at + (1 << 20) + length - 1], np.uint8)
        grams, width = gram_hashes(piece), length - GRAM + 1
        least = window_minima(grams, width)
        cuts = np.flatnonzero(least[1:] != least[:-1]) + 1
        starts = np.concatenate([[0], cuts])
        sizes = np.diff(np.concatenate([starts, [len(least)]]))
        for value, start, size in zip(least[starts], starts.tolist(), sizes.tolist()):
            for k in range(start, start + size, LONGEST_RUN):
                windows = min(LONGEST_RUN, start + size - k)
                looped = np.count_nonzero(grams[k : k + windows + width - 1] == value) > 1
                yield int(value.view(np.int64)), at + k, windows, bool(looped)


def _bytes(text: object) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def _content(data: bytes) -> int:
    import xxhash

    return int.from_bytes(xxhash.xxh64_digest(data, 7), "big", signed=True)


def document_runs(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, content, hash, start, windows, looped, same; ``same`` is a digest
    of the run's bytes."""

    kinds = {"content": pa.int64(), "hash": pa.int64(), "start": pa.int32(), "windows": pa.int32(), "looped": pa.bool_()}

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            at, same, out = [], [], {c: [] for c in kinds}
            for i, text in enumerate(batch["text"].to_pylist()):
                data = _bytes(text)
                if len(data) < length:
                    continue
                found = list(runs_of(data, length))
                at += [i] * len(found)
                out["content"] += [_content(data)] * len(found)
                for column, values in zip(("hash", "start", "windows", "looped"), zip(*found)):
                    out[column] += values
                same += [digest(data[a : a + n + length - 1]) for _, a, n, _ in found]
                if len(at) > 100_000:
                    yield frame(batch, at, same, out)
                    at, same, out = [], [], {c: [] for c in kinds}
            yield frame(batch, at, same, out)

    def frame(batch: pa.RecordBatch, at: list[int], same: list[int], out: dict[str, list]) -> pa.RecordBatch:
        columns = {c: pa.array(out[c], k) for c, k in kinds.items()} | {"same": pa.array(np.array(same, np.uint64).view(np.int64))}
        return pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].take(pa.array(at, pa.int32()))} | columns)

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return lean(docs).select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, content long, hash long, start int, windows int, looped boolean, same long")


class RunLengthIndex:
    """Run-compressed BWT of the concatenated texts with the suffix positions at
    both ends of each run. The suffix array that it is read off is dropped.

    ``counts`` says how often each text stands in the collection. The suffixes of
    equal texts are neighbours with equal symbols before them, but for the
    separators at their starts, so they only lengthen the runs."""

    def __init__(self, texts: list[bytes], counts: list[int] | None = None):
        self.text, self.bounds = self._joined(texts)
        self.counts = np.ones(len(texts), np.int64) if counts is None else np.array(counts, np.int64)
        order = self._suffix_order()
        bwt = self.text[order - 1]
        heads = np.flatnonzero(np.concatenate([[True], (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)]))  # each separator is a symbol of its own
        self.symbols = bwt[heads]
        self.lengths = np.add.reduceat(np.repeat(self.counts, np.diff(self.bounds))[order], heads)
        self.first = order[heads]  # suffix at each run's head
        self.last = order[np.concatenate([heads[1:] - 1, [len(order) - 1]])]  # and at its end

    @staticmethod
    def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes plus one (UTF-8 has no 0xFF) and a zero after every text."""
        bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8) + np.uint8(1)
        joined[bounds[1:] - 1] = 0
        return joined, bounds

    def _suffix_order(self) -> np.ndarray:
        """Prefix doubling from eight symbols on. A rank is the place of its
        group's first suffix, so only groups that are not single are sorted
        again. Separators differ by text, so every suffix becomes single."""
        n = len(self.text)
        key = np.concatenate([self.text, np.zeros(7, np.uint8)]).astype(U)
        for width in (1, 2, 4):
            key = key[:-width] << U(8 * width) | key[width:]
        ends, left = np.broadcast_arrays(self.bounds[1:, None] - 1, np.arange(8))
        inside = ends - left >= self.bounds[:-1, None]
        tails = (ends - left)[inside]  # the suffixes whose eight symbols hold their separator
        key[tails] &= np.array([0, *(~U(0) << U(8 * (8 - k)) for k in range(1, 8))], U)[left[inside]]
        text_no = np.zeros(n, np.int64)
        text_no[tails] = ends[inside] + 1
        order = np.argsort(key)
        at = np.flatnonzero(text_no[order])
        tails = order[at]
        order[at] = tails[np.lexsort((text_no[tails], key[tails]))]
        key = key[order]
        new = key[1:] != key[:-1]
        new[at[at > 0] - 1] = True
        rank = np.empty(n, np.int64)
        rank[order] = self._heads(new, n)
        width = 8
        open_ = order[self._shared(rank[order])]
        while len(open_):
            second = rank[np.minimum(open_ + width, n - 1)]
            by = np.argsort(rank[open_] * np.int64(n) + second)
            open_, second = open_[by], second[by]
            group = rank[open_]
            new_group = np.concatenate([[True], group[1:] != group[:-1]])
            new = new_group | np.concatenate([[True], second[1:] != second[:-1]])
            at = np.arange(len(open_))
            within = at - np.maximum.accumulate(np.where(new_group, at, 0))
            updated = group + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(new_group, at, 0))
            order[group + within] = open_
            rank[open_] = updated
            open_ = open_[self._shared(updated)]
            width *= 2
        return order

    @staticmethod
    def _heads(new: np.ndarray, n: int) -> np.ndarray:
        at = np.arange(n)
        return np.maximum.accumulate(np.where(np.concatenate([[True], new]), at, 0))

    @staticmethod
    def _shared(rank: np.ndarray) -> np.ndarray:
        same = rank[1:] == rank[:-1]
        return np.concatenate([same, [False]]) | np.concatenate([[False], same])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of suffix pairs; a separator equals nothing."""
        n, out, open_ = len(self.text), np.zeros(len(a), np.int64), np.arange(len(a))
        step, width = 0, 16
        while len(open_):
            at = np.arange(step, step + width)
            left = self.text[np.minimum(a[open_, None] + at, n - 1)]
            right = self.text[np.minimum(b[open_, None] + at, n - 1)]
            stop = (left != right) | (left == 0)
            first = np.where(stop.any(1), stop.argmax(1), width)
            out[open_] += first
            open_ = open_[first == width]
            step, width = step + width, min(64, 2 * width)
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each position the longest match with another position, streamed
        from the samples at run ends."""
        n = len(self.text)
        above, below = self.last[:-1], self.first[1:]  # neighbours in order over a run's edge
        shared = self.common(above, below)
        preceding, following = np.zeros(n, np.int64), np.zeros(n, np.int64)
        preceding[below] = below + shared  # match with the suffix before, at run heads
        following[above] = above + shared  # match with the suffix after, at run ends
        copied = self.counts > 1  # the runs of separators: each start's neighbour is a copy's
        following[self.bounds[:-1][copied]] = self.bounds[1:][copied] - 1
        reach = np.maximum(np.maximum.accumulate(preceding), np.maximum.accumulate(following))
        return np.maximum(reach - np.arange(n), 0)


def repeated_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text whether the window from each position on occurs elsewhere."""
    counts = Counter(texts)
    index = RunLengthIndex(list(counts), list(counts.values()))
    long = index.matching_statistics() >= length
    flags = {t: long[a : max(a, b - length)] for t, a, b in zip(counts, index.bounds[:-1].tolist(), index.bounds[1:].tolist())}
    return [flags[t] for t in texts]


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _index_batch(length: int):
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        out = set()  # copies say the same
        for key_hash, same, flags in zip(rows["hash"], rows["same"], repeated_windows([bytes(x) for x in rows["data"]], length)):
            out.update((key_hash, same, a, b) for a, b in _ranges(flags))
        return pd.DataFrame(sorted(out), columns=["hash", "same", "a", "b"]).astype("int64")

    return one


def with_content(docs: DataFrame) -> DataFrame:
    """doc_id, text and a digest of the text, which tells rows with one doc_id apart."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("content", pa.array([_content(_bytes(t)) for t in batch["text"].to_pylist()], pa.int64()))

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return lean(docs).select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, text string, content long")


def run_bytes(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """hash, same, copy, bytes, data of the wanted runs (doc_id, content, hash, same,
    copy, start, windows, bytes); one row each, as a repeated row gives its runs again."""
    lists = wanted.groupBy(F.col("doc_id").alias("__id"), F.col("content").alias("__content")).agg(F.collect_list(F.struct("hash", "same", "copy", "start", "windows", "bytes")).alias("__runs"))
    joined = with_content(docs).join(lists, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("content") == F.col("__content")))
    cut = joined.select(F.col("text").cast("binary").alias("data"), F.explode("__runs").alias("r"))
    return cut.select("r.hash", "r.same", "r.copy", "r.bytes", F.expr(f"substring(data, r.start + 1, r.windows + {length - 1})").alias("data")).dropDuplicates(["hash", "same", "copy"])


def marks(docs: DataFrame, length: int, batch_bytes: int) -> DataFrame:
    """doc_id, content, and the repeated window ranges [a, b) of each document."""
    runs = stash(document_runs(docs, length), "runs")
    place = F.struct("doc_id", "content", "start", "windows")
    distinct = stash(
        runs.groupBy("hash", "same").agg(F.count(F.lit(1)).alias("n"), F.max("looped").alias("looped"), F.min(place).alias("first"), F.max(place).alias("last")), "distinct"
    )
    size = (F.col("first.windows") + F.lit(length)).cast("long") * F.least("n", F.lit(2))
    hashes = distinct.groupBy("hash").agg(F.sum("n").alias("n"), F.max("looped").alias("any"), F.sum(size).alias("bytes"))
    met = stash(hashes.where("n > 1 or any").select("hash", "bytes"), "met")  # written, so that the join below can split a hash that very many runs share
    one, two = F.struct(F.lit(0).alias("copy"), F.col("first").alias("at")), F.struct(F.lit(1).alias("copy"), F.col("last").alias("at"))
    places = distinct.join(met, "hash").select("hash", "same", "bytes", F.explode(F.when(F.col("n") > 1, F.array(one, two)).otherwise(F.array(one))).alias("p"))
    mixed = stash(places.select("hash", "same", "p.copy", "p.at.*", "bytes"), "mixed")
    total = mixed.agg(F.sum(F.col("windows") + F.lit(length))).first()[0] or 0
    batches = max(1, -(-int(total) // batch_bytes))
    data = stash(run_bytes(docs, mixed, length), "rundata")
    crowded = F.col("bytes") > F.lit(4 * batch_bytes)
    found = (
        data.where(~crowded)
        .withColumn("batch", F.pmod(F.xxhash64("hash"), F.lit(batches)))
        .repartition(max(2, batches), "batch")
        .groupBy("batch")
        .applyInPandas(_index_batch(length), "hash long, same long, a long, b long")
    ).unionByName(_crowded(data.where(crowded), length))
    found = stash(found, "found")
    joined = runs.join(found, ["hash", "same"])
    return joined.select("doc_id", "content", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))


def _crowded(data: DataFrame, length: int) -> DataFrame:
    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key_hash, same, run in zip(batch["hash"], batch["same"], batch["data"]):
                n = len(run) - length + 1
                digests = [hashlib.blake2b(run[i : i + length], digest_size=16).digest() for i in range(n)]
                yield pd.DataFrame({"hash": key_hash, "same": same, "a": np.arange(n), "window": digests})

    windows = stash(data.mapInPandas(rows, "hash long, same long, a long, window binary"), "windows")
    again = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    return windows.join(again, "window").select("hash", "same", "a", (F.col("a") + 1).alias("b")).distinct()  # copies say the same


def cut_repeats(docs: DataFrame, length: int = 400, batch_bytes: int = 1_000_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and
    kept_sha256 of every row."""
    found = marks(docs, length, batch_bytes)
    lists = found.groupBy(F.col("doc_id").alias("__id"), F.col("content").alias("__content")).agg(F.collect_set(F.struct("a", "b")).alias("ranges"))

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    joined = with_content(docs).join(lists, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("content") == F.col("__content")), "left_outer")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, ranges in zip(batch["text"].to_pylist(), batch["ranges"].to_pylist()):
                data = _bytes(text)
                spans: list[list[int]] = []
                for a, b in sorted((r["a"], r["b"] - 1 + length) for r in ranges or ()):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                kept, at = [], 0
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                out.append((len(data), len(data) - len(kept), len(spans), kept, hashlib.sha256(kept).hexdigest()))
            kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary(), "kept_sha256": pa.string()}
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"]} | {c: pa.array([r[i] for r in out], k) for i, (c, k) in enumerate(kinds.items())})

    return joined.select("doc_id", "text", "ranges").mapInArrow(rows, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
