"""Best-fit packing with certified bin counts.

Texts become token ids (a public word-piece vocabulary, one end id each) and are
cut into pieces of at most one sequence. The pieces are dealt evenly over
partitions of bounded size; each partition packs its own by best-fit decreasing
and bounds its bin count from below with dual feasible functions. Where the
count meets the bound it is certified. Partitions with a gap give back all bins
that are not full, every partition gives back its emptiest bin, and what was
given back is dealt anew over fewer partitions and packed again, until one
partition is left or a round saves less than ``least_gain`` of the bins that were
given back. A round that needs as many bins as before is not taken.

Only lengths move between rounds, never texts; the rows shrink from round to
round. Null texts count as empty and hold the end id alone. Repeated rows are
documents of their own, also with the same doc_id. Ties go by doc_id and piece.
Only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.llm._shared import TwoGenerationCache, discard, lean, resident, stash

END_ID = 1
MARKS = ".,;:!?*#%&$"
WORDS_KEPT = 900_000  # parts that a worker looks up, about 400 bytes each; fewer cost time, never results


class WordIds:
    """Ids of whole texts by a ``tokenizers`` file. The vocabulary's words never
    span a space or a line end, so a text's ids are those of its parts between
    them, and the parts, which come again and again, are looked up."""

    def __init__(self, path: str, limit: int = WORDS_KEPT):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts = TwoGenerationCache(self._encode, limit)

    def _encode(self, part: str) -> bytes:
        """Upper case and marks at the end don't change how the rest is split
        (marks are never in a word's token), so they don't need an own entry."""
        if "<|" not in part and part and max(part) < "\u0100":
            stem = part.rstrip(MARKS)
            plain = stem.lower()
            if plain and plain != part:
                if plain[-1].isalpha() or stem == part:
                    return self.parts[plain] + (self.parts[part[len(stem) :]] if stem != part else b"")
        ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, text.replace("\n", " ").split(" ")))


def word_ids(path: str, words_kept: int = WORDS_KEPT) -> WordIds:
    return resident(("words", path, words_kept), lambda: WordIds(path, words_kept))


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, words_kept: int = WORDS_KEPT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; a narrow pass."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, step = word_ids(tokenizer_path, words_kept), np.array([END_ID], dtype="<u4").tobytes(), 4 * capacity
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                ids = encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            columns = {"piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].take(pa.array(row, pa.int32())), **columns})

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return lean(docs).select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def piece_ids(docs: DataFrame, tokenizer_path: str, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, ids_crc32, ids of every piece."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_ids(tokenizer_path), np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            out = []
            for i, text in enumerate(batch["text"].to_pylist()):
                ids = encode(text or "") + end
                parts = [ids[at : at + 4 * capacity] for at in range(0, len(ids), 4 * capacity)]
                out += [(i, k, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int32)) for k, part in enumerate(parts)]
            kinds = {"piece": pa.int32(), "ids_crc32": pa.int64(), "ids": pa.list_(pa.int32())}
            columns = {c: pa.array([r[j] for r in out], k) for j, (c, k) in enumerate(kinds.items(), 1)}
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].take(pa.array([r[0] for r in out], pa.int32()))} | columns)

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return lean(docs).select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, piece int, ids_crc32 long, ids array<int>")


def sequences(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, per_partition: int = 40_000) -> DataFrame:
    """sequence_id and its ids, at most ``capacity`` of them: what a trainer reads."""
    placed = stash(pack_documents(docs, tokenizer_path, capacity, per_partition), "placed")
    ids = piece_ids(docs, tokenizer_path, capacity)
    ids = ids.select(F.col("doc_id").alias("id"), F.col("piece").alias("part"), F.col("ids_crc32").alias("crc"), "ids").dropDuplicates(["id", "part", "crc"])  # repeated rows are the same
    joined = placed.join(ids, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("piece") == F.col("part")) & (F.col("ids_crc32") == F.col("crc")))
    gathered = joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("s"))  # bounded by capacity
    return gathered.select("sequence_id", F.flatten(F.transform("s", lambda x: x["ids"])).alias("ids"))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, and the number of bins. Open bins are kept
    by free space; the set bits of ``free`` say which spaces there are, so the
    tightest bin that still fits is one shift away."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = count = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        if fitting := free >> size:
            space = size + (fitting & -fitting).bit_length() - 1
            b = stacks[space].pop()
            if not stacks[space]:
                free ^= 1 << space
        else:
            b, space, count = count, capacity, count + 1
        bins[i], offsets[i] = b, capacity - space
        if left := space - size:
            if not stacks[left]:
                free |= 1 << left
            stacks[left].append(b)
    return bins, offsets, count


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest bin count that dual feasible functions prove: the plain sum,
    thresholds that drop small pieces and round large ones up to a whole bin, and
    the rounding family x -> floor((k + 1) x / C) C / k."""
    if not len(lengths):
        return 0
    number = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((number * size).sum()) // capacity)
    below = np.cumsum(number * size)
    above = np.cumsum(number[::-1])[::-1]
    for t in range(1, capacity // 2 + 1):  # pieces over C - t fill a bin, those under t count nothing
        total = int(below[capacity - t] - below[t - 1]) + capacity * int(above[capacity - t + 1])
        best = max(best, -(-total // capacity))
    for k in range(1, 33):  # scaled by k * C to stay in integers
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, k * size, scaled // capacity * capacity)
        best = max(best, -(-int((number * value).sum()) // (k * capacity)))
    return best


_PACKED = "doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long, certified boolean, settled boolean"


def _pack_group(round_no: int, capacity: int):
    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = rows["length"].to_numpy().astype(np.int64)
        bins, offsets, count = best_fit_decreasing(lengths, capacity)
        certified = count == lower_bound(lengths, capacity)
        fill = np.bincount(bins, weights=lengths, minlength=count).astype(np.int64)
        settled = np.ones(count, bool) if certified else fill == capacity
        if count and fill.min() < capacity:
            settled[int(fill.argmin())] = False
        added = {
            "sequence_id": (int(round_no) << 56) + (key[0].as_py() << 32) + bins,
            "offset": offsets,
            "fill": fill[bins],
            "certified": np.full(len(bins), certified),
            "settled": settled[bins],
        }
        return pa.table({c: rows[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")} | {c: pa.array(v) for c, v in added.items()})

    return pack


def pack(pieces: DataFrame, capacity: int = 4096, per_partition: int = 40_000, least_gain: float = 0.0001) -> DataFrame:
    """Give each piece a sequence_id and an offset in it."""
    kind = dict(pieces.dtypes)["doc_id"]
    open_rows, taken, open_bins, spent = stash(pieces, "pieces"), [], None, []
    for round_no in count():
        n = open_rows.count()
        if not n:
            break
        parts = max(1, -(-n // per_partition))
        packed = stash(
            open_rows.select("doc_id", "piece", "start", "length", "ids_crc32", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).alias("part"))
            .repartition(max(2, parts), "part")
            .groupBy("part")
            .applyInArrow(_pack_group(round_no, capacity), _PACKED.format(kind=kind)),
            f"packed{round_no}",
        )
        bins = packed.agg(F.count_distinct("sequence_id")).first()[0] if open_bins is not None else None
        if open_bins is not None and bins >= open_bins:
            break  # nothing gained: what the documents had before stays
        if taken:  # the round's documents leave the bins they were given back from
            taken[-1] = taken[-1].where("settled")
        taken.append(packed)
        spent.append(open_rows)
        if parts == 1 or open_bins is not None and open_bins - bins < least_gain * open_bins:
            break
        open_rows = packed.where(~F.col("settled"))
        open_bins = open_rows.agg(F.count_distinct("sequence_id")).first()[0]
    discard(*spent[:1])
    if not taken:
        taken = [pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "certified": F.lit(True)}).limit(0)]
    out = None
    for t in taken:
        t = t.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")
        out = t if out is None else out.unionByName(t)
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, per_partition: int = 40_000, words_kept: int = WORDS_KEPT) -> DataFrame:
    return pack(token_pieces(docs, tokenizer_path, capacity, words_kept), capacity, per_partition)
