"""Token counts by a finite-state tokenizer compiled from a public BPE vocabulary.

The merge procedure is turned into a deterministic transducer. A sequence of
pieces is what the merges give exactly if every piece, and every pair of
neighbours, is what they give for its own text. So the tokenizer is a
nondeterministic automaton whose configurations are (piece before, part of the
next piece read so far); the subset construction makes it deterministic, and a
transition carries the number of tokens that it adds to the count of the prefix
(it may be negative: a longer piece can swallow several). States are built when
a text first needs them, at most ``state_limit`` at a time.

No piece goes on past a word start (a space after a non-space) or through a
character outside the vocabulary, so there the transducer is back in its start
state. A chunk of text is therefore summarised by a small state map: what to
read before the first such place, tokens between the first and the last, and
the text after the last, which names the state the chunk ends in; a chunk with
no such place is its own map. Maps compose associatively. Texts of over
``long_chars`` are cut into chunk rows that go to many tasks, and their maps are
joined by a parallel scan, ``FAN`` neighbours a task and level; shorter texts are
counted where they are read.

Nulls count as empty; an empty text has no tokens. Rows are independent, so
repeated rows, ties and empty tables need no special case, and only doc_id and
text are read: other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.llm._shared import TwoGenerationCache, lean, resident, stash

SPACE = "▁"
NEWLINE = "\n"
CHUNK_CHARS = 1 << 16
LONG_CHARS = 1 << 20
FAN = 32


class StateMap(NamedTuple):
    """What a chunk does: ``head`` is read in the state the chunk is entered in,
    ``inner`` tokens follow, ``tail`` is read from the start state afterwards.
    Without a place where the state is known (``synced`` false), head is all."""

    head: str
    inner: int
    tail: str
    synced: bool


class PieceTransducer:
    def __init__(self, model_path: str, state_limit: int = 200_000, word_limit: int = 300_000):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.name != "identity" or not spec.add_dummy_prefix or spec.remove_extra_whitespaces:
            raise ValueError("only an identity normaliser with a leading space is compiled")
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        if not model.trainer_spec.byte_fallback or any(p.type == kinds.USER_DEFINED for p in model.pieces):
            raise ValueError("only vocabularies with byte fallback and without own symbols are compiled")
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece spans a word start")
        self.chars = {c for p in self.score for c in p}
        self.prefixes = {p[:n] for p in self.score for n in range(1, len(p))}
        self.state_limit = state_limit
        self._pairs: dict[tuple[str, str], bool] = {}
        self._reset()
        self.spaced = TwoGenerationCache(lambda word: self.run(SPACE + word), word_limit)
        self.bare = TwoGenerationCache(self.run, word_limit)

    def _reset(self) -> None:
        self.start = frozenset({("", "", 0)})
        self.ids = {self.start: 0}
        self.states = [self.start]
        self.steps: list[dict[str, tuple[int, int]]] = [{}]

    def merge(self, text: str) -> list[str]:
        """The vocabulary's own merges, for the short texts that pairs make."""
        parts = list(text)
        while len(parts) > 1:
            ranked = [(-self.score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score]
            if not ranked:
                break
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def follows(self, before: str, piece: str) -> bool:
        key = before, piece
        if (known := self._pairs.get(key)) is None:
            if len(self._pairs) > 4 * self.state_limit:
                self._pairs.clear()
            known = self._pairs[key] = self.merge(before + piece) == ([before, piece] if before else [piece])
        return known

    def _step(self, state: int, char: str) -> tuple[int, int]:
        """Subset construction of one transition: next state and tokens added."""
        if char not in self.chars:
            return 0, len(char.encode("utf-8", "surrogatepass"))
        partial, done = set(), {}
        for read, before, count in self.states[state]:
            longer = read + char
            if longer in self.prefixes:
                partial.add((longer, before, count))
            if (longer in self.score or len(longer) == 1) and self.follows(before, longer):
                done[longer] = count + 1
        if len(done) != 1:
            raise AssertionError(f"{len(done)} canonical endings")
        piece, added = done.popitem()
        target = frozenset({(read, before, count - added) for read, before, count in partial} | {("", piece, 0)})
        if (i := self.ids.get(target)) is None:
            i = self.ids[target] = len(self.states)
            self.states.append(target)
            self.steps.append({})
        return i, added

    def run(self, text: str) -> int:
        """Tokens of a text read from the start state."""
        if len(self.states) > self.state_limit:
            self._reset()
        state = total = 0
        for char in text:
            step = self.steps[state].get(char)
            if step is None:
                step = self.steps[state][char] = self._step(state, char)
            state, added = step
            total += added
        return total

    def state_map(self, chunk: str) -> StateMap:
        """chunk: text whose spaces are already written as SPACE."""
        starts = [i for i in _word_starts(chunk)]
        if not starts:
            return StateMap(chunk, 0, "", False)
        inner = 0
        for a, b in zip(starts, starts[1:]):
            inner += self.spaced[chunk[a + 1 : b]]
        return StateMap(chunk[: starts[0]], inner, chunk[starts[-1] :], True)

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        if not a.synced and not b.synced:
            joined = a.head + b.head
            return self.state_map(joined) if _may_start(a.head, b.head) else StateMap(joined, 0, "", False)
        if not b.synced:
            rest = self.state_map(a.tail + b.head) if _may_start(a.tail, b.head) else StateMap(a.tail + b.head, 0, "", False)
            if not rest.synced:
                return StateMap(a.head, a.inner, rest.head, True)
            return StateMap(a.head, a.inner + self.run(rest.head) + rest.inner, rest.tail, True)
        if not a.synced:
            if _may_start(a.head, b.head):
                first = self.state_map(a.head + b.head)
                return StateMap(first.head, first.inner + self.run(first.tail) + b.inner, b.tail, True)
            return StateMap(a.head + b.head, b.inner, b.tail, True)
        return StateMap(a.head, a.inner + self.run(a.tail + b.head) + b.inner, b.tail, True)

    def finish(self, whole: StateMap) -> int:
        return self.run(whole.head) + whole.inner + self.run(whole.tail)

    def count(self, text: str | None, chunk_chars: int = CHUNK_CHARS) -> int:
        if not text:
            return 0
        if len(text) <= chunk_chars and "  " not in text and text[0] != " " and SPACE not in text:
            return self._words(text)
        spaced = SPACE + text.replace(" ", SPACE)
        maps = (self.state_map(spaced[i : i + chunk_chars]) for i in range(0, len(spaced), chunk_chars))
        return self.finish(reduce(self.compose, maps))

    def _words(self, text: str) -> int:
        """One chunk without runs of spaces: every word is read from the start
        state, as is every first word of a line, for a line end is no piece."""
        if NEWLINE in self.chars:
            return sum(map(self.spaced.__getitem__, text.split(" ")))
        total, spaced, bare = 0, self.spaced.__getitem__, self.bare.__getitem__
        first = True
        for line in text.split(NEWLINE):
            words = line.split(" ")
            if not first:
                total += 1 + bare(words[0])
                del words[0]
            first = False
            total += sum(map(spaced, words))
        return total


def _word_starts(chunk: str) -> Iterator[int]:
    i = chunk.find(SPACE, 1)
    while i > 0:
        if chunk[i - 1] != SPACE:
            yield i
        i = chunk.find(SPACE, i + 1)


def _may_start(left: str, right: str) -> bool:
    """Whether the seam of two chunks is itself a word start."""
    return bool(left) and right[:1] == SPACE and left[-1:] != SPACE


def transducer(path: str) -> PieceTransducer:
    """One compiled tokenizer per Python worker."""
    return resident(("pieces", path), lambda: PieceTransducer(path))


MAPS = {"head": pa.string(), "inner": pa.int64(), "tail": pa.string(), "synced": pa.bool_()}


def utf8_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def _table(fixed: dict, maps: list[StateMap]) -> dict:
    return fixed | {c: pa.array([getattr(m, c) for m in maps], k) for c, k in MAPS.items()}


def scanned(chunks: DataFrame, model_path: str, most: int) -> DataFrame:
    """chunks: doc_id, row, at, n_bytes, chunk of texts cut into ``most`` pieces
    at most. doc_id, n_bytes and n_tokens of each text (row)."""
    kind = dict(chunks.dtypes)["doc_id"]
    schema = f"doc_id {kind}, row long, at long, n_bytes long, head string, inner long, tail string, synced boolean"

    def mapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model_path)
        for batch in batches:
            fixed = {c: batch[c] for c in ("doc_id", "row", "at", "n_bytes")}
            yield pa.RecordBatch.from_pydict(_table(fixed, [t.state_map(x) for x in batch["chunk"].to_pylist()]))

    def composed(key: tuple, group: pa.Table) -> pa.Table:
        t, group = transducer(model_path), group.sort_by("at")
        one = reduce(t.compose, [StateMap(*x) for x in zip(*(group[c].to_pylist() for c in MAPS))])
        fixed = {"doc_id": group["doc_id"].slice(0, 1), "row": group["row"].slice(0, 1), "at": pa.array([key[1].as_py()], pa.int64()), "n_bytes": pa.array([sum(group["n_bytes"].to_pylist())], pa.int64())}
        return pa.table(_table(fixed, [one]))

    def finished(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model_path)
        for batch in batches:
            tokens = [t.finish(StateMap(*x)) for x in zip(*(batch[c].to_pylist() for c in MAPS))]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "n_tokens": pa.array(tokens, pa.int64())})

    maps = chunks.repartition("row", "at").mapInArrow(mapped, schema)
    while most > 1:
        maps, most = maps.withColumn("next", F.floor(F.col("at") / FAN)).groupBy("row", "next").applyInArrow(composed, schema), -(-most // FAN)
    return maps.mapInArrow(finished, f"doc_id {kind}, n_bytes long, n_tokens long")


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, long_chars: int = LONG_CHARS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; one pass, in which only
    the chunks of long texts are moved."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model_path)
        for batch in batches:
            at, tokens, n_bytes, place, chunk = [], [], [], [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                if text is None or len(text) <= long_chars:
                    pieces = [None]
                else:  # spaces are written as the vocabulary does, bytes are the text's own
                    pieces = [text[k : k + chunk_chars] for k in range(0, len(text), chunk_chars)]
                for k, piece in enumerate(pieces):
                    at.append(i)
                    place.append(k)
                    tokens.append(t.count(text) if piece is None else None)
                    n_bytes.append(utf8_bytes((text or "") if piece is None else piece))
                    chunk.append(piece if piece is None else SPACE * (k == 0) + piece.replace(" ", SPACE))
            columns = {"at": pa.array(place, pa.int64()), "n_bytes": pa.array(n_bytes, pa.int64()), "n_tokens": pa.array(tokens, pa.int64()), "chunk": pa.array(chunk, pa.string())}
            taken = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].take(taken), "row": batch["row"].take(taken)} | columns)

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    read = lean(docs).select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    counted = stash(read.mapInArrow(rows, f"doc_id {kind}, row long, at long, n_bytes long, n_tokens long, chunk string"), "counted")
    found, chunks = counted.where("chunk is null").select("doc_id", "n_bytes", "n_tokens"), counted.where("chunk is not null").drop("n_tokens")
    most = chunks.agg(F.max("at")).first()[0]
    if most is not None:
        found = found.unionByName(scanned(chunks, model_path, most + 1))
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
