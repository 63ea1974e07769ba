"""Language identification by segmentation-marginalised unigram models.

Every language has a probability for each piece of a fixed public vocabulary.
A word's probability is the sum, over all its segmentations into pieces, of the
products of the pieces' probabilities; a forward pass computes that sum. Words
are runs of letters, each with the vocabulary's word-start mark, and words as
well as pieces are lower-cased, so the vocabulary that is used is the public one
without its case and without pieces that hold anything but letters. No piece
leaves a word, so a text's probability is the product of its words'. The sums
are kept as logarithms where a word is long, so a word of any length counts.

Training is expectation maximisation on labelled texts: a bounded sample of
about ``max_docs`` training rows (``max_docs`` is the documented parameter; rows
enter by a hash of doc_id) is reduced to counts of (language, word), and each
round is one Spark job whose result, expected counts of (language, piece), is
bounded by vocabulary times languages.

Prediction is one narrow pass over whole texts. A null text, or one without a
letter, is ``und`` with score 0; so is everything when there is no labelled row.
Languages that explain a text equally well are a tie, which goes to the language
first in code-point order, and the score says how little that means (1 over
the number of languages if all tie). An empty table gives an empty result. Only
doc_id, text and, for training, lang are read; other columns are ignored.

``keep_identified`` also asks whether any learned language fits. The pieces'
uniform distribution stands for every other language: a text that it explains
better than the best language by over ``margin`` nats is in none of them. A text
is mislabelled if another language beats its own label's by over ``margin`` nats,
and the words that speak for the label weigh less than ``share`` of those that
speak against it: a text in its language that quotes another one is not.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyloom.llm._shared import discard, kept, lean, release, resident, stash

START = "▁"
UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")
SHORT = 24  # letters up to which probabilities stay far from the smallest double
MARGIN = 20.0  # nats of evidence against a text before it is rejected
SHARE = 0.1  # of it that words for the label may weigh


class PieceTable:
    """The letter pieces of a vocabulary and where they occur in words."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        normal = sentencepiece_model_pb2.ModelProto.SentencePiece.NORMAL
        pieces = {p.piece.lower() for p in model.pieces if p.type == normal}
        pieces = sorted(p for p in pieces if p == START or WORD.fullmatch(p.removeprefix(START)))
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.unknown = len(pieces)  # one id for every character that is no piece
        self.size = len(pieces) + 1
        self.longest = max(map(len, pieces))
        self.prefixes = {p[:n] for p in pieces for n in range(1, len(p))}
        self._trie()

    def edges(self, word: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, piece id) of every piece in the marked word, by start."""
        ids, prefixes, longest, n = self.ids, self.prefixes, self.longest, len(word)
        for i in range(n):
            alone = word[i]
            yield i, i + 1, ids.get(alone, self.unknown)
            if alone not in prefixes:
                continue
            for j in range(i + 2, min(n, i + longest) + 1):
                part = word[i:j]
                if (piece := ids.get(part)) is not None:
                    yield i, j, piece
                if part not in prefixes:
                    break

    def _trie(self) -> None:
        """The pieces as a trie in arrays: edges sorted by (node, letter)."""
        nodes, letters, rows = {"": 0}, {}, []
        self.piece_of = [-1]
        for piece, number in self.ids.items():
            for n in range(1, len(piece) + 1):
                if piece[:n] not in nodes:
                    nodes[piece[:n]] = len(nodes)
                    self.piece_of.append(-1)
                    rows.append((nodes[piece[: n - 1]], letters.setdefault(piece[n - 1], len(letters) + 1), nodes[piece[:n]]))
            self.piece_of[nodes[piece]] = number
        self.piece_of = np.array(self.piece_of, np.int32)
        self.letter_of = np.zeros(0x110000, np.int64)  # 0: in no piece
        for letter, number in letters.items():
            self.letter_of[ord(letter)] = number
        self.alphabet = len(letters) + 1
        rows.sort()
        self.edge_keys = np.array([node * self.alphabet + letter for node, letter, _ in rows] + [np.iinfo(np.int64).max])
        self.edge_ends = np.array([end for _, _, end in rows] + [-1])

    def lattice(self, words: Sequence[str]) -> np.ndarray:
        """Piece ids by word, start and length - 1 of words that are equally
        long; -1 where no piece is. All starts of all words walk down the trie at
        once; those without a way on drop out."""
        n = len(words[0]) + 1
        longest = min(n, self.longest)
        found = np.full(len(words) * n * longest, -1, np.int32)
        letters = self.letter_of[np.frombuffer("".join(START + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        at, node = np.arange(len(letters)), np.zeros(len(letters), np.int64)
        for length in range(1, longest + 1):
            inside = at % n <= n - length
            at, node = at[inside], node[inside]
            key = node * self.alphabet + letters[at + length - 1]
            edge = np.searchsorted(self.edge_keys, key)
            known = self.edge_keys[edge] == key
            if length == 1:
                found[at * longest] = self.unknown
            at, node = at[known], self.edge_ends[edge[known]]
            piece = self.piece_of[node]
            whole = piece >= 0
            found[at[whole] * longest + length - 1] = piece[whole]
            if not len(at):
                break
        return found.reshape(len(words), n, longest)


def forward(lattice: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """Word, end and language: summed probability of all segmentations of each
    prefix. probability has a row per piece id and a last row of zeros, which
    the -1 of empty lattice places reads."""
    words, n, longest = lattice.shape
    alpha = np.zeros((words, n + 1, probability.shape[1]))
    alpha[:, 0] = 1.0
    for end in range(1, n + 1):
        for length in range(1, min(end, longest) + 1):
            piece = lattice[:, end - length, length - 1]
            if (piece >= 0).any():
                alpha[:, end] += alpha[:, end - length] * probability[piece]
    return alpha


def backward(lattice: np.ndarray, probability: np.ndarray) -> np.ndarray:
    words, n, longest = lattice.shape
    beta = np.zeros((words, n + 1, probability.shape[1]))
    beta[:, n] = 1.0
    for start in range(n - 1, -1, -1):
        for length in range(1, min(n - start, longest) + 1):
            piece = lattice[:, start, length - 1]
            if (piece >= 0).any():
                beta[:, start] += beta[:, start + length] * probability[piece]
    return beta


def log_sums(edges: Sequence[tuple[int, int, int]], n: int, logs: np.ndarray, reverse: bool = False) -> np.ndarray:
    """Of one word of any length, by place and language: the logarithm of what
    ``forward`` sums, or ``backward`` if reverse. logs: log probability by piece."""
    arriving: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
    for i, j, piece in edges:
        arriving[i if reverse else j].append((j if reverse else i, piece))
    out = np.zeros((n + 1, logs.shape[1]))
    for at in range(n - 1, -1, -1) if reverse else range(1, n + 1):
        before, pieces = zip(*arriving[at])
        terms = out[list(before)] + logs[list(pieces)]
        most = terms.max(0)
        out[at] = most + np.log(np.exp(terms - most).sum(0))
    return out


def piece_table(path: str) -> PieceTable:
    """Kept beside the worker's other tables, and forgotten with them."""
    return kept(("piecetable", path), lambda: PieceTable(path))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def lettered(text: str | None, words: Sequence[str]) -> bool:
    return bool(words) and any(map(str.isalpha, text))


def by_length(words: Iterable[str], most: int = 20_000) -> Iterator[list[str]]:
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    for length in sorted(groups):
        step = max(200, most * 8 // (length + 1))
        for i in range(0, len(groups[length]), step):
            yield groups[length][i : i + step]


class Model:
    """languages, log priors and the piece probabilities, a column a language."""

    def __init__(self, vocabulary: str, languages: list[str], prior: np.ndarray, probability: np.ndarray):
        self.vocabulary, self.languages, self.prior, self.probability = vocabulary, languages, prior, probability
        self.key = uuid.uuid4().hex


class Scorer:
    """Log probabilities of words by language, and last by the uniform
    distribution, kept for words that come again; at most ``limit`` at a time."""

    def __init__(self, model: Model, limit: int = 200_000):
        self.model, self.limit = model, limit
        self.table = piece_table(model.vocabulary)
        known = np.hstack([model.probability, np.full((self.table.size, 1), 1.0 / self.table.size)])
        self.probability, self.log_probability = np.vstack([known, np.zeros((1, known.shape[1]))]), np.log(known)
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.logs = np.zeros((0, len(self.model.languages) + 1))

    def learn(self, words: set[str]) -> None:
        new = words - self.index.keys()
        if len(new) + len(self.index) > self.limit:
            self._clear()
            new = words
        rows = [self.logs]
        for group in by_length(sorted(new)):
            for w in group:
                self.index[w] = len(self.index)
            if len(group[0]) <= SHORT:
                rows.append(np.log(forward(self.table.lattice(group), self.probability)[:, -1]))
            else:
                rows += [log_sums(self.table.edges(START + w), len(w) + 1, self.log_probability)[-1:] for w in group]
        self.logs = np.concatenate(rows)

    def evidence(self, texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Of each text the log probabilities by language, priors included, and
        by the uniform distribution, and its words' places in ``logs``; None if
        it has no letter."""
        for i in range(0, len(texts), 200):
            documents = [words_of(t) if isinstance(t, str) else [] for t in texts[i : i + 200]]
            self.learn(set().union(*documents))
            for text, words in zip(texts[i : i + 200], documents):
                if not lettered(text, words):
                    yield None
                    continue
                at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
                logs = self.logs[at].sum(0)
                logs[:-1] += self.model.prior
                yield logs, at

    def predict(self, texts: Sequence[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        for found in self.evidence(texts):
            if found is None or not self.model.languages:
                out.append((UNDETERMINED, 0.0))
                continue
            logs = found[0]
            best = int(logs[:-1].argmax())
            out.append((self.model.languages[best], float(1.0 / np.exp(logs[:-1] - logs[best]).sum())))
        return out

    def accepts(self, texts: Sequence[str | None], labels: Sequence[str | None], margin: float, share: float) -> list[bool]:
        """Whether a learned language fits each text, and its label, if it has one."""
        number = {lang: k for k, lang in enumerate(self.model.languages)}
        out = []
        for found, label in zip(self.evidence(texts), labels):
            if found is None or not number:
                out.append(found is not None)
                continue
            logs, at = found
            best, own = int(logs[:-1].argmax()), number.get(label)
            fits = logs[-1] - logs[best] <= margin
            if fits and own is not None and logs[best] - logs[own] > margin:
                each = self.logs[at, best] - self.logs[at, own]
                fits = -each[each < 0].sum() >= share * each[each > 0].sum()
            out.append(bool(fits))
        return out


def scorer_of(model: Model) -> Scorer:
    """One scorer per Python worker, kept for the next tasks with its model."""
    return resident(("scorer", model.key), lambda: Scorer(model))


def level(counts: list[int], most: int) -> int:
    """The bound a language under which bounded counts sum to ``most``; 50 at least."""
    left = most
    for k, n in enumerate(sorted(counts)):
        if n * (len(counts) - k) > left:
            return max(50, left // (len(counts) - k))
        left -= n
    return max([50, *counts])


def train(labelled: DataFrame, vocabulary: str, max_docs: int = 8_000, rounds: int = 3, smoothing: float = 0.02) -> Model:
    """labelled: doc_id, text, lang; rows with a null among text and lang are left out.
    Languages and priors come from all rows, words from a sample of about
    ``max_docs``, of which no language gets less than all or an equal part."""
    labelled = labelled.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    documents = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = level(list(documents.values()), max_docs)
    shares = labelled.sparkSession.createDataFrame([(x, min(1 << 20, (most << 20) // n)) for x, n in documents.items()], "lang string, below int")
    sample = labelled.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 20)) < F.col("below")).select("doc_id", "text", "lang")

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for batch in batches:
            counts: dict[str, Counter] = {}
            for text, lang in zip(batch["text"], batch["lang"]):
                counts.setdefault(lang, Counter()).update(words_of(text))
            rows = [(lang, w, float(n)) for lang, c in counts.items() for w, n in c.items()]
            yield pd.DataFrame(rows, columns=["lang", "word", "n"])

    counted = stash(lean(sample).mapInPandas(count, "lang string, word string, n double").groupBy("lang", "word").agg(F.sum("n").alias("n")), "langwords")
    languages = sorted(documents)
    table = piece_table(vocabulary)
    probability = np.full((table.size, len(languages)), 1.0 / table.size)
    column = {lang: k for k, lang in enumerate(languages)}
    for _ in range(rounds if languages else 0):
        current, logs = np.vstack([probability, np.zeros((1, len(languages)))]), np.log(probability)

        def expect(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pieces = piece_table(vocabulary)
            gathered: dict[str, np.ndarray] = {}
            for batch in batches:
                for lang, rows in batch.groupby("lang"):
                    gained = gathered.setdefault(lang, np.zeros(pieces.size))
                    times = dict(zip(rows["word"], rows["n"]))
                    p = current[:, [column[lang]]]
                    for group in by_length(times, 5_000):
                        if len(group[0]) > SHORT:
                            for w in group:
                                edges, n, own = list(pieces.edges(START + w)), len(w) + 1, logs[:, [column[lang]]]
                                alpha, beta = log_sums(edges, n, own)[:, 0], log_sums(edges, n, own, reverse=True)[:, 0]
                                i, j, piece = np.array(edges).T
                                share = np.exp(alpha[i] + own[piece, 0] + beta[j] - alpha[-1])
                                gained += np.bincount(piece, weights=times[w] * share, minlength=pieces.size)
                            continue
                        lattice = pieces.lattice(group)
                        alpha, beta = forward(lattice, p)[:, :, 0], backward(lattice, p)[:, :, 0]
                        k, i, j = np.nonzero(lattice >= 0)
                        piece = lattice[k, i, j]
                        weight = np.array([times[w] for w in group]) / alpha[:, -1]
                        gained += np.bincount(piece, weights=weight[k] * alpha[k, i] * p[piece, 0] * beta[k, i + j + 1], minlength=pieces.size)
            for lang, gained in gathered.items():
                used = np.flatnonzero(gained > 0)
                yield pd.DataFrame({"lang": lang, "piece": used.astype(np.int32), "n": gained[used]})

        rows = counted.mapInPandas(expect, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        gained = np.full((table.size, len(languages)), smoothing)
        gained[rows["piece"], rows["lang"].map(column)] += rows["n"]
        probability = gained / gained.sum(0)
    discard(counted)
    seen = np.array([documents[x] for x in languages])
    return Model(vocabulary, languages, np.log(seen / seen.sum()) if languages else seen, probability)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score instead of other columns than doc_id."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: vocabulary times languages

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(shared.value)
        for batch in batches:
            found = scorer.predict(batch["text"].to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([s for _, s in found], pa.float64())})

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return lean(docs).select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, lang_pred string, score double")


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 4; remainder 2 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def identify(docs: DataFrame, vocabulary: str, max_docs: int = 8_000) -> DataFrame:
    """Train on the rows that are not held out, predict all."""
    model = train(docs.where(fold(F.col("doc_id")) != 2), vocabulary, max_docs)
    return predict(docs, model).select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, vocabulary: str, max_docs: int = 8_000, margin: float = MARGIN, share: float = SHARE) -> DataFrame:
    """docs without the rows that the model rejects: no letters, in none of the
    learned languages, or labelled with one that another beats; all columns
    stay. Without a labelled row there is no model, and rows with letters stay."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, vocabulary, max_docs))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(model.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer.accepts(batch["text"].to_pylist(), batch["lang"].to_pylist(), margin, share), pa.bool_()))

    return lean(docs).mapInArrow(rows, docs.schema)
