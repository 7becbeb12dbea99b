"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

* Tokens are runs of letters, lower-cased. Features are words, word prefixes of four to seven
  letters, pairs of neighbours and skip-grams (the words one apart), each hashed to one of
  ``2 ** BITS`` coordinates. A feature is present in a document or not.
* The fit visits rows one at a time. Every coordinate has its own rate ``ALPHA / (BETA + sqrt(n))``
  (n: its squared gradients so far); ``L1`` keeps a weight at zero until the evidence exceeds it,
  so a few hundred to a few thousand weights are left, which are broadcast.
* The score is the logistic function of the sum of a document's weights and a bias.

Only the fit is bounded: about ``SAMPLE_ROWS`` labelled rows, chosen by a hash of their id, visited
``ROW_VISITS`` times in all (within ``PASSES``); features in fewer than ``LEAST_DOCS`` of them are
not learned. Scoring reads every text in full, in bounded pieces.

Null and empty texts, and texts without a letter, get the score of the bias. Rows without a label
are not learned from; of repeated labels of a document the majority counts (a tie is 1). Without
any label, or with labels of one class only, the score is the share of label 1 (0.5 without
labels). Repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.common import map_texts

BITS = 20
STEMS = (4, 5, 6, 7)
SAMPLE_ROWS = 10_000
LEAST_DOCS = 3
ROW_VISITS = 60_000
PASSES = (4, 30)
ALPHA, BETA, L1, L2 = 0.5, 1.0, 8.0, 0.0
_PIECE = 1 << 18
_BLOCK = 1 << 18
_VOCABULARY = 1 << 19
_WORD = re.compile(r"[^\W\d_]+")
# one odd multiplier per place of a word in a gram, and one number per kind of gram
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_KINDS = {"word": 1, "pair": 2, "skip": 3}


def _bucket(codes: np.ndarray, kind: int) -> np.ndarray:
    """Coordinates of 64-bit gram codes."""
    x = codes + np.uint64(kind * 0xD6E8FEB86659FD93 % (1 << 64))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return ((x * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - BITS)).astype(np.int64)


def _code(word: str) -> int:
    data = word.encode("utf-8", "surrogatepass")
    return zlib.crc32(data) | zlib.crc32(data, 0x5BD1E995) << 32


class _Numbers(dict):
    """Numbers of the words met so far; a new word gets the next one."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Vocabulary:
    """Words met by a task with their codes and the coordinates of words and prefixes."""

    def __init__(self):
        self.numbers = _Numbers()
        self.codes = np.zeros(0, np.uint64)
        self.own = np.zeros((0, 1 + len(STEMS)), np.int64)  # -1: the word has no such prefix

    def read(self, piece: str) -> np.ndarray:
        words = _WORD.findall(piece.lower())
        return np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))

    def grow(self) -> None:
        fresh = list(self.numbers)[len(self.codes) :]
        if not fresh:
            return
        codes = np.array([_code(w) for w in fresh], np.uint64)
        own = np.full((len(fresh), 1 + len(STEMS)), -1, np.int64)
        own[:, 0] = _bucket(codes, _KINDS["word"])
        for k, size in enumerate(STEMS, start=1):
            longer = [i for i, w in enumerate(fresh) if len(w) > size]
            if longer:
                stems = np.array([_code(fresh[i][:size]) for i in longer], np.uint64)
                own[longer, k] = _bucket(stems, 16 + size)
        self.codes = np.concatenate((self.codes, codes))
        self.own = np.concatenate((self.own, own))


def _pieces(text: str) -> Iterator[str]:
    """``text`` in pieces of bounded length, cut at a space where there is one."""
    start = 0
    while len(text) - start > _PIECE:
        cut = text.rfind(" ", start + 1, start + _PIECE)
        cut = cut if cut > start else start + _PIECE
        yield text[start:cut]
        start = cut
    yield text[start:]


def features(texts: list[str | None], vocabulary: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, coordinate) arrays of all features, in blocks; a pair may come more than once."""
    rows: list[int] = []
    runs: list[np.ndarray] = []
    held = 0
    for row, text in enumerate(texts):
        last = np.zeros(0, np.int64)
        for piece in _pieces(text or ""):
            # the two words before a piece start grams that end in it
            run = np.concatenate((last, vocabulary.read(piece)))
            last = run[-2:]
            rows.append(row)
            runs.append(run)
            held += len(run)
            if held > _BLOCK:
                yield _grams(rows, runs, vocabulary)
                rows, runs, held = [], [], 0
                if len(vocabulary.numbers) > _VOCABULARY:
                    words = list(vocabulary.numbers)
                    kept = [words[i] for i in last]
                    vocabulary.__init__()
                    last = np.array([vocabulary.numbers[w] for w in kept], np.int64)
    if runs:
        yield _grams(rows, runs, vocabulary)


def _grams(rows: list[int], runs: list[np.ndarray], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    vocabulary.grow()
    words = np.concatenate(runs)
    run = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
    row = np.array(rows, np.int64)[run]
    codes = vocabulary.codes[words]
    own = vocabulary.own[words]
    there = own >= 0
    out_row, out = [np.broadcast_to(row[:, None], own.shape)[there]], [own[there]]
    for kind, step in (("pair", 1), ("skip", 2)):
        same = run[:-step] == run[step:]
        grams = codes[:-step][same] * _FIRST + codes[step:][same] * _SECOND
        out_row.append(row[:-step][same])
        out.append(_bucket(grams, _KINDS[kind]))
    return np.concatenate(out_row), np.concatenate(out)


@dataclass
class Model:
    """Sparse weights (sorted coordinates) and the bias."""

    places: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        if "_dense" not in self.__dict__:
            self._dense = np.zeros(1 << BITS, np.float64)
            self._dense[self.places] = self.weights
        return self._dense

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_dense"}

    def scores(self, texts: list[str | None], vocabulary: Vocabulary) -> np.ndarray:
        weights, keys = self.dense(), []
        for row, place in features(texts, vocabulary):
            used = weights[place] != 0
            keys.append(np.unique(row[used] << BITS | place[used]))
        keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        sums = np.bincount(
            keys >> BITS, weights[keys & ((1 << BITS) - 1)], minlength=len(texts)
        )
        return 1 / (1 + np.exp(-np.clip(sums + self.bias, -500, 500)))


class Ftrl:
    """FTRL-proximal state: per coordinate the adjusted gradient sum and the squared gradients."""

    def __init__(self, width: int):
        self.z = np.zeros(width)
        self.n = np.zeros(width)

    def weights(self, places: np.ndarray | slice) -> np.ndarray:
        z = self.z[places]
        rate = (BETA + np.sqrt(self.n[places])) / ALPHA + L2
        return np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / rate, 0.0)

    def learn(self, places: np.ndarray, label: float) -> None:
        weights = self.weights(places)
        gradient = 1 / (1 + np.exp(-np.clip(weights.sum(), -500, 500))) - label
        before = self.n[places]
        after = before + gradient**2
        self.z[places] += gradient - (np.sqrt(after) - np.sqrt(before)) / ALPHA * weights
        self.n[places] = after


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """``rows``: distinct coordinates of each sampled document."""
    if not len(labels) or labels.min() == labels.max():
        share = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-6, 1 - 1e-6))
        none = np.zeros(0, np.int64)
        return Model(none, np.zeros(0), float(np.log(share / (1 - share))))
    seen = np.zeros(1 << BITS, np.int64)
    for places in rows:
        seen[places] += 1
    bias = 1 << BITS  # one more coordinate, present in every row
    kept = [np.append(places[seen[places] >= LEAST_DOCS], bias).astype(np.int32) for places in rows]
    state, order = Ftrl(bias + 1), np.random.default_rng(7)
    for _ in range(int(np.clip(ROW_VISITS // len(rows), *PASSES))):
        for i in order.permutation(len(rows)):
            state.learn(kept[i], labels[i])
    weights = state.weights(slice(None))
    places = np.flatnonzero(weights[:bias])
    return Model(places, weights[places], float(weights[bias]))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: the distinct coordinates of every sampled text."""
    vocabulary = Vocabulary()
    for batch in batches:
        for i in range(batch.num_rows):
            text = batch.column(1)[i].as_py()
            found = [np.unique(place) for _, place in features([text], vocabulary)]
            places = np.unique(np.concatenate(found)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, 1), pa.array([places], pa.list_(pa.int32()))],
                names=["y", "places"],
            )


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """Fit on a bounded sample of the rows of ``docs`` that have a label in ``labels``."""
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y"))
    marks = (
        marks.where("_id IS NOT NULL AND y IN (0, 1)")
        .groupBy("_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    )
    total = marks.count()
    share = min(1_000_000, -(-sample_rows * 1_000_000 // max(total, 1)))
    # ids are distinct here, so a hash cut leaves about ``sample_rows`` of them: small enough to send
    chosen = F.broadcast(marks.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < share))
    texts = docs.select(F.col(id_col).alias("_own"), F.col(text_col).alias("text"))
    sample = texts.join(chosen, F.col("_own") == F.col("_id")).select("y", "text")
    read = sample.mapInArrow(_read, "y int, places array<int>").toArrow()
    found = [(p.values.to_numpy(), y) for y, p in zip(read["y"].to_pylist(), read["places"], strict=True)]
    # the same order whatever the partitions were
    found.sort(key=lambda row: (hashlib.sha256(row[0].tobytes()).digest(), row[1]))
    return fit([places for places, _ in found], np.array([y for _, y in found], float))


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document ``id_col, score, predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held: list[Vocabulary] = []

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        if not held:
            held.append(Vocabulary())
        scores = shared.value.scores(batch.column(1).to_pylist(), held[0])
        return [
            batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)),
        ]

    kind = dict(docs.dtypes)[id_col]
    return map_texts(
        docs, [id_col, text_col], f"{id_col} {kind}, score double, predicted int", work
    )
