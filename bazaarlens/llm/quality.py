"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

* Tokens are words (lower-cased) and runs of other visible characters; a word in capitals also
  gives the token ``<CAPS>``, a token equal to the one before gives ``<SAME>``.
* Every token has a sparse ternary index vector, a function of its CRC-32. The vector of a
  vocabulary word is its index vector plus the normalised sum of the index vectors met within two
  tokens of it in the training sample; other tokens keep their index vector alone.
* A document is the mean of its token vectors, its square root scaled token count and a bias.
* Two numpy layers, trained on labelled rows, give a logit; a temperature fitted on rows the
  network did not see turns it into a calibrated probability.

Only the fit is bounded: about ``SAMPLE_ROWS`` labelled rows, chosen by a hash of their id, and the
``MAX_WORDS`` most frequent words of them. Scoring reads every text in full, in bounded pieces.

Null and empty texts are scored as documents without tokens. Rows without a label are not learned
from; of repeated labels of a document the majority counts (a tie is 1). Without any label, or with labels of one class
only, the score is the share of label 1 (0.5 without labels). Repeated rows give repeated rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.common import map_texts

WIDTH = 48
NONZERO = 6
SAMPLE_ROWS = 8_000
MAX_WORDS = 16_384
OTHER = 16_384  # index vectors shared by tokens outside the vocabulary
HIDDEN = 24
REACH = 2
_PIECE = 1 << 18
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def index_vectors(seeds: np.ndarray) -> np.ndarray:
    """Sparse ternary vectors drawn from 32-bit seeds: equal seeds, equal vectors."""
    out = np.zeros((len(seeds), WIDTH), np.float32)
    state = seeds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    for step in range(NONZERO):
        state ^= state >> np.uint64(29)
        state *= np.uint64(0xBF58476D1CE4E5B9)
        state ^= state >> np.uint64(32)
        place = (state % np.uint64(WIDTH)).astype(np.int64)
        out[np.arange(len(seeds)), place] += 1 if step % 2 else -1
    return out / np.float32(np.sqrt(NONZERO))


def pieces(text: str) -> Iterator[str]:
    """``text`` in bounded pieces cut before white space (or where a piece has none)."""
    start = 0
    while len(text) - start > _PIECE:
        cut = text.rfind(" ", start + 1, start + _PIECE)
        cut = cut if cut > start else start + _PIECE
        yield text[start:cut]
        start = cut
    yield text[start:]


def tokens(text: str) -> list[str]:
    out, last = [], None
    for token in _TOKEN.findall(text):
        low = token.lower()
        out.append(low)
        if len(token) > 1 and token.isupper():
            out.append("<CAPS>")
        if low == last:
            out.append("<SAME>")
        last = low
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column(0):
            for piece in pieces(text.as_py() or ""):
                counts.update(tokens(piece))
            if len(counts) > 500_000:
                yield _counted(counts)
                counts.clear()
    yield _counted(counts)


def _counted(counts: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
        names=["word", "n"],
    )


@dataclass
class Vectors:
    """Vocabulary with its vectors; tokens outside it share ``OTHER`` index vectors."""

    words: list[str]
    vectors: np.ndarray = None
    ids: dict[str, int] = field(default=None, repr=False)

    def __post_init__(self):
        if self.vectors is None:
            seeds = [zlib.crc32(w.encode()) for w in self.words]
            other = np.arange(OTHER) + (1 << 32)
            self.vectors = index_vectors(np.array([*seeds, *other], np.uint64))
        self.ids = {word: i for i, word in enumerate(self.words)}

    def number(self, words: list[str]) -> np.ndarray:
        known, base = self.ids.get, len(self.words)
        out = [known(w, -1) for w in words]
        return np.array(
            [base + zlib.crc32(w.encode()) % OTHER if i < 0 else i
             for i, w in zip(out, words, strict=True)],
            np.int64,
        )

    def pooled(self, text: str | None) -> np.ndarray:
        total, n = np.zeros(WIDTH), 0
        for piece in pieces(text or ""):
            ids = self.number(tokens(piece))
            if len(ids):
                total += self.vectors[ids].sum(axis=0, dtype=np.float64)
                n += len(ids)
        return np.concatenate((total / max(n, 1), [np.sqrt(min(n, 400)) / 20, 1.0]))


def _contexts(shared):
    """Task: sums of the index vectors met near every vocabulary word, one row per word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base: Vectors = shared.value
        sums = np.zeros((len(base.words), WIDTH), np.float32)
        for batch in batches:
            for text in batch.column(0):
                for piece in pieces(text.as_py() or ""):
                    ids = base.number(tokens(piece))
                    near = np.zeros((len(ids), WIDTH), np.float32)
                    for step in range(1, min(REACH, len(ids) - 1) + 1):
                        near[step:] += base.vectors[ids[:-step]]
                        near[:-step] += base.vectors[ids[step:]]
                    known = np.flatnonzero(ids < len(base.words))
                    if len(known):
                        order = known[np.argsort(ids[known], kind="stable")]
                        words, starts = np.unique(ids[order], return_index=True)
                        sums[words] += np.add.reduceat(near[order], starts, axis=0)
        used = np.flatnonzero(np.abs(sums).sum(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(list(sums[used]), pa.list_(pa.float32()))],
            names=["word", "v"],
        )

    return run


@dataclass
class Network:
    """Standardised input, one hidden layer, a logit and its temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, steps: int = 600, rate: float = 0.02) -> Network:
        """Full-batch Adam on three quarters of the rows; the temperature from the rest."""
        rng = np.random.default_rng(7)
        if not len(y) or y.min() == y.max():
            p = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
            return Network(
                np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros((x.shape[1], 1)),
                np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))),
            )
        order = rng.permutation(len(y))
        own, rest = order[len(y) // 4 :], order[: len(y) // 4]
        net = Network(
            x[own].mean(0), x[own].std(0) + 1e-6,
            rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
            rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0,
        )
        z, t = (x[own] - net.mean) / net.scale, y[own]
        names = ["w1", "b1", "w2", "b2"]
        first = {k: np.zeros_like(getattr(net, k)) for k in names}
        second = {k: np.zeros_like(getattr(net, k)) for k in names}
        for step in range(1, steps + 1):
            hidden = np.tanh(z @ net.w1 + net.b1)
            error = (1 / (1 + np.exp(-(hidden @ net.w2 + net.b2))) - t) / len(t)
            back = np.outer(error, net.w2) * (1 - hidden**2)
            slopes = {
                "w1": z.T @ back + 1e-4 * net.w1, "b1": back.sum(0),
                "w2": hidden.T @ error + 1e-4 * net.w2, "b2": error.sum(),
            }
            for k, slope in slopes.items():
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope**2
                m, v = first[k] / (1 - 0.9**step), second[k] / (1 - 0.999**step)
                setattr(net, k, getattr(net, k) - rate * m / (np.sqrt(v) + 1e-8))
        if len(rest):
            raw, t = net.logits(x[rest]), y[rest]
            tries = np.geomspace(0.25, 8, 61)
            loss = [np.logaddexp(0, -np.where(t == 1, raw, -raw) / k).mean() for k in tries]
            net.temperature = float(tries[int(np.argmin(loss))])
        return net


@dataclass
class Model:
    vectors: Vectors
    network: Network


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """Fit vectors and network on a bounded sample of the rows of ``docs`` that have a label."""
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y"))
    marks = (
        marks.where("_id IS NOT NULL AND y IN (0, 1)")
        .groupBy("_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    )
    total = marks.count()
    share = min(1_000_000, -(-sample_rows * 1_000_000 // max(total, 1)))
    # ids are distinct here, so a hash cut leaves about ``sample_rows`` of them: small enough to send
    chosen = F.broadcast(marks.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < share))
    texts = docs.select(
        F.col(id_col).alias("_own"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    sample = texts.join(chosen, F.col("_own") == F.col("_id")).select("text", "y").persist()
    spark = docs.sparkSession
    top = (
        sample.select("text").mapInArrow(_count_words, "word string, n bigint")
        .groupBy("word").agg(F.sum("n").alias("n"))
        .where("n > 1").orderBy(F.desc("n"), "word").limit(MAX_WORDS).collect()
    )
    base = Vectors([r["word"] for r in top])
    shared = spark.sparkContext.broadcast(base)
    parts = sample.select("text").coalesce(8).mapInArrow(
        _contexts(shared), "word bigint, v array<float>"
    )
    sums = np.zeros((len(top), WIDTH))
    for row in parts.toLocalIterator():
        sums[row["word"]] += np.asarray(row["v"])
    sizes = np.linalg.norm(sums, axis=1, keepdims=True)
    vectors = base.vectors.copy()
    vectors[: len(top)] += (sums / np.maximum(sizes, 1e-9)).astype(np.float32)
    full = Vectors(base.words, vectors)
    shared = spark.sparkContext.broadcast(full)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [shared.value.pooled(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"]
            )

    rows = sample.select("y", "text").mapInArrow(work, "y int, x array<double>").toPandas()
    sample.unpersist()
    rows["key"] = [np.asarray(v).tobytes() for v in rows["x"]]
    rows = rows.sort_values(["key", "y"])  # the same order whatever the partitions were
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), WIDTH + 2)
    return Model(full, Network.fit(x, rows["y"].to_numpy(float)))


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document ``id_col, score, predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        own: Model = shared.value
        x = np.array([own.vectors.pooled(text.as_py()) for text in batch.column(1)])
        scores = own.network.scores(x)
        return [
            batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)),
        ]

    kind = dict(docs.dtypes)[id_col]
    return map_texts(
        docs, [id_col, text_col], f"{id_col} {kind}, score double, predicted int", work
    )
