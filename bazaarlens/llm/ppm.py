"""Language identification by prediction by partial matching over bytes.

Per language a context tree of order four is counted on a bounded sample of labelled rows and then
frozen. A byte costs ``-log2 c/(n+d)`` bits in the longest context that has it (c: its count there,
n: the context's total, d: its distinct bytes); every longer context known to the language costs
the escape ``-log2 d/(n+d)`` first (method C, without exclusion), and a byte unknown even to the
empty context costs 8 bits more. The language with the shortest exact code length of the whole text
wins; the score is its share of the posterior under equal priors.

With frozen statistics a byte's cost depends only on the four bytes before it. The trees of all
languages share one set of nodes, so a task walks them with one table lookup per order and byte
for a whole run of documents, without a loop over bytes; contexts begin anew with each document.

Every label is learned, from about ``SAMPLE_ROWS`` of its rows, chosen by a hash of their id. The
trees have ``MAX_NODES`` nodes per depth, fewer where nodes times languages would exceed
``MAX_CELLS``; every language has an equal share of them, its most frequent strings. Scoring reads
every byte of every text.

Null texts and texts without a letter give ``und`` with score 0, as does everything when nothing
can be learned. Ties go to the language that sorts first. Repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.llm.common import map_texts, slices, spare, text_buffer

ORDER = 4
SAMPLE_ROWS = 1_000
MAX_NODES = 32_768
MAX_CELLS = 1 << 23
UNKNOWN = "und"
# A text is in a learned language if its code is no longer than LIMIT_FACTOR times what that language
# needs for its own training texts, within these bits per byte (8: what no model at all needs; the
# lower one because few training texts are coded too well), and SPARE_BITS more. Those widen the
# limit of a short text by about one key or number, which no language codes well.
LIMIT_FACTOR = 4.5
LIMIT_BITS = (6.0, 8.0)
SPARE_BITS = 160
_PIECE = 1 << 18


def _gram_codes(data: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """The last ``length`` bytes at every position of every row that has so many, as integers."""
    if len(data) < length:
        return np.zeros(0, np.uint64)
    n = len(data) - length + 1
    codes = np.zeros(n, np.uint64)
    for i in range(length):
        codes = (codes << np.uint64(8)) | data[i : i + n].astype(np.uint64)
    row = np.searchsorted(ends, np.arange(n), "right")
    return codes[np.arange(n) + length <= ends[row]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, 1, 1 << 20):
            data, ends = text_buffer(piece.column(1))
            lang = np.array(piece.column(0).to_pylist(), object)
            bounds = list(zip(lang, ends[:-1], ends[1:], strict=True))
            for name in sorted(set(lang)):
                parts = [data[a:b] for own, a, b in bounds if own == name]
                own = np.concatenate(parts)
                own_ends = np.cumsum([0, *map(len, parts)])
                for length in range(1, ORDER + 2):
                    codes, n = np.unique(
                        _gram_codes(own, own_ends, length), return_counts=True
                    )
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * len(codes), pa.string()),
                            pa.array(np.full(len(codes), length, np.int32)),
                            pa.array(codes.astype(np.int64)),
                            pa.array(n.astype(np.int64)),
                        ],
                        names=["lang", "length", "code", "n"],
                    )


@dataclass
class Model:
    """Frozen statistics: per depth a step table, code lengths and escapes (row 0: no node)."""

    languages: list[str]
    symbol: np.ndarray  # byte -> column of the step tables
    steps: list[np.ndarray]  # depth d+2: [node of depth d+1 at the byte before, symbol] -> node
    costs: list[np.ndarray]  # depth d+1: bits by node and language
    escapes: list[np.ndarray]  # depth d+1 as a context: bits by node and language
    own: np.ndarray  # bits per byte of each language's training texts in their longest nodes

    @staticmethod
    def build(languages: list[str], grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """``grams``: per depth (codes, language numbers, counts)."""
        width = len(languages)
        counts = np.zeros((256, width))
        codes, lang, n = grams[0]
        np.add.at(counts, (codes.astype(int), lang), n)
        total, kinds = counts.sum(0), (counts > 0).sum(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0)
            cost = np.where(counts > 0, -np.log2(counts / (total + kinds)), escape + 8)
        known = np.arange(256, dtype=np.uint64)
        costs = [np.vstack([np.zeros(width), cost])]
        symbols = np.unique(codes.astype(int))
        symbol = np.zeros(256, np.int64)
        symbol[symbols] = np.arange(1, len(symbols) + 1)
        steps, escapes = [], []
        size, own, above = np.maximum(total, 1), np.zeros(width), counts[known.astype(int)]
        for depth, (codes, lang, n) in enumerate(grams[1:], start=2):
            whole = np.unique(codes)
            before = whole >> np.uint64(8)
            after = whole & np.uint64((1 << (8 * (depth - 1))) - 1)
            whole = whole[np.isin(before, known) & np.isin(after, known)]
            fits = np.isin(codes, whole)
            counts = np.zeros((len(whole), width))
            np.add.at(counts, (np.searchsorted(whole, codes[fits]), lang[fits]), n[fits])
            context = np.searchsorted(known, whole >> np.uint64(8))
            suffix = np.searchsorted(known, whole & np.uint64((1 << (8 * (depth - 1))) - 1))
            total, kinds = np.zeros((len(known), width)), np.zeros((len(known), width))
            np.add.at(total, context, counts)
            np.add.at(kinds, context, counts > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0)
                cost = np.where(
                    counts > 0, -np.log2(counts / (total + kinds)[context]),
                    escape[context] + costs[-1][1:][suffix],
                )
            # what no longer node holds is coded here
            longer = np.zeros_like(above)
            np.add.at(longer, suffix, counts)
            own += (np.maximum(above - longer, 0) * costs[-1][1:]).sum(0)
            above = counts
            step = np.zeros((len(known) + 1, len(symbols) + 1), np.int32)
            step[context + 1, symbol[(whole & np.uint64(255)).astype(int)]] = (
                np.arange(len(whole)) + 1
            )
            steps.append(step.ravel())
            escapes.append(np.vstack([np.zeros(width), escape]))
            costs.append(np.vstack([np.zeros(width), cost]))
            known = whole
        own += (above * costs[-1][1:]).sum(0)
        narrow = [x.astype(np.float32) for x in costs], [x.astype(np.float32) for x in escapes]
        return Model(languages, symbol, steps, *narrow, own / size)

    def code_lengths(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bits of every row (rows x languages)."""
        out = np.zeros((len(ends) - 1, len(self.languages)))
        for start in range(0, len(data), _PIECE):
            begin = max(0, start - ORDER)
            part = data[begin : start + _PIECE]
            rows = ends[(ends >= begin) & (ends < begin + len(part))] - begin
            bits = self._bits(part, rows)[start - begin :]
            first = int(np.searchsorted(ends, start, "right")) - 1
            last = int(np.searchsorted(ends, start + len(bits), "left"))
            cuts = np.clip(ends[first:last] - start, 0, None)
            # rows without a byte in this part repeat a cut: leave them out of the sums
            used = np.flatnonzero(np.diff(np.append(cuts, len(bits))) > 0)
            sums = np.add.reduceat(bits, cuts[used], axis=0, dtype=np.float64)
            out[first + used] += sums
        return out

    def _bits(self, data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        symbol = self.symbol[data]
        width = int(self.symbol.max()) + 1
        nodes, contexts = [data.astype(np.int64) + 1], []
        for step in self.steps:
            before = np.zeros(len(data), np.int64)
            before[1:] = nodes[-1][:-1]
            before[firsts] = 0
            contexts.append(before)
            nodes.append(step[before * width + symbol])
        bits = self.costs[-1][nodes[-1]]
        left = np.flatnonzero(nodes[-1] == 0)
        for depth in range(len(self.steps) - 1, -1, -1):
            bits[left] += self.escapes[depth][contexts[depth][left]]
            at = nodes[depth][left]
            bits[left] += self.costs[depth][at]
            left = left[at == 0]
        return bits

    def predict(self, column: pa.Array, letters: np.ndarray):
        """Per row: language, its posterior and the code length in bits per byte."""
        best, share, least, sizes, known = self._best(column, letters)
        names = np.array([*self.languages, UNKNOWN], object)
        return (
            names[np.where(known, best, len(self.languages))],
            np.where(known, share, 0.0),
            np.where(known, least / np.maximum(sizes, 1), 0.0),
        )

    def fits(self, column: pa.Array, letters: np.ndarray) -> np.ndarray:
        """Whether each row's code in its best language is short enough for that language."""
        best, _, least, sizes, known = self._best(column, letters)
        if not self.languages:
            return known
        limit = np.clip(LIMIT_FACTOR * self.own, *LIMIT_BITS)
        return known & (least <= limit[best] * sizes + SPARE_BITS)

    def _best(self, column: pa.Array, letters: np.ndarray):
        """Per row: number of the best language, its posterior, its bits, the bytes, and whether
        there is any language to tell."""
        data, ends = text_buffer(column)
        sizes = np.diff(ends)
        if not self.languages:
            blank = np.zeros(len(sizes))
            return blank.astype(int), blank, blank, sizes, np.zeros(len(sizes), bool)
        bits = self.code_lengths(data, ends)
        least = bits.min(axis=1)
        share = 1 / np.exp2(least[:, None] - bits).sum(axis=1)
        return bits.argmin(axis=1), share, least, sizes, letters.astype(bool) & (sizes > 0)


def train(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample_rows: int = SAMPLE_ROWS, max_nodes: int = MAX_NODES,
) -> Model:
    """Count and freeze the context trees of ``labelled`` rows; null texts and labels are left out."""
    rows = labelled.select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"),
        F.xxhash64(F.col(id_col)).alias("_h"),
    ).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    share = F.lit(0)
    for lang, n in sizes:
        part = min(1_000_000, -(-sample_rows * 1_000_000 // n))
        share = F.when(F.col("lang") == lang, part).otherwise(share)
    sample = rows.where(F.pmod("_h", F.lit(1_000_000)) < share).select("lang", "text")
    grams = (
        sample.mapInArrow(_count, "lang string, length int, code bigint, n bigint")
        .groupBy("lang", "length", "code").agg(F.sum("n").alias("n"))
    ).persist()
    languages = sorted(lang for lang, _ in sizes)
    number = {lang: i for i, lang in enumerate(languages)}
    width = max(len(languages), 1)
    share = max(1, min(max_nodes, MAX_CELLS // width) // width)
    own = Window.partitionBy("length", "lang").orderBy(F.desc("n"), "code")
    top = (
        grams.withColumn("_rank", F.row_number().over(own)).where(F.col("_rank") <= share)
        .select("lang", "length", "code", "n").toPandas()
    )
    grams.unpersist()
    depths = []
    for length in range(1, ORDER + 2):
        part = top[top["length"] == length]
        depths.append(
            (
                part["code"].to_numpy(np.int64).astype(np.uint64),
                part["lang"].map(number).to_numpy(np.int64),
                part["n"].to_numpy(np.float64),
            )
        )
    return Model.build(languages, depths)


def _has_letter(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def identify(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document ``id_col, lang_pred, score, bits_per_byte``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        letters = batch.column(1).to_numpy(zero_copy_only=False)
        names, share, bits = shared.value.predict(batch.column(2), letters)
        return [batch.column(0), pa.array(names, pa.string()), pa.array(share), pa.array(bits)]

    kind = dict(docs.dtypes)[id_col]
    (letter,) = spare(docs, "_letters")
    return map_texts(
        docs.select(id_col, _has_letter(text_col).alias(letter), text_col),
        [id_col, letter, text_col],
        f"{id_col} {kind}, lang_pred string, score double, bits_per_byte double", work,
    )


def in_known_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` in some learned language: not ``und``, and coded about as well as that
    language's own texts (see ``LIMIT_FACTOR``). A text in a language that was not learned, in any
    script, and a run of random letters fail that; a short text around a key or number does not,
    and nor does a foreign text of a few words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    flagged = docs.select("*", _has_letter(text_col).alias(spare(docs, "_letters")[0]))
    columns, text = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text):
                flags = piece.column(len(columns)).to_numpy(zero_copy_only=False)
                keep = shared.value.fits(piece.column(text), flags)
                yield piece.select(columns).filter(pa.array(keep))

    return flagged.mapInArrow(run, docs.schema)
