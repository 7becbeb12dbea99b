"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments. Flipping one bit
changes one count by one, so the Manhattan distance of two count vectors never exceeds the number
of differing bits: a range join over count vectors misses no link.

The range join uses grids. The 32 counts are dealt into six bands; vectors within Manhattan
distance 3 differ in three bands at most and agree on the other three, so each fingerprint goes to
one cell per choice of three bands (20 cells), and only fingerprints of one cell are compared:
first by Manhattan distance, then exactly by differing bits.

Writing each count in unary (0, 1, 2 as 00, 01, 11) turns the count vector into 64 bits whose
differing bits add up to the Manhattan distance, and a band into a mask.

Exact copies are one fingerprint before the join. A cell sends on a spanning forest of its links,
never all pairs; a cell with more than ``CROWDED`` fingerprints is dealt out again by grids over
other segments, so no task holds an unbounded cell. The components are found by star joins.

Null, empty and wordless texts have fingerprint zero and are linked like any other. Repeated rows
give repeated rows. A null id is never the smallest of its component unless all are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.common import map_texts, spare, staged, text_buffer
from bazaarlens.llm.components import connected_components

SHINGLE = 3
THRESHOLD = 3
BANDS = 6
CROWDED = 16_384
SHORT_RUN = 8
SEED = 42
_PIECE = 1 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = b" \t\n\x0b\x0c\r"
_EVEN = 0x5555555555555555
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


# ---------------------------------------------------------------- fingerprints

def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """Words of ``text`` in bounded lists; each list begins with the last words of the one
    before, so that every shingle is whole in exactly one list."""
    start, held = 0, []
    while start < len(text):
        stop = start + _PIECE
        while stop < len(text) and text[stop] not in _SPACE:
            stop += 1
        held = held[-(SHINGLE - 1) :] + text[start:stop].split()
        start = stop
        if len(held) >= SHINGLE or start >= len(text):
            yield held


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits, highest first."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes) -> int:
    """Unsigned SimHash of one text."""
    counts, total = np.zeros(64, np.int64), 0
    for words in _pieces(text.translate(_LOWER)):
        if len(words) >= SHINGLE:
            grams = zip(*(words[i:] for i in range(SHINGLE)), strict=False)
        elif words and not total:
            grams = [words]
        else:
            continue
        hashes = np.fromiter(map(_hash, map(b" ".join, grams)), np.uint64)
        counts += _bit_counts(hashes)
        total += len(hashes)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big") if total else 0


def fingerprints(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys`` and the fingerprint ``fp`` of every text as a signed long."""

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        data, ends = text_buffer(batch.column(batch.num_columns - 1))
        raw = data.tobytes()
        values = [
            fingerprint(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)
        ]
        fp = pa.array(np.array(values, np.uint64).view(np.int64))
        return [*batch.columns[:-1], fp]

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "fp bigint"])
    return map_texts(docs, [*keys, text_col], schema, work)


# ------------------------------------------------------------------- range join

def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def rotated(fp: Column, level: int) -> Column:
    """The fingerprint with its bits rotated, so that other bits share a segment."""
    if not level:
        return fp
    return F.shiftleft(fp, level).bitwiseOR(F.shiftrightunsigned(fp, 64 - level))


def unary_counts(fp: Column) -> Column:
    """Counts of the two-bit segments in unary: low bit set from 1 on, high bit set at 2."""
    even = F.lit(_EVEN)
    high = F.shiftrightunsigned(fp, 1)
    low = fp.bitwiseOR(high).bitwiseAND(even)
    return low.bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(even), 1))


def band_masks(bands: int, keep: int, level: int = 0) -> list[int]:
    """A mask per choice of ``keep`` of the bands; odd levels deal the segments out round-robin."""
    band_of = (lambda s: s % bands) if level % 2 else (lambda s: s * bands // 32)
    return [
        _signed(sum(3 << (2 * s) for s in range(32) if band_of(s) in chosen))
        for chosen in combinations(range(bands), keep)
    ]


def _cells(rows: DataFrame, threshold: int, bands: int, level: int) -> DataFrame:
    """One row per fingerprint and grid: ``cell`` (within the cell it comes from) and ``fp``."""
    counts = unary_counts(rotated(F.col("fp"), level))
    masks = band_masks(bands, bands - threshold, level)
    parts = F.posexplode(F.array(*[counts.bitwiseAND(F.lit(m).cast("long")) for m in masks]))
    inside = [c for c in rows.columns if c != "fp"]
    return rows.select(*inside, "fp", parts.alias("_grid", "_part")).select(
        F.xxhash64(*inside, "_grid", "_part").alias("cell"), "fp"
    )


def _unary(fps: np.ndarray) -> np.ndarray:
    high = fps >> np.uint64(1)
    even = np.uint64(_EVEN)
    return ((fps | high) & even) | ((fps & high & even) << np.uint64(1))


def _near(fps, counts, i, j, threshold: int) -> np.ndarray:
    """Which pairs link: Manhattan distance of the counts first, then differing bits."""
    close = np.bitwise_count(counts[i] ^ counts[j]) <= threshold
    close[close] = np.bitwise_count((fps[i] ^ fps[j])[close]) <= threshold
    return close


def short_links(cells: np.ndarray, fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """All links inside runs of equal cells, comparing each row with those a step behind it."""
    counts, at = _unary(fps), np.arange(len(fps))
    a, b = [], []
    step = 1
    while len(at):
        at = at[at + step < len(fps)]
        at = at[cells[at] == cells[at + step]]
        near = at[_near(fps, counts, at, at + step, threshold)]
        a.append(fps[near])
        b.append(fps[near + step])
        step += 1
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def long_links(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of one crowded run: each fingerprint meets only those that
    no earlier one has reached."""
    counts, left = _unary(fps), np.arange(len(fps))
    a, b = [], []
    while len(left):
        waiting, left = [left[0]], left[1:]
        while waiting and len(left):
            i = waiting.pop()
            near = _near(fps, counts, np.full(len(left), i), left, threshold)
            if near.any():
                found, left = left[near], left[~near]
                a.append(np.full(len(found), fps[i]))
                b.append(fps[found])
                waiting.extend(found.tolist())
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def _linked(threshold: int, crowded: int | None):
    """Task over rows sorted by cell: links (a, b), and rows of crowded cells (cell, a)."""

    def out(a, b, cell=None) -> pa.RecordBatch:
        cells = pa.nulls(len(a), pa.int64()) if cell is None else pa.array(np.full(len(a), cell))
        b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays(
            [cells, pa.array(a.view(np.int64)), b], names=["cell", "a", "b"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        over = None  # the crowded cell that is being passed on
        for last, batch in _marked_last(batches):
            if batch is not None:
                cells = np.concatenate([cells, batch.column(0).to_numpy()])
                fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            if over is not None:
                n = int(np.searchsorted(cells, over, "right")) if len(cells) else 0
                if n:
                    yield out(fps[:n], None, over)
                    cells, fps = cells[n:], fps[n:]
                if len(cells):
                    over = None
            if not len(cells):
                continue
            starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(cells)])))
            whole = len(starts) if last else len(starts) - 1
            short = np.repeat(sizes <= SHORT_RUN, sizes)
            short[starts[whole] if whole < len(starts) else len(cells) :] = False
            a, b = short_links(cells[short], fps[short], threshold)
            if len(a):
                yield out(a, b)
            for k in np.flatnonzero(sizes[:whole] > SHORT_RUN):
                rows = fps[starts[k] : starts[k] + sizes[k]]
                if crowded is not None and len(rows) > crowded:
                    yield out(rows, None, cells[starts[k]])
                else:
                    a, b = long_links(rows, threshold)
                    if len(a):
                        yield out(a, b)
            rest = starts[whole] if whole < len(starts) else len(cells)
            cells, fps = cells[rest:], fps[rest:]
            if crowded is not None and len(cells) > crowded:
                over = cells[0]
                yield out(fps, None, over)
                cells, fps = cells[:0], fps[:0]

    return run


def _marked_last(batches: Iterator[pa.RecordBatch]):
    """(False, batch) for every batch, then (True, None)."""
    for batch in batches:
        yield False, batch
    yield True, None


def near_links(
    distinct: DataFrame, threshold: int = THRESHOLD, bands: int = BANDS,
    crowded: int = CROWDED, levels: int = 3,
) -> DataFrame:
    """Links ``a, b`` that connect all of ``distinct`` (fp) within ``threshold`` bits.

    Crowded cells are dealt out again up to ``levels`` times; the last level compares whatever
    is still together.
    """
    links, rows = None, distinct.select("fp")
    for level in range(levels):
        final = level == levels - 1
        cells = _cells(rows, threshold, bands, level)
        found = staged(
            cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(
                _linked(threshold, None if final else crowded), "cell bigint, a bigint, b bigint"
            ),
            "links",
        )
        own = found.where("b IS NOT NULL").select("a", "b")
        links = own if links is None else links.unionByName(own)
        rows = found.where("b IS NULL").select("cell", F.col("a").alias("fp"))
        if final or rows.isEmpty():
            return links
    return links


# -------------------------------------------------------------------- documents

def _classes(prints: DataFrame, id_col: str, threshold: int) -> DataFrame:
    """``fp, component_id`` of every distinct fingerprint of ``prints`` (id_col, fp)."""
    groups = prints.groupBy("fp").agg(F.min(id_col).alias("_first"))
    roots = staged(connected_components(near_links(groups, threshold)), "roots")
    named = groups.join(roots, groups["fp"] == roots["node"], "left").select(
        groups["fp"], "_first", F.coalesce("root", "fp").alias("root")
    )
    least = (
        roots.join(groups, roots["node"] == groups["fp"])
        .groupBy("root").agg(F.min("_first").alias("_least"))
    )
    return named.join(least, "root", "left").select(
        "fp", F.coalesce("_least", "_first").alias("component_id")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD
) -> DataFrame:
    """Per document ``id_col, fingerprint, component_id``."""
    prints = staged(fingerprints(docs, [id_col], text_col), "fingerprints")
    classes = _classes(prints, id_col, threshold)
    return prints.join(classes, "fp").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_per_group(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD
) -> DataFrame:
    """The rows of ``docs``, one of each near-duplicate component: that with the smallest id
    (of rows with one id, that with the smallest row hash; of equal rows, one)."""
    own, kept_id, kept_row = spare(docs, "_row", "_kept", "_kept_row")
    keyed = docs.select("*", F.xxhash64(*[F.col(c) for c in docs.columns]).alias(own))
    narrow = keyed.select(
        F.col(id_col).alias("id"), F.col(own).alias("row"), F.col(text_col).alias("text")
    )
    prints = staged(fingerprints(narrow, ["id", "row"]), "fingerprints")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    groups = staged(prints.groupBy("fp").agg(F.min(rank).alias("best")), "groups")
    roots = staged(connected_components(near_links(groups, threshold)), "roots")
    best = (
        groups.join(roots, groups["fp"] == roots["node"], "left")
        .groupBy(F.coalesce("root", "fp")).agg(F.min("best").alias("best"))
    )
    kept = best.select(F.col("best.id").alias(kept_id), F.col("best.row").alias(kept_row))
    same = F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_row))
    chosen = keyed.join(kept, same, "left_semi")
    repeated = prints.groupBy("id", "row").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():
        chosen = chosen.dropDuplicates([id_col, own])
    return chosen.select(*docs.columns)
