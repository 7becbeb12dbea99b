"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are maximal runs of ``0-9 a-z`` (``A-Z`` lower-cased) and non-ASCII characters. A pattern
is a window of ten consecutive words of a benchmark item; an item of fewer words is one pattern.
All patterns of one length form a group with

* a shift table: for the hashed pair of words that ends at the current position, how far the
  search may move because no pattern has that pair nearer to its end,
* suffix buckets: the patterns whose last pair has that hash, tried only where the shift is 0,
* a comparison of the words themselves, which alone decides.

A task searches many stretches of text side by side with numpy, each jumping by its own shifts.

Benchmark items are dealt by hash to shards of about ``SHARD_WORDS`` pattern words at most. Tasks
build the tables of each shard and write them to the shared folder; the driver only sees their
names. A search task has one table in memory at a time and goes through all of them for a run of
documents before it takes the next, so documents are read once whatever the size of the benchmark.

Null and empty texts have no words. Repeated items and windows count once per ``item_id``; a null
``item_id`` marks words and counts as the item ``null``. Repeated documents give repeated rows.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.common import keep_rows, map_texts, text_buffer
from bazaarlens.session import work_dir

WINDOW = 10
SHARD_WORDS = 2_000_000
RUN_BYTES, MANY_RUN_BYTES = 1 << 22, 1 << 25
_CHUNK = 1 << 20
_STRETCH = 512
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(_BASE, _CHUNK + 1)
_INVERSE = _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), _CHUNK + 1)


def _hash_bytes(word: bytes) -> int:
    value = 0
    for byte in reversed(word):
        value = (value * int(_BASE) + byte + 1) % (1 << 64)
    return value


def word_spans(low: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end bytes of all words; a row's end also ends a word."""
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = _WORD[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = ends[(ends > 0) & (ends < len(low))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(low: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash per word, from prefix sums over bounded chunks."""
    out = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        base = starts[done]
        until = int(np.searchsorted(stops, base + _CHUNK, "right"))
        if until == done:  # one word longer than a chunk
            out[done] = _hash_bytes(low[base : stops[done]].tobytes())
            done += 1
            continue
        part = low[base : stops[until - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(part)], out=sums[1:])
        a, b = starts[done:until] - base, stops[done:until] - base
        out[done:until] = (sums[b] - sums[a]) * _INVERSE[a]
        done = until
    return out


def item_words(text: str | None) -> list[bytes]:
    return _WORD_BYTES.findall((text or "").encode().translate(_LOWER.tobytes()))


def item_windows(words: list[bytes], window: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    if len(words) < window:
        return [tuple(words)]
    return list({tuple(words[i : i + window]) for i in range(len(words) - window + 1)})


@dataclass
class Group:
    """Patterns of one length with their tables."""

    length: int
    block: int
    bits: int
    shift: np.ndarray
    bucket: np.ndarray  # where the patterns of a suffix hash begin, by hash
    words: np.ndarray  # pattern rows of word hashes, in bucket order
    texts: list[bytes]
    owners: list[list[str]]

    @staticmethod
    def build(length: int, patterns: dict[tuple[bytes, ...], set[str]]) -> Group:
        texts = list(patterns)
        hashes = np.array([[_hash_bytes(w) for w in text] for text in texts], np.uint64)
        block = min(2, length)
        blocks = len(texts) * (length - block + 1)
        bits = min(24, max(12, int(blocks * 16).bit_length()))
        shift = np.full(1 << bits, length - block + 1, np.int8)
        for end in range(block - 1, length):
            keys = _block_hash(hashes, end, block, bits)
            np.minimum.at(shift, keys, np.int8(length - 1 - end))
        suffix = _block_hash(hashes, length - 1, block, bits)
        order = np.argsort(suffix, kind="stable")
        bucket = np.searchsorted(suffix[order], np.arange((1 << bits) + 1))
        return Group(
            length, block, bits, shift, bucket.astype(np.int32), hashes[order],
            [b" ".join(texts[i]) for i in order],
            [sorted(patterns[texts[i]]) for i in order],
        )


def _block_hash(words: np.ndarray, at, block: int, bits: int) -> np.ndarray:
    """Table slot of the block that ends at ``at``; ``words`` is one sequence or rows of them."""
    key = words[..., at]
    if block == 2:
        key = key ^ (words[..., at - 1] * _PAIR)
    return ((key * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def build_groups(items: list[tuple[object, str | None]], window: int = WINDOW) -> list[Group]:
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item_id, text in items:
        name = "null" if item_id is None else str(item_id)
        for pattern in item_windows(item_words(text), window):
            by_length.setdefault(len(pattern), {}).setdefault(pattern, set()).add(name)
    return [Group.build(n, patterns) for n, patterns in sorted(by_length.items())]


def _table_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [len(item_words(text.as_py())) for text in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n"])


def tables(
    benchmark: DataFrame, id_col: str, text_col: str, limit: int = SHARD_WORDS, window: int = WINDOW,
) -> list[str]:
    """Addresses of the written search tables of the benchmark, one per shard; none without words."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = items.select("text").mapInArrow(_table_sizes, "n bigint").agg(F.sum("n")).first()[0]
    if not total:
        return []
    # dealt by hash, a shard is unlikely to get twice its share
    total *= window
    shards = 1 if total <= limit else -(-2 * total // limit)

    def build(table: pa.Table) -> pa.Table:
        rows = zip(table["id"].to_pylist(), table["text"].to_pylist(), strict=True)
        groups = pickle.dumps(build_groups(list(rows), window))
        return pa.table({"shard": table["shard"][:1], "groups": pa.array([groups], pa.binary())})

    deal = F.pmod(F.xxhash64("id", "text"), F.lit(shards)).cast("int").alias("shard")
    built = items.select(deal, "id", "text").groupBy("shard").applyInArrow(build, "shard int, groups binary")
    path = work_dir(benchmark.sparkSession, "search-tables")
    built.repartition("shard").write.partitionBy("shard").parquet(path)
    stored = benchmark.sparkSession.read.parquet(path)
    return sorted(r[0] for r in stored.select("shard", F.input_file_name().alias("f")).select("f").distinct().collect())


class Tables:
    """The written tables, read one at a time; the last one read is kept, so a benchmark of one
    shard is read once by a task."""

    def __init__(self, addresses: list[str]):
        self.addresses = addresses
        self._held: tuple[str, list[list[Group]]] | None = None

    def __getstate__(self):
        return self.addresses

    def __setstate__(self, addresses):
        self.__init__(addresses)

    def __iter__(self) -> Iterator[list[Group]]:
        for address in self.addresses:
            if self._held is None or self._held[0] != address:
                self._held = None
                system, path = pafs.FileSystem.from_uri(address)
                with system.open_input_file(path) as file:
                    groups = pq.read_table(file, columns=["groups"])["groups"]
                self._held = address, [pickle.loads(g.as_py()) for g in groups]
            yield from self._held[1]


def _positions(group: Group, words: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Word positions where the shift is 0: the possible ends of an occurrence."""
    low = firsts[:-1] + group.length - 1
    counts = np.maximum(0, -(-(firsts[1:] - low) // _STRETCH))
    row = np.repeat(np.arange(len(low)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = low[row] + nth * _STRETCH
    until = np.minimum(at + _STRETCH, firsts[1:][row])
    found = []
    while len(at):
        move = group.shift[_block_hash(words, at, group.block, group.bits)]
        found.append(at[move == 0])
        at = at + np.maximum(move, 1)
        going = at < until
        at, until = at[going], until[going]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def find(
    group: Group, low: np.ndarray, starts: np.ndarray, stops: np.ndarray, words: np.ndarray,
    firsts: np.ndarray,
) -> list[tuple[int, int]]:
    """(last word position, pattern) of every occurrence."""
    at = _positions(group, words, firsts)
    if not len(at):
        return []
    slot = _block_hash(words, at, group.block, group.bits)
    begin, count = group.bucket[slot], group.bucket[slot + 1] - group.bucket[slot]
    pattern = np.repeat(begin, count) + (
        np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    )
    at = np.repeat(at, count)
    for back in range(group.length):
        same = words[at - back] == group.words[pattern, group.length - 1 - back]
        at, pattern = at[same], pattern[same]
    out = []
    for end, which in zip(at.tolist(), pattern.tolist(), strict=True):
        begin = end - group.length + 1
        text = b" ".join(low[starts[i] : stops[i]].tobytes() for i in range(begin, end + 1))
        if text == group.texts[which]:
            out.append((end, which))
    return out


@dataclass
class Marks:
    """Per row: its number of words, a mask over the words of all rows, items found."""

    firsts: np.ndarray
    hit: np.ndarray
    items: dict[int, set[str]]

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.firsts)

    @property
    def n_hit(self) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(self.hit)))
        return sums[self.firsts[1:]] - sums[self.firsts[:-1]]


def mark(tables: Iterable[list[Group]], column: pa.Array) -> Marks:
    """Search all rows of a text column for the patterns of all tables."""
    data, ends = text_buffer(column)
    low = _LOWER[data]
    starts, stops = word_spans(low, ends)
    words = word_hashes(low, starts, stops)
    firsts = np.searchsorted(starts, ends)
    edges = np.zeros(len(words) + 1, np.int64)
    items: dict[int, set[str]] = {}
    for groups in tables:
        for group in groups:
            hits = find(group, low, starts, stops, words, firsts)
            if not hits:
                continue
            last = np.array([end for end, _ in hits])
            np.add.at(edges, last - group.length + 1, 1)
            np.add.at(edges, last + 1, -1)
            rows = np.searchsorted(firsts, last, "right") - 1
            for row, (_, which) in zip(rows.tolist(), hits, strict=True):
                items.setdefault(row, set()).update(group.owners[which])
    return Marks(firsts, np.cumsum(edges)[:-1] > 0, items)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", shard_words: int = SHARD_WORDS,
    window: int = WINDOW,
) -> DataFrame:
    """Per document ``id_col, n_words, n_hit, n_items, items_sha256, contaminated``."""
    kind = dict(docs.dtypes)[id_col]
    held = Tables(tables(benchmark, item_col, item_text_col, shard_words, window))

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        marks = mark(held, batch.column(1))
        items = [sorted(marks.items.get(row, ())) for row in range(batch.num_rows)]
        return [
            batch.column(0),
            pa.array(marks.n_words, pa.int64()),
            pa.array(marks.n_hit, pa.int64()),
            pa.array([len(x) for x in items], pa.int64()),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]),
            pa.array(marks.n_hit > 0),
        ]

    return map_texts(
        docs, [id_col, text_col],
        f"{id_col} {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, "
        "contaminated boolean",
        work, _run_bytes(held),
    )


def _run_bytes(held: Tables) -> int:
    """Text that a task searches before it goes on to the next table: more where it has to reload."""
    return RUN_BYTES if len(held.addresses) < 2 else MANY_RUN_BYTES


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", shard_words: int = SHARD_WORDS, window: int = WINDOW,
) -> DataFrame:
    """Documents without any window of a benchmark item, with all their columns."""
    held = Tables(tables(benchmark, item_col, item_text_col, shard_words, window))
    return keep_rows(docs, text_col, lambda c: mark(held, c).n_hit == 0, _run_bytes(held))
