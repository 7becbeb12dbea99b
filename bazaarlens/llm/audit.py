"""Filter interaction audit: what every order of five filters removes, per language.

A to D depend on a text alone: too few words, too few distinct words, too many capitals, a symbol
of markup. E says that a smaller id has the identical text anywhere in the table; it is decided on
full texts with radix tries:

1. A task reads its rows in runs of ``RUN_BYTES`` of text and puts each run into a compressed trie
   whose terminals hold the smallest id. It sends on each different text of a run once, with the
   number of its terminal; a row keeps only that number, so a text that fills a third of the corpus
   costs a task one row per run.
2. Prefixes of the texts sent on are counted; a prefix with too many bytes is cut again
   ``LONGER`` times as long, until each is small enough or at most one text. The texts are
   range-partitioned by these prefixes, so equal texts meet and neighbours share a trie.
3. Each partition inserts its texts into one trie and walks it: every terminal gives the smallest
   id to all numbers it holds. Rows join it by number and are duplicates if their id is larger.

Rows are then reduced to counts by part and 5-bit mask, from which all orders follow.

Null texts are empty texts; a null language is the part ``""``. A row without an id is no duplicate
and makes none; repeated rows with the smallest id are no duplicates of each other. A document is
good (toxic) if any of its rows of labels says 1; null labels and ids say nothing. Filters are
exact integer comparisons. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.common import slices, staged

FILTERS = "ABCDE"
LEAST_WORDS = 100
DISTINCT_PERCENT = 80
CAPITAL_PERCENT = 10
SYMBOLS = b"#$%&*|"
RUN_BYTES = 32 << 20  # text (code points) that one run of a task holds in its trie
RUN_ROWS = 1 << 18  # rows of one run, so of one number
PART_BYTES = 64 << 20  # text wanted in one partition's trie
LEAST_CUT = 256 << 10  # a prefix with less text than this is not cut
FIRST_PREFIX = 8
LONGER = 8
_LEAD = 64  # characters of a prefix that decide its range; the rest decides by hash
_CAPITALS = bytes(range(65, 91))


class Node:
    """A place in a compressed trie: children by first character, and what ends here."""

    __slots__ = ("kids", "least", "held")

    def __init__(self):
        self.kids: dict[str, tuple[str, Node]] = {}
        self.least: int | None = None
        self.held: list[int] | None = None  # None: no text ends here


def _shared(label: str, text: str, start: int) -> int:
    """Length of the common prefix of ``label`` and ``text[start:]``, by halving."""
    low, high = 0, min(len(label), len(text) - start)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[low:middle], start + low):
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """Compressed radix trie of full texts; each terminal has the smallest id of its text."""

    def __init__(self):
        self.root = Node()

    def insert(self, text: str, least: int | None) -> Node:
        """The terminal of ``text``, with ``least`` taken into its smallest id (null: no id)."""
        node, place = self.root, 0
        while place < len(text):
            edge = node.kids.get(text[place])
            if edge is None:
                leaf = Node()
                node.kids[text[place]] = (text[place:], leaf)
                node = leaf
                break
            label, child = edge
            if text.startswith(label, place):
                node, place = child, place + len(label)
                continue
            cut = _shared(label, text, place)
            middle = Node()
            node.kids[label[0]] = (label[:cut], middle)
            middle.kids[label[cut]] = (label[cut:], child)
            node, place = middle, place + cut
        if node.held is None:
            node.held = []
        if least is not None and (node.least is None or least < node.least):
            node.least = least
        return node

    def terminals(self) -> Iterator[tuple[str, Node]]:
        """Texts and their terminals, in no certain order."""
        rest = [("", self.root)]
        while rest:
            text, node = rest.pop()
            if node.held is not None:
                yield text, node
            rest += [(text + label, kid) for label, kid in node.kids.values()]

    def walk(self) -> Iterator[Node]:
        """The terminals alone."""
        rest = [self.root]
        while rest:
            node = rest.pop()
            if node.held is not None:
                yield node
            rest += [kid for _, kid in node.kids.values()]


def mask(text: str) -> int:
    """Bits of the filters A to D that ``text`` fails."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at exactly the six ASCII white-space characters
    few = len(words) < LEAST_WORDS
    poor = 100 * len(set(words)) < DISTINCT_PERCENT * len(words)
    loud = 100 * (len(data) - len(data.translate(None, _CAPITALS))) > CAPITAL_PERCENT * len(text)
    marked = len(data.translate(None, SYMBOLS)) < len(data)
    return few | poor << 1 | loud << 2 | marked << 3


_NAMES = ["_id", "part", "mask", "number", "text", "least"]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: a row per document (no text), and per run a row per different text (no document)."""
    number = TaskContext.get().partitionId() << 40
    trie, held, rows, kind = Trie(), 0, 0, pa.null()

    def flush() -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for text, node in trie.terminals():
            found.append((node.held[0], text, node.least))
            size += len(text)
            if size > 1 << 22:
                yield texts_of(found)
                found, size = [], 0
        if found:
            yield texts_of(found)

    def texts_of(found: list) -> pa.RecordBatch:
        own, texts, least = zip(*found, strict=True)
        none = [None] * len(found)
        types = [kind, pa.string(), pa.int32(), pa.int64(), pa.string(), kind]
        columns = [none, none, none, own, texts, least]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_NAMES
        )

    for batch in batches:
        kind = batch.column(0).type
        for piece in slices(batch, 2):
            masks, numbers = [], []
            ids = piece.column(0).to_pylist()
            rows += len(ids)
            for own, text in zip(ids, piece.column(2).to_pylist(), strict=True):
                node = trie.insert(text or "", own)
                if not node.held:  # its number and mask, found once per run
                    node.held = [number, mask(text or "")]
                    number += 1
                    held += len(text or "")
                numbers.append(node.held[0])
                masks.append(node.held[1])
            none = [None] * len(ids)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.array(masks, pa.int32()),
                 pa.array(numbers, pa.int64()), pa.array(none, pa.string()), pa.array(none, kind)],
                names=_NAMES,
            )
            if held > RUN_BYTES or rows > RUN_ROWS:
                yield from flush()
                trie, held, rows = Trie(), 0, 0
    yield from flush()


def _prefixes(texts: DataFrame) -> tuple[DataFrame, int]:
    """``texts`` with a column ``prefix``, cut long enough to hold little text, and the number of
    partitions that their bytes ask for."""
    size = F.octet_length("text").cast("bigint")
    level = FIRST_PREFIX
    texts = texts.withColumn("prefix", F.substring("text", 1, level))
    default = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = texts.agg(F.sum(size)).first()[0] or 0
    parts = max(default, total // PART_BYTES + 1)
    most = min(PART_BYTES // 4, max(LEAST_CUT, total // (2 * parts)))
    while True:
        # texts that all have one hash are copies: a longer prefix would not part them
        heavy = (
            texts.where(F.char_length("prefix") == level)
            .groupBy("prefix").agg(
                F.sum(size).alias("bytes"), F.min(F.xxhash64("text")).alias("low"),
                F.max(F.xxhash64("text")).alias("high"),
            )
            .where((F.col("bytes") > most) & (F.col("low") != F.col("high")))
            .select("prefix", F.lit(True).alias("cut"))
        )
        heavy = staged(heavy, "heavy-prefixes")
        if heavy.isEmpty():
            return texts, parts
        longer = F.when(F.col("cut"), F.substring("text", 1, level * LONGER))
        texts = texts.join(heavy, "prefix", "left").select(
            "number", "least", "text", F.coalesce(longer, "prefix").alias("prefix")
        )
        level *= LONGER


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: the smallest id of the text of every number in a range of texts."""
    trie, kind = Trie(), pa.null()
    for batch in batches:
        kind = batch.column(1).type
        for piece in slices(batch, 2):
            for number, least, text in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                trie.insert(text, least).held.append(number)
    found = [(number, node.least) for node in trie.walk() for number in node.held]
    for start in range(0, len(found), 100_000):
        numbers, least = zip(*found[start : start + 100_000], strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int64()), pa.array(least, kind)], names=["number", "least"]
        )


def marked(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """Per document ``_id, part, mask``: the five bits of the filters it fails."""
    kind = dict(docs.dtypes)[id_col]
    own = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.col(text_col).alias("text"),
    )
    runs = own.mapInArrow(
        _runs, f"_id {kind}, part string, mask int, number bigint, text string, least {kind}"
    )
    runs = staged(runs, "runs")
    texts = runs.where("text IS NOT NULL").select("number", "least", "text")
    texts, parts = _prefixes(texts)
    lead = F.substring("prefix", 1, _LEAD)
    ranged = texts.withColumn("lead", lead).withColumn("rest", F.xxhash64("prefix"))
    ranged = ranged.repartitionByRange(parts, "lead", "rest").select("number", "least", "text")
    least = ranged.mapInArrow(_tries, f"number bigint, least {kind}")
    rows = runs.where("text IS NULL").select("_id", "part", "mask", "number")
    copy = F.coalesce(F.col("_id") > F.col("least"), F.lit(False)).cast("int")
    return rows.join(least, "number").select(
        "_id", "part", F.col("mask").bitwiseOR(F.shiftleft(copy, 4)).alias("mask")
    )


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley``: a row per part, order of the filters and step."""

    def says(label: str) -> Column:
        return F.coalesce(F.max((F.col(label) == 1).cast("int")), F.lit(0)).alias(label)

    marks = (
        labels.where(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id")).agg(says("quality"), says("toxic"))
    )
    masks = marked(docs, id_col, text_col, part_col)
    counts = (
        masks.join(marks, "_id", "left").groupBy("part", "mask").agg(
            F.count("*").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"),
            F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"),
        )
    )
    width = 1 << len(FILTERS)

    def row(name: str) -> Column:
        """Counts of a part by mask."""
        own = [F.sum(F.when(F.col("mask") == m, F.col(name)).otherwise(0)) for m in range(width)]
        return F.array(*own).alias(name)

    return orders(counts.groupBy("part").agg(row("n"), row("good"), row("toxic")))


def orders(parts: DataFrame) -> DataFrame:
    """All orders and steps of ``parts`` (part, and arrays n, good, toxic of counts by mask)."""
    bit = {name: 1 << i for i, name in enumerate(FILTERS)}
    steps = [
        F.struct(
            F.lit("".join(order)).alias("filter_order"), F.lit(at + 1).alias("step"),
            F.lit(bit[name]).alias("own"), F.lit(sum(bit[f] for f in order[:at])).alias("before"),
        )
        for order in permutations(FILTERS) for at, name in enumerate(order)
    ]
    deep = parts.select("part", "n", "good", "toxic", F.inline(F.array(*steps)))
    # a document that fails p filters is removed by each of them in 120 / p orders
    orders_of = F.array(*[F.lit(120 // p) for p in range(1, len(FILTERS) + 1)])

    def total(counts: str, holds: Callable[[Column], Column], times: bool = False) -> Column:
        """Sum of the counts whose mask fulfils ``holds``, each times its orders if asked for."""

        def picked(count: Column, mask: Column) -> Column:
            ways = F.element_at(orders_of, F.greatest(F.bit_count(mask), F.lit(1)))
            return F.when(holds(mask), count * ways if times else count).otherwise(F.lit(0))

        return F.aggregate(F.transform(counts, picked), F.lit(0).cast("bigint"), lambda a, c: a + c)

    def fails(mask: Column) -> Column:
        return mask.bitwiseAND(F.col("own")) != 0

    def earlier(mask: Column) -> Column:
        return mask.bitwiseAND(F.col("before")) != 0

    def first(mask: Column) -> Column:
        return fails(mask) & ~earlier(mask)

    return deep.select(
        "part", "filter_order", "step",
        total("n", lambda m: ~fails(m) & ~earlier(m)).alias("kept"),
        total("n", first).alias("removed"),
        total("n", lambda m: fails(m) & earlier(m)).alias("redundant"),
        total("n", lambda m: m == F.col("own")).alias("unique_fails"),
        total("good", first).alias("good_lost"),
        total("toxic", first).alias("toxic_lost"),
        total("n", fails, times=True).alias("shapley"),
    )
