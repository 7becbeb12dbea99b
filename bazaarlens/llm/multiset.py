"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions only.

Every paragraph (line with a visible character) is hashed to a wide vector and a text's fingerprint
is the sum of the vectors of its paragraphs, lane by lane modulo a power of two. The order of
paragraphs does not matter, and adding or subtracting a vector inserts or deletes a paragraph.

A vector has two parts:

* 16 lanes modulo 2^32, the sixteen words of the paragraph's SHA-512: equal sums mean equal
  multisets,
* 96 lanes modulo 2^16 that count the paragraph's pairs of neighbouring words by hash: the
  correlation of two such parts estimates how much of the wording two texts share.

The query also needs each document's successor in descending order of ids. Rows are cut into cells
at the keys (id and text hash) of rows picked by a hash, so cells hold about equally many rows
wherever the ids lie. Each cell begins with such a row, which is copied to the cell before it: a
window per cell sees every successor and texts are shuffled once. Sums and likenesses keep that
partitioning.

Ids are integers or strings; other types are an error. Null texts are empty; texts without
paragraphs have fingerprint zero. Of equal ids the row with the smaller text hash comes first; null
ids come last. A single row is its own successor. Repeated rows give repeated rows; other columns
are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EQUAL_LANES = 16
COUNT_LANES = 96
CELL_ROWS = 32
MAX_CELLS = 16_384
_LOW32 = 0xFFFFFFFF
_SPACE = r"[\x20\x09-\x0D]+"


# ----------------------------------------------------------------- fingerprints

def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda p: p.rlike(r"[^\x20\x09-\x0D]"))


def words(paragraph: Column) -> Column:
    return F.filter(F.split(paragraph, _SPACE), lambda w: w != "")


def _features(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """A row per word of every paragraph: ``_at`` its position, ``_digest`` its paragraph's
    digest and ``_pair`` the hash of it and its successor; a row of nulls where a text has none."""
    lines = rows.select(*keys, F.explode_outer(paragraphs(F.col(text))).alias("_line"))
    split = lines.select(
        *keys, F.sha2("_line", 512).alias("_digest"), words(F.col("_line")).alias("_w")
    )
    pairs = F.arrays_zip(
        F.col("_w").alias("a"), F.slice("_w", 2, F.greatest(F.size("_w"), F.lit(1))).alias("b")
    )
    pair = F.when(F.col("_at").isNotNull(), F.xxhash64("_p.a", "_p.b"))
    return split.select(*keys, "_digest", F.posexplode_outer(pairs).alias("_at", "_p")).select(
        *keys, "_digest", "_at", pair.alias("_pair")
    )


def _sums() -> list[Column]:
    """Lane sums over feature rows; two lanes of 32 bits share a long. The digest of a paragraph
    counts at its first word."""
    out = []
    for i in range(EQUAL_LANES):
        lane = F.conv(F.substring("_digest", 8 * i + 1, 8), 16, 10).cast("bigint")
        out.append(F.sum(F.when(F.col("_at") == 0, lane)).alias(f"_e{i}"))
    for i in range(COUNT_LANES // 2):
        step = F.when(F.col("_half") == 0, F.lit(1)).otherwise(F.lit(1 << 32)).cast("long")
        out.append(F.sum(F.when(F.col("_slot") == i, step)).alias(f"_c{i}"))
    return out


def fingerprinted(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and ``equal`` (lanes modulo 2^32), ``counts`` (lanes modulo 2^16) of every text.

    ``keys`` must tell rows apart. Grouping reuses a partitioning by some of the keys.
    """
    lane = F.pmod("_pair", F.lit(COUNT_LANES)).cast("int")
    features = _features(rows, keys, text).select(
        *keys, "_digest", "_at", (lane / 2).cast("int").alias("_slot"),
        (lane % 2).alias("_half"),
    )
    # texts without a word have a row of nulls, whose sums are null
    sums = features.groupBy(*keys).agg(*_sums())
    zero = F.lit(0).cast("long")
    equal = [
        F.coalesce(F.col(f"_e{i}"), zero).bitwiseAND(F.lit(_LOW32)) for i in range(EQUAL_LANES)
    ]
    counts = []
    for i in range(COUNT_LANES // 2):
        both = F.coalesce(F.col(f"_c{i}"), zero)
        counts += [
            both.bitwiseAND(F.lit(0xFFFF).cast("long")),
            F.shiftrightunsigned(both, 32).bitwiseAND(F.lit(0xFFFF).cast("long")),
        ]
    return sums.select(*keys, F.array(*equal).alias("equal"), F.array(*counts).alias("counts"))


def as_text(equal: Column, counts: Column) -> Column:
    """A fingerprint as 512 lower-case hexadecimal digits."""
    digits = F.concat(
        F.transform(equal, lambda v: F.lpad(F.hex(v), 8, "0")),
        F.transform(counts, lambda v: F.lpad(F.hex(v), 4, "0")),
    )
    return F.lower(F.array_join(digits, ""))


def combined(a: Column, b: Column, sign: int, bits: int) -> Column:
    """Lanes of a text after inserting (1) or deleting (-1) the paragraphs summed in ``b``."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + sign * y, F.lit(1 << bits)))


def likeness(equal_a: Column, counts_a: Column, equal_b: Column, counts_b: Column) -> Column:
    """1 for equal fingerprints, else the correlation of the count lanes, 0 at least."""
    def total(lanes: Column) -> Column:
        return F.aggregate(lanes, F.lit(0).cast("long"), lambda s, v: s + v)

    def dot(x: Column, y: Column) -> Column:
        return total(F.zip_with(x, y, lambda p, q: p * q))

    n = F.lit(COUNT_LANES).cast("double")
    sum_a, sum_b = total(counts_a).cast("double"), total(counts_b).cast("double")
    joint = n * dot(counts_a, counts_b) - sum_a * sum_b
    spread = (n * dot(counts_a, counts_a) - sum_a * sum_a) * (
        n * dot(counts_b, counts_b) - sum_b * sum_b
    )
    shared = F.when(spread > 0, joint / F.sqrt(spread)).otherwise(F.lit(0.0))
    return F.when((equal_a == equal_b) & (counts_a == counts_b), F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), shared))
    )


# -------------------------------------------------------------------- successors

def _key(id_col: str, text_col: str, kind: str) -> Column:
    """What rows are ordered by. Larger keys come first: ids downwards, nulls (the smallest) last,
    of equal ids the smaller text hash first."""
    return F.struct(
        F.col(id_col).cast(kind).alias("id"),
        F.bitwise_not(F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).alias("h"),
    )


def in_cells(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows ``_id, _text`` by ``_cell``; with ``_copy`` set, the first row of the next cell.

    The keys that cells begin with are picked by a hash of the key, about ``MAX_CELLS`` of them at
    most, so their list may be part of the plan.
    """
    own = dict(docs.dtypes)[id_col]
    if own not in ("tinyint", "smallint", "int", "bigint", "string"):
        raise TypeError(f"ids must be integers or strings, not {own}")
    kind = "string" if own == "string" else "bigint"
    key = _key(id_col, text_col, kind)
    keys = docs.select(key.alias("_key"))
    rows = keys.count()
    cells = max(1, min(MAX_CELLS, rows // CELL_ROWS))
    share = F.lit(-(-(1 << 32) * cells // max(rows, 1)))
    picked = F.shiftrightunsigned(F.xxhash64("_key.id", "_key.h"), 32) < share
    top, cuts = keys.agg(
        F.to_json(F.max("_key")), F.to_json(F.sort_array(F.collect_set(F.when(picked, F.col("_key")))))
    ).first()
    texts = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        key.alias("_key"),
    )
    if top is None:
        return texts.select("_id", "_text", F.lit(0).alias("_cell"), F.lit(False).alias("_copy"))
    ends = json.loads(cuts)
    if not ends or ends[-1] != json.loads(top):
        ends.append(json.loads(top))
    # a cell ends at its largest key; two steps of a square root each find it
    side = math.isqrt(len(ends)) + 1
    blocks = [ends[i : i + side] for i in range(0, len(ends), side)]
    shape = f"struct<id:{kind},h:bigint>"
    tops = F.from_json(F.lit(json.dumps([b[-1] for b in blocks])), f"array<{shape}>")
    inner = F.from_json(F.lit(json.dumps(blocks)), f"array<array<{shape}>>")

    def below(cuts: Column) -> Column:
        return F.size(F.filter(cuts, lambda c: c < F.col("_key")))

    placed = texts.withColumn("_block", below(tops))
    placed = placed.withColumn("_cuts", F.element_at(inner, F.col("_block") + 1))
    placed = placed.withColumn("_place", below(F.col("_cuts")))
    cell = F.col("_block") * side + F.col("_place")
    first = F.element_at("_cuts", F.col("_place") + 1) == F.col("_key")
    before = F.when(cell == len(ends) - 1, F.lit(0)).otherwise(cell + 1)
    itself = F.struct(cell.alias("_cell"), F.lit(False).alias("_copy"))
    copied = F.struct(before.alias("_cell"), F.lit(True).alias("_copy"))
    places = F.when(first, F.array(itself, copied)).otherwise(F.array(itself))
    return placed.select("_id", "_text", F.inline(places))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``: its fingerprint, that of a text whose second half is replaced by
    the beginning of the next document, and the likenesses to that text and to that document."""
    order = Window.partitionBy("_cell").orderBy(
        "_copy", F.desc_nulls_last("_id"), F.xxhash64("_text")
    )
    rows = in_cells(docs, id_col, text_col).select(
        "_cell", "_copy", "_id", "_text", F.char_length("_text").alias("_n"),
        F.row_number().over(order).alias("_row"), F.lead("_text").over(order).alias("_next"),
    )
    half = F.floor(F.col("_n") / 2).cast("int")
    edited = F.concat(
        F.substring("_text", F.lit(1), F.col("_n") - half), F.substring("_next", F.lit(1), half)
    )
    own = F.struct(F.lit(0).alias("_kind"), F.col("_text").alias("_body"))
    changed = F.struct(F.lit(1).alias("_kind"), F.col("_edited").alias("_body"))
    bodies = F.when(F.col("_copy"), F.array(own)).otherwise(F.array(own, changed))
    versions = rows.withColumn("_edited", edited).select(
        "_cell", "_row", "_copy", "_id", "_n", F.inline(bodies)
    )
    versions = versions.withColumn("_sha", F.when(F.col("_kind") == 1, F.sha2("_body", 256)))
    keys = ["_cell", "_row", "_kind", "_copy", "_id", "_n", "_sha"]
    prints = fingerprinted(versions, keys, "_body")
    # in this order each document is followed by its edited text, then by the next document
    after = Window.partitionBy("_cell").orderBy("_row", "_kind")
    ahead = {
        f"_{name}{step}": F.lead(name, step).over(after)
        for name in ("equal", "counts") for step in (1, 2)
    } | {"_sha1": F.lead("_sha").over(after)}
    done = prints.select("*", *[c.alias(n) for n, c in ahead.items()]).where(
        "_kind = 0 AND NOT _copy"
    )
    col = F.col
    return done.select(
        col("_id").alias(id_col), col("_n").cast("bigint").alias("n_chars"),
        col("_sha1").alias("edited_sha256"),
        as_text(col("equal"), col("counts")).alias("fingerprint"),
        as_text(col("_equal1"), col("_counts1")).alias("edited_fingerprint"),
        likeness(col("equal"), col("counts"), col("_equal1"), col("_counts1")).alias("near_edited"),
        likeness(col("equal"), col("counts"), col("_equal2"), col("_counts2")).alias("near_next"),
    )
