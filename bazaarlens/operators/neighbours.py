"""Near-duplicate images by Hamming distance of 64-bit hashes.

Split into ``b`` blocks, two hashes that differ in at most ``t`` bits agree on
at least ``b - t`` whole blocks. Every choice of ``b - t`` blocks gives one
signature; equal signatures are the only candidates, so the similarity join is
a grouping by signature. Exact copies are reduced to one row per distinct hash first.

A task compares the hashes of its buckets in id order and sends on one row per hash at most: its
smallest earlier neighbour. Short buckets are compared together, each row with the row a step before
it, whole columns at a time; in long ones a hash leaves the comparison once it has a neighbour, so
dense buckets are quick and no pairs are listed. A bucket of more than ``crowded`` hashes is dealt
out again by signatures over another division of the bits, up to ``LEVELS`` times. Hashes that are
still together then agree on the chosen blocks of every division; with the default blocks that
leaves them about ten bits to differ in, so what the last level compares is small.

``near_duplicates`` names the smallest earlier neighbour of every image. ``keep_first`` goes through
the images as a loop would that keeps an image unless an image it has kept is near, by rounds over
all undecided ones: who has no earlier undecided neighbour is kept, whoever is near it is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.images import hamming
from bazaarlens.operators.joins import HOT_PARTS, salted_join
from bazaarlens.session import written

BITS = 64
CROWDED = 50_000
SHORT = 64  # buckets up to this size are compared together
STRIDES = (1, 23, 11, 37)  # odd: each deals the bits out to the blocks in another order
LEVELS = len(STRIDES)


def _masks(threshold: int, keep: int, level: int) -> list[int]:
    """One mask per choice of ``keep`` out of ``threshold + keep`` bit blocks."""
    blocks = threshold + keep

    def block_of(i: int) -> int:
        return i * STRIDES[level] % BITS * blocks // BITS

    out = []
    for chosen in combinations(range(blocks), keep):
        mask = sum(1 << i for i in range(BITS) if block_of(i) in chosen)
        out.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return out


def _signatures(code: Column, masks: list[int]) -> Column:
    return F.posexplode(F.array(*[code.bitwiseAND(F.lit(m).cast("long")) for m in masks]))


def earlier_neighbours(hashes: np.ndarray, anchor: np.ndarray, threshold: int) -> np.ndarray:
    """For rows in id order, the position of the first earlier anchor within the threshold, or -1."""
    out = np.full(len(hashes), -1)
    left = np.arange(1, len(hashes))
    for j in np.flatnonzero(anchor):
        left = left[left > j]
        if not len(left):
            break
        near = np.bitwise_count(hashes[left] ^ hashes[j]) <= threshold
        out[left[near]] = j
        left = left[~near]
    return out


def stepwise_neighbours(
    bucket: np.ndarray, hashes: np.ndarray, anchor: np.ndarray, threshold: int
) -> np.ndarray:
    """The same for many buckets at once, comparing every row with that a step before it."""
    out = np.full(len(hashes), -1)
    at, step = np.arange(len(hashes)), 1
    while True:
        at = at[at >= step]
        at = at[bucket[at] == bucket[at - step]]
        if not len(at):
            return out
        before = at - step
        near = anchor[before] & (np.bitwise_count(hashes[at] ^ hashes[before]) <= threshold)
        out[at[near]] = before[near]  # a longer step finds a smaller id
        step += 1


_FOUND = "bucket bigint, hash bigint, first_id bigint, anchor boolean, near_id bigint"


def _search(threshold: int, crowded: int | None):
    """Task over rows sorted by bucket and id: (hash, near_id) found, or rows of a crowded bucket
    with a NULL ``near_id``."""

    def rows(held, near) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*map(pa.array, held), near], names=["bucket", "hash", "first_id", "anchor", "near_id"]
        )

    def closed(held) -> Iterator[pa.RecordBatch]:
        bucket, hashes, ids, anchor = held
        if not len(bucket):
            return
        starts = np.flatnonzero(np.diff(bucket, prepend=~bucket[:1]))
        sizes = np.diff(np.append(starts, len(bucket)))
        codes = hashes.view(np.uint64)
        short = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SHORT), sizes))
        found = np.full(len(bucket), -1)
        near = stepwise_neighbours(bucket[short], codes[short], anchor[short], threshold)
        found[short[near >= 0]] = short[near[near >= 0]]
        for k in np.flatnonzero(sizes > SHORT):
            a, b = starts[k], starts[k] + sizes[k]
            near = earlier_neighbours(codes[a:b], anchor[a:b], threshold)
            found[a:b] = np.where(near >= 0, near + a, -1)
        hit = np.flatnonzero(found >= 0)
        if len(hit):
            yield rows([c[hit] for c in held], pa.array(ids[found[hit]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, over = None, None
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = new if held is None else [np.concatenate(c) for c in zip(held, new, strict=True)]
            if over is not None:
                n = int(np.searchsorted(held[0], over, "right"))
                if n:
                    yield rows([h[:n] for h in held], pa.nulls(n, pa.int64()))
                    held = [h[n:] for h in held]
                if not len(held[0]):
                    continue
                over = None
            if not len(held[0]):
                continue
            last = int(np.searchsorted(held[0], held[0][-1]))
            yield from closed([h[:last] for h in held])
            held = [h[last:] for h in held]
            if crowded is not None and len(held[0]) > crowded:
                over = held[0][0]
                yield rows(held, pa.nulls(len(held[0]), pa.int64()))
                held = [h[:0] for h in held]
        if held is not None:
            yield from closed(held)

    return run


def closest_earlier(
    distinct: DataFrame, threshold: int, keep: int, crowded: int = CROWDED
) -> DataFrame:
    """``hash, near_id``: for each distinct hash, the smallest earlier anchor within the threshold.

    ``distinct`` has one row per hash with its smallest image id ``first_id``, and ``anchor``: may
    it be the neighbour of another (without that column, all may).
    """
    anchor = F.col("anchor") if "anchor" in distinct.columns else F.lit(True)
    rows = distinct.select(
        "hash", F.col("first_id").cast("bigint").alias("first_id"), anchor.alias("anchor")
    )
    found = None
    for level in range(LEVELS):
        signatures = _signatures(F.col("hash"), _masks(threshold, keep, level))
        inside = [c for c in rows.columns if c == "bucket"]
        buckets = rows.select(*inside, "hash", "first_id", "anchor", signatures.alias("_s", "_v")).select(
            F.xxhash64(*inside, "_s", "_v").alias("bucket"), "hash", "first_id", "anchor"
        )
        last = level == LEVELS - 1
        out = buckets.repartition("bucket").sortWithinPartitions("bucket", "first_id").mapInArrow(
            _search(threshold, None if last else crowded), _FOUND
        )
        out = written(out, "neighbours")
        own = out.where("near_id IS NOT NULL").select("hash", "near_id")
        found = own if found is None else found.unionByName(own)
        rows = out.where("near_id IS NULL").select("bucket", "hash", "first_id", "anchor")
        if last or rows.isEmpty():
            break
    return found.groupBy("hash").agg(F.min("near_id").alias("near_id"))


def _distances(distinct: DataFrame, nearest: DataFrame) -> DataFrame:
    """``distinct`` with ``near_id`` and ``near_distance``, NULL where there is no neighbour."""
    other = distinct.select(F.col("hash").alias("_other"), F.col("first_id").alias("near_id"))
    far = hamming(F.col("hash"), F.col("_other")).alias("near_distance")
    near = nearest.join(other, "near_id").select("hash", "near_id", far)
    return distinct.join(near, "hash", "left")


def _groups(images: DataFrame) -> DataFrame:
    """Distinct hashes with their smallest image and number of images, written once."""
    groups = images.where("hash IS NOT NULL").groupBy("hash").agg(
        F.min("image_id").alias("first_id"), F.count("*").alias("_n")
    )
    return written(groups, "hashes")


def _spread(images: DataFrame, groups: DataFrame, known: DataFrame) -> DataFrame:
    """Every image with what is known of its hash."""
    total = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("t")).scalar()
    hot = groups.where(F.col("_n") * HOT_PARTS > total)
    return salted_join(images, known, ["hash"], ["image_id"], "left", hot=hot)


def kept_hashes(distinct: DataFrame, threshold: int, keep: int) -> DataFrame:
    """``distinct`` with ``anchor``: is it kept by a loop in id order that drops what is near a
    kept one. Each round decides at least every hash without an undecided earlier neighbour."""
    left, kept = distinct.select("hash", "first_id"), None
    while True:
        waiting = closest_earlier(left, threshold, keep).select("hash")
        marked = written(
            left.join(waiting.withColumn("_w", F.lit(True)), "hash", "left").select(
                "hash", "first_id", F.col("_w").isNull().alias("anchor")
            ), "round",
        )
        own = marked.where("anchor").select("hash")
        kept = own if kept is None else kept.unionByName(own)
        if marked.where("NOT anchor").isEmpty():
            break
        dropped = closest_earlier(marked, threshold, keep).select("hash")
        left = written(marked.where("NOT anchor").drop("anchor").join(dropped, "hash", "left_anti"), "left")
    return distinct.join(kept.withColumn("_k", F.lit(True)), "hash", "left").select(
        *distinct.columns, F.col("_k").isNotNull().alias("anchor")
    )


def keep_first(images: DataFrame, threshold: int = 5, keep: int = 3) -> DataFrame:
    """``image_id, hash, duplicate_of, distance``: every image that is near one kept before it names
    the smallest such; kept images, and images without a hash, have NULL.

    Input columns ``image_id, hash``. Duplicates never become anchors, so a chain of near images
    keeps every one that is far from all kept ones.
    """
    groups = _groups(images)
    distinct = written(kept_hashes(groups.select("hash", "first_id"), threshold, keep), "kept")
    nearest = closest_earlier(distinct, threshold, keep)
    known = _distances(distinct.drop("anchor"), nearest)
    rows = _spread(images, groups, known)
    # a kept hash has no earlier anchor near it; its later copies are duplicates of its first image
    copy = F.col("near_id").isNull() & (F.col("first_id") < F.col("image_id"))
    return rows.select(
        "image_id", "hash", F.when(copy, F.col("first_id")).otherwise(F.col("near_id")).alias("duplicate_of"),
        F.when(copy, F.lit(0)).otherwise(F.col("near_distance")).alias("distance"),
    )


def near_duplicates(images: DataFrame, threshold: int = 5, keep: int = 3) -> DataFrame:
    """Every image with the smallest earlier image id within ``threshold`` bits.

    Input columns ``image_id, hash``; ``duplicate_of`` and ``distance`` are NULL
    for originals. A larger ``keep`` makes buckets smaller and signatures more.
    """
    groups = _groups(images)
    distinct = groups.select("hash", "first_id")
    known = _distances(distinct, closest_earlier(distinct, threshold, keep))
    rows = _spread(images, groups, known)
    copy = F.when(
        F.col("first_id") < F.col("image_id"),
        F.struct(F.col("first_id").alias("id"), F.lit(0).alias("d")),
    )
    near = F.when(
        F.col("near_id").isNotNull(),
        F.struct(F.col("near_id").alias("id"), F.col("near_distance").alias("d")),
    )
    best = F.when(copy.isNull(), near).when(near.isNull(), copy).otherwise(F.least(copy, near))
    return rows.select(
        "image_id", "hash", best["id"].alias("duplicate_of"), best["d"].alias("distance")
    )
