"""Centroid clustering on bit planes.

The components of a vector become integers ``floor(SCALE * x)``. Bit ``b`` of its ``WIDTH``
components is packed into one 64-bit word, the plane ``b`` (two's complement, so the last plane
counts negatively). The dot product of two vectors is then

    sum over planes a, b of weight(a) * weight(b) * popcount(A[a] & B[b])

which is exact, and so are the squared distances ``|x|^2 - 2 x.c + |c|^2``. The packed table is
written once and every round reads it: about nine words a vector instead of 64 numbers. A round
sends one row of sums per task and centroid, and only the centroids themselves, whose number is a
parameter, reach the driver.

Kept are rows whose vector has exactly ``WIDTH`` components, none null or non-finite; others are
left out. Integers beyond ``LIMIT`` in size are set to it, so that a distance fits a long. The first
centroids are the kept vectors with the smallest hash of their id (ties, such as repeated ids: by
the components; a null id hashes as empty text and is a cluster member like any other). With fewer
vectors than centroids every vector starts one. Of equally near centroids the smaller number wins;
an empty centroid stays where it is. A sum of distances beyond a long is null. Repeated rows are
assigned alike and all count; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.common import staged

WIDTH = 64
SCALE = 256
LIMIT = (1 << 27) - 1
CENTROIDS = 40
ROUNDS = 5
SEED = "2"
_STEP = 4_096  # vectors whose popcounts are held at once
_BITS = np.uint64(1) << np.arange(WIDTH, dtype=np.uint64)


def weights(planes: int) -> np.ndarray:
    """What a bit of each plane counts; the last one is the sign of two's complement."""
    out = np.int64(1) << np.arange(planes, dtype=np.int64)
    out[-1] = -out[-1]
    return out


def pack(values: np.ndarray, planes: int) -> np.ndarray:
    """Bit planes (vectors x planes) of an integer matrix (vectors x WIDTH)."""
    bits = values.astype(np.int64).astype(np.uint64)
    return np.stack(
        [(((bits >> np.uint64(b)) & np.uint64(1)) * _BITS).sum(1, dtype=np.uint64)
         for b in range(planes)], axis=1,
    ) if planes else np.zeros((len(values), 0), np.uint64)


def unpack(packed: np.ndarray) -> np.ndarray:
    """The integer matrix of some bit planes."""
    out = np.zeros((len(packed), WIDTH), np.int64)
    for b, weight in enumerate(weights(packed.shape[1])):
        out += weight * ((packed[:, b, None] & _BITS) != 0)
    return out


def dots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact dot products (left x right) of packed vectors by weighted AND-popcounts."""
    a, b = weights(left.shape[1]), weights(right.shape[1])
    out = np.zeros((len(left), len(right)), np.int64)
    for k, planes in enumerate(right):
        for j, plane in enumerate(planes):
            out[:, k] += b[j] * (np.bitwise_count(left & plane).astype(np.int64) @ a)
    return out


@dataclass
class Centroids:
    """The current centres as integers, packed for comparison."""

    values: np.ndarray
    planes: int

    def __post_init__(self):
        self.packed = pack(self.values, self.planes)
        self.norms = (self.values * self.values).sum(1)

    def nearest(self, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centre and the squared distance to it, per vector."""
        cluster = np.zeros(len(packed), np.int64)
        distance = np.zeros(len(packed), np.int64)
        for start in range(0, len(packed), _STEP):
            part = packed[start : start + _STEP]
            own = unpack(part)
            far = (own * own).sum(1)[:, None] + self.norms - 2 * dots(part, self.packed)
            best = far.argmin(1)
            cluster[start : start + _STEP] = best
            distance[start : start + _STEP] = far[np.arange(len(part)), best]
        return cluster, distance


def _planes_of(column: pa.Array, planes: int) -> np.ndarray:
    """Matrix of the packed planes of an Arrow list column."""
    return column.flatten().to_numpy().view(np.uint64).reshape(len(column), planes)


def _kept(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``_id, _v``: ids and integer components of the rows that count."""
    own = vectors.select(
        F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_x")
    )
    finite = F.forall(
        "_x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    bound = F.lit(float(LIMIT))
    # as doubles the bounds and whole numbers below them are exact, so clamping comes before the cast
    whole = F.transform(
        "_x", lambda x: F.greatest(F.least(x * SCALE, bound), -bound)
    )
    return own.where((F.size("_x") == WIDTH) & finite).select(
        "_id", F.transform(whole, lambda x: F.floor(x).cast("bigint")).alias("_v")
    )


def _first(kept: DataFrame, centroids: int, seed: str) -> np.ndarray:
    key = F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(key.alias("_h"), "_v").orderBy("_h", "_v").limit(centroids).collect()
    return np.array([r["_v"] for r in rows], np.int64).reshape(len(rows), WIDTH)


def pack_vectors(kept: DataFrame, planes: int) -> DataFrame:
    """``_id, _p``: ids and packed planes, written as a table."""
    kind = dict(kept.dtypes)["_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, WIDTH)
            words = pack(values, planes).view(np.int64)
            ends = pa.array(np.arange(len(words) + 1, dtype=np.int32) * planes)
            lists = pa.ListArray.from_arrays(ends, pa.array(words.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["_id", "_p"])

    return staged(kept.mapInArrow(run, f"_id {kind}, _p array<bigint>"), "planes")


def _sums(packed: DataFrame, centres: Centroids) -> list:
    """``cluster, n`` and component sums of the members of every non-empty cluster."""
    shared = packed.sparkSession.sparkContext.broadcast(centres)
    names = [f"s{i}" for i in range(WIDTH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Centroids = shared.value
        n = np.zeros(len(own.values), np.int64)
        sums = np.zeros((len(own.values), WIDTH), np.int64)
        for batch in batches:
            planes = _planes_of(batch.column(0), own.planes)
            cluster, _ = own.nearest(planes)
            n += np.bincount(cluster, minlength=len(n))
            np.add.at(sums, cluster, unpack(planes))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(n[used]), *[pa.array(sums[used, i]) for i in range(WIDTH)]],
            names=["cluster", "n", *names],
        )

    schema = ", ".join(f"{c} bigint" for c in ["cluster", "n", *names])
    parts = packed.select("_p").mapInArrow(run, schema)
    # a task's sum fits a long; the corpus's may not
    total = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ["n", *names]]
    return parts.groupBy("cluster").agg(*total).collect()


def moved(centres: np.ndarray, sums: list) -> np.ndarray:
    """Every centre that has members moved to the floor of their mean."""
    out = centres.copy()
    for row in sums:
        out[row["cluster"]] = [int(row[f"s{i}"]) // int(row["n"]) for i in range(WIDTH)]
    return out


def centroid_digest(values: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, values.tolist())).encode()).hexdigest()


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED,
) -> DataFrame:
    """Per kept vector ``id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256``."""
    kept = _kept(vectors, id_col, vector_col)
    spark, kind = vectors.sparkSession, dict(kept.dtypes)["_id"]
    ends = kept.agg(
        F.coalesce(F.min(F.array_min("_v")), F.lit(0)).alias("low"),
        F.coalesce(F.max(F.array_max("_v")), F.lit(0)).alias("high"),
    ).first()
    # centres are floors of means, so they need no more planes than the vectors
    planes = max(int(ends["low"]).bit_length(), int(ends["high"]).bit_length()) + 1
    packed = pack_vectors(kept, planes)
    values = _first(kept, centroids, seed)
    for _ in range(rounds if len(values) else 0):
        values = moved(values, _sums(packed, Centroids(values, planes)))
    shared = spark.sparkContext.broadcast(Centroids(values, planes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Centroids = shared.value
        for batch in batches:
            number, distance = own.nearest(_planes_of(batch.column(1), own.planes))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(number.astype(np.int32)), pa.array(distance)],
                names=["_id", "cluster", "distance"],
            )

    found = packed.mapInArrow(run, f"_id {kind}, cluster int, distance bigint")
    found = staged(found, "clusters")
    sizes = found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("_own")
    ).collect()  # one row per centroid
    own = {r["cluster"]: int(r["_own"]) for r in sizes}
    largest = (1 << 63) - 1

    def long(value: int) -> Column:
        return F.lit(value if value <= largest else None).cast("bigint")

    def by_cluster(value) -> Column:
        """``value(k)`` of the row's cluster."""
        known = range(len(values))
        return F.element_at(F.array(*[value(k) for k in known]), F.col("cluster") + 1) if known else value(0)

    return found.select(
        F.col("_id").alias(id_col), "cluster", "distance",
        by_cluster(lambda k: long(own.get(k, 0))).alias("cluster_inertia"),
        long(sum(own.values())).alias("inertia"),
        by_cluster(
            lambda k: F.lit(centroid_digest(values[k]) if len(values) else "")
        ).alias("centroid_sha256"),
    )
