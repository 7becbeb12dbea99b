"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than 1/HOT_PARTS of the rows, so a hot-key
# list can never exceed HOT_PARTS entries and is always safe to broadcast.
HOT_PARTS = 200
SALTS = 64
# Ranges of time an interval join works in; bounds the rows a long interval is repeated in.
TIME_SLICES = 256


def hot_keys(rows: DataFrame, keys: list[str], parts: int = HOT_PARTS) -> DataFrame:
    """Keys holding more than 1/``parts`` of all rows: at most ``parts`` of them."""
    counts = rows.where(_all_set(keys)).groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("t")).scalar()
    return counts.where(F.col("_n") * parts > total).select(*keys)


def _all_set(keys: list[str]) -> Column:
    out = F.lit(True)
    for key in keys:
        out = out & F.col(key).isNotNull()
    return out


def salted_join(
    many: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    spread_by: list[str],
    how: str = "inner",
    hot: DataFrame | None = None,
    parts: int = HOT_PARTS,
    salts: int = SALTS,
) -> DataFrame:
    """Inner or left join whose hot ``many`` keys are spread over ``salts`` tasks.

    Rows of a hot key get a salt from ``spread_by``; only the lookup rows of hot
    keys are repeated per salt. Each ``many`` row meets each matching lookup row
    exactly once, whatever the keys look like.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left")
    hot = hot_keys(many, keys, parts) if hot is None else hot.select(*keys)
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    spread = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    left = (
        many.join(hot, keys, "left")
        .withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(0))
        .drop("_hot")
    )
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0))
    )
    right = lookup.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def join_children(
    listings: DataFrame,
    children: DataFrame,
    how: str = "inner",
    key: str = "listing_id",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Listings joined with their child rows (images, specifications).

    ``how`` is inner, left (keep all listings), right (keep all children) or
    full. Listings without children are found against the distinct child keys. The children are
    the left side, whose busy keys Spark splits while it runs; ``hot`` names keys to salt instead.
    """
    order = [key, *[c for c in listings.columns if c != key],
             *[c for c in children.columns if c != key]]
    child_side = "left" if how in ("right", "full") else "inner"
    if hot is None:
        matched = children.join(listings, key, child_side).select(*order)
    else:
        spread_by = [c for c in children.columns if c != key][:1]
        matched = salted_join(children, listings, [key], spread_by, child_side, hot).select(*order)
    if how in ("inner", "right"):
        return matched
    if how not in ("left", "full"):
        raise ValueError(f"unknown join type: {how}")
    alone = missing_from(listings, children, key)
    return matched.unionByName(alone, allowMissingColumns=True)


def missing_from(rows: DataFrame, parents: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys have no parent; parent keys are reduced first."""
    return rows.join(parents.select(*keys).distinct(), list(keys), "left_anti")


def present_in(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return rows.join(parents.select(key).distinct(), key, "left_semi")


def time_borders(rows: DataFrame, time: str, slices: int) -> DataFrame:
    """One row: at most ``slices - 1`` ascending times (micros) that cut the rows into about equal parts.

    Equal borders are named once; rows without a time do not count; without any the list is NULL.
    """
    marks = [i / slices for i in range(1, slices)]
    cuts = F.percentile_approx(F.unix_micros(time), marks, max(10_000, 4 * slices))
    return rows.agg(F.array_sort(F.array_distinct(cuts)).alias("borders"))


def with_slice(rows: DataFrame, name: str, time: Column, borders: Column, slices: int) -> DataFrame:
    """Add the number of borders that are not later than ``time``, by binary search."""
    steps = [F.lit(1 << power) for power in reversed(range(slices.bit_length()))]

    def further(place: Column, step: Column) -> Column:
        reached = F.get("_borders", place + step - 1) <= F.col("_micros")
        return F.when(reached, place + step).otherwise(place)

    timed = rows.withColumns({"_borders": borders, "_micros": F.unix_micros(time)})
    found = F.aggregate(F.array(*steps), F.lit(0), further)
    return timed.withColumn(name, found).drop("_borders", "_micros")


def session_join(
    listings: DataFrame,
    sessions: DataFrame,
    as_of: datetime,
    how: str = "inner",
    time: str = "scraped_at",
    session_columns: list[str] | None = None,
    slices: int = TIME_SLICES,
) -> DataFrame:
    """Listings joined with the sessions running at their collection time.

    Open sessions end at ``as_of``. Time is cut into ``slices`` ranges in which about equally many
    sessions start, so only the small table is read for it. A listing lies in one range, a session in that of its start and in each at whose
    border it is still open, so it costs at most ``slices`` rows however long it runs. Ranges meet
    by equality, the times are compared inside the join, which keeps unmatched listings itself.
    Listings of a busy range are split by Spark while it runs.
    """
    if how not in ("inner", "left", "right", "full"):
        raise ValueError(f"unknown join type: {how}")
    end = F.coalesce("completed_at", F.lit(as_of).cast("timestamp"))
    columns = session_columns or sessions.columns
    borders = time_borders(sessions, "started_at", slices).scalar()
    spans = sessions.withColumn("_end", end).where("_end >= started_at")
    spans = with_slice(spans, "_first", F.col("started_at"), borders, slices)
    spans = with_slice(spans, "_last", F.col("_end"), borders, slices)
    open_in = spans.select(
        *columns, F.col("started_at").alias("_from"), "_end",
        F.explode(F.sequence("_first", "_last")).alias("_open"),
    )
    rows = with_slice(listings, "_slice", F.col(time), borders, slices)
    same = (F.col("_slice") == F.col("_open")) & F.col(time).between(F.col("_from"), F.col("_end"))
    left = "left" if how in ("left", "full") else "inner"
    out = rows.join(open_in, same, left).drop("_slice", "_open", "_from", "_end")
    if how in ("right", "full"):
        met = out.where("session_id IS NOT NULL") if left == "left" else out
        alone = missing_from(sessions.select(*columns), met, "session_id")
        out = out.unionByName(alone, allowMissingColumns=True)
    return out


def fk_violations(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None):
    """Child rows with a set key that no parent row has."""
    parents = parent.select(F.col(parent_key or key).alias(key))
    return missing_from(child.where(F.col(key).isNotNull()), parents, key)
