"""Trailing-window measures and row history, split by time so no key is one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLOTS = 64


def trailing_counts(
    log: DataFrame,
    seconds: int,
    measures: dict[str, Column],
    keys: list[str] | None = None,
    time: str = "timestamp",
) -> DataFrame:
    """Sums of ``measures`` over ``(t - seconds, t]`` at every logged moment.

    The span is cut into 64 slots. With the running sum inside a slot, the trailing sum at t is
    that at t, plus the 64 slots before, less that at ``t - seconds`` (which lies exactly 64 slots
    earlier, so each moment also asks there). A task holds slots, never an hour of the whole log.
    """
    keys, names = keys or [], list(measures)
    span = seconds * 1_000_000
    width = span // SLOTS
    moments = log.groupBy(*keys, F.unix_micros(time).alias("_t")).agg(
        *[F.sum(c).alias(n) for n, c in measures.items()]
    )
    zero = F.lit(0)
    asked = F.inline(
        F.array(
            F.struct(F.lit(0).alias("_ago"), F.col("_t").alias("_at"), *names),
            F.struct(
                F.lit(1).alias("_ago"), (F.col("_t") - span).alias("_at"),
                *[zero.cast(moments.schema[n].dataType).alias(n) for n in names],
            ),
        )
    )
    slot = F.floor(F.col("_at") / width).alias("_slot")
    points = moments.select(*keys, "_t", asked).select("*", slot)
    inside = Window.partitionBy(*keys, "_slot").orderBy("_at").rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    running = points.select(*keys, "_t", "_ago", *[F.sum(n).over(inside).alias(n) for n in names])
    sides = running.groupBy(*keys, "_t").agg(
        *[F.sum(F.when(F.col("_ago") == 0, F.col(n)).otherwise(-F.col(n))).alias(n) for n in names]
    ).withColumn("_slot", F.floor(F.col("_t") / width))
    # One row per slot; each also serves as context of the next stretch of slots.
    totals = moments.groupBy(*keys, F.floor(F.col("_t") / width).alias("_slot")).agg(
        *[F.sum(n).alias(n) for n in names]
    )
    stretch = F.floor(F.col("_slot") / SLOTS)
    spread = totals.withColumn("_in", F.explode(F.array(stretch, stretch + 1)))
    before = Window.partitionBy(*keys, "_in").orderBy("_slot").rangeBetween(-SLOTS, -1)
    earlier = spread.select(
        *keys, "_slot", "_in", *[F.sum(n).over(before).alias(f"_{n}") for n in names]
    ).where(F.col("_in") == stretch).drop("_in")
    same = F.lit(True)
    earlier = earlier.withColumnsRenamed({k: f"_k_{k}" for k in keys} | {"_slot": "_s"})
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    joined = sides.join(earlier, same & (F.col("_slot") == F.col("_s")), "left")
    return joined.select(
        *keys, F.timestamp_micros("_t").alias(time),
        *[(F.col(n) + F.coalesce(F.col(f"_{n}"), zero)).alias(n) for n in names],
    )


def previous_values(
    df: DataFrame,
    key: str,
    order: list[str],
    values: list[str],
    time: str = "scraped_at",
    slot: str = "month",
) -> DataFrame:
    """Add ``prev_<value>`` of the preceding row of each key.

    Rows are ordered inside calendar slots; the first row of a slot takes the
    last values of the key's previous slot, found on one summary row per slot.
    """
    rows = df.withColumn("_slot", F.date_trunc(slot, time))
    carried = F.struct(*values)
    last = rows.groupBy(key, "_slot").agg(
        F.max_by(carried, F.struct(*order)).alias("_last"), F.count("*").alias("_n")
    )
    chain = Window.partitionBy(key).orderBy("_slot")
    before = last.select(key, "_slot", F.lag("_last").over(chain).alias("_before"))
    inside = Window.partitionBy(key, "_slot").orderBy(*order)
    joined = rows.withColumn("_inside", F.lag(carried).over(inside)).join(
        before.where("_before IS NOT NULL"), [key, "_slot"], "left"
    )
    previous = F.coalesce("_inside", "_before")
    return joined.select(*df.columns, *[previous[v].alias(f"prev_{v}") for v in values])


def price_history(df: DataFrame, key: str = "url") -> DataFrame:
    """Price change against the previous sighting and drop from the original price."""
    seen = previous_values(df, key, ["scraped_at", "listing_id"], ["price"])
    drop = F.col("original_price") - F.col("price")
    return seen.withColumns(
        {
            "price_change": F.col("price") - F.col("prev_price"),
            "price_drop": drop,
            "discount_percentage": F.when(
                F.col("original_price") > 0, drop * 100.0 / F.col("original_price")
            ),
        }
    )
