"""Latest-row and duplicate-group operators.

The latest row of a key is the first of a ranked window. Spark cuts such a window down to one row
per key and task before the shuffle, so a key of any size is safe and a wide row moves at most once.
Duplicate groups are reduced by partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.operators.joins import HOT_PARTS


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` values of each key; NULL orders lowest."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    return df.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def upsert(
    existing: DataFrame, incoming: DataFrame, order: tuple[str, ...] = ("scraped_at", "listing_id")
) -> DataFrame:
    """Insert-or-replace on both unique keys: latest per id, then latest per url.

    With equal times an incoming row wins over a stored one.
    """
    both = existing.withColumn("_new", F.lit(0)).unionByName(
        incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True
    )
    return kept_rows(both, order).drop("_new")


def kept_rows(both: DataFrame, order: tuple[str, ...] = ("scraped_at", "listing_id")) -> DataFrame:
    """What ``upsert`` keeps of stored (``_new`` 0) and incoming rows (``_new`` 1)."""
    rank = [order[0], "_new", *order[1:]]
    by_id = latest_per_key(both, ["listing_id"], [c for c in rank if c != "listing_id"])
    # a row without a url has no other to compete with
    own = by_id.withColumn("_own", F.when(F.col("url").isNull(), F.col("listing_id")))
    return latest_per_key(own, ["url", "_own"], rank).drop("_own")


def duplicate_rows(
    df: DataFrame, key: str = "url", row_id: str = "listing_id", parts: int = HOT_PARTS
) -> DataFrame:
    """Rows after the first of each repeated key, with the first id and group size.

    Keys are counted by a 64-bit code, and only rows whose code occurs again go on to have their keys
    compared. Rows of codes with more than 1/``parts`` of all rows are reduced before they move.
    """
    rows = df.where(F.col(key).isNotNull() & (F.col(key) != "")).select(
        F.xxhash64(key).alias("_code"), key, row_id
    )
    counts = rows.groupBy("_code").agg(F.count("*").alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("t")).scalar()
    crowded = F.col("_n") * parts > total
    found = {"duplicate_of": F.min(row_id), "group_size": F.count("*")}

    few = rows.join(counts.where((F.col("_n") > 1) & ~crowded), "_code", "left_semi")
    same = Window.partitionBy("_code", key)
    few = few.select(key, row_id, *[c.over(same).alias(n) for n, c in found.items()])
    hot = F.broadcast(counts.where(crowded & (F.col("_n") > 1)).select("_code"))
    many = rows.join(hot, "_code", "left_semi").select(key, row_id)
    firsts = many.groupBy(key).agg(*[c.alias(n) for n, c in found.items()])
    many = many.join(F.broadcast(firsts), key)
    return few.unionByName(many).where(F.col(row_id) != F.col("duplicate_of"))


def fresh_only(incoming: DataFrame, processed: DataFrame, key: str = "url") -> DataFrame:
    """Incoming rows whose key was not processed before."""
    return incoming.join(processed.select(key).distinct(), key, "left_anti")
