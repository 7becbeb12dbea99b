"""Parquet laid out for selective reads: few files and row groups hold what a search asks for.

Inside each category rows follow a space-filling curve over price and time, so that a range of
either touches a part of the files, and ids and addresses carry Bloom filters for single look-ups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.session import release

LANDED_GROUP = 8 << 20  # bytes of a row group of landed pages, before compression
BITS = 6  # each value is ranked into 2^BITS ranges of about equally many rows


def _borders(df: DataFrame, value: Column, bits: int) -> DataFrame:
    """One row with the ascending values that cut the rows into at most ``2^bits`` ranges."""
    marks = [i / (1 << bits) for i in range(1, 1 << bits)]
    return df.agg(F.array_sort(F.array_distinct(F.percentile_approx(value, marks))).alias("borders"))


def _rank(value: Column, borders: Column, bits: int) -> Column:
    """How many borders the value reaches, by binary search; NULL values rank lowest."""
    def further(place: Column, step: Column) -> Column:
        return F.when(F.get(borders, place + step - 1) <= value, place + step).otherwise(place)

    return F.aggregate(F.array(*[F.lit(1 << b) for b in reversed(range(bits))]), F.lit(0), further)


def _interleaved(ranks: list[str], bits: int) -> Column:
    """The bits of all ranks in turn, highest first: neighbours on the curve are near in each."""
    parts = [
        F.shiftleft(F.shiftright(rank, bit).bitwiseAND(1).cast("long"), bit * len(ranks) + place)
        for bit in range(bits)
        for place, rank in enumerate(reversed(ranks))
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def write_clustered(
    df: DataFrame,
    path: str,
    folder: str = "category",
    along: tuple[str, ...] = ("price", "scraped_at"),
    keys: tuple[str, ...] = ("listing_id", "url"),
    files: int | None = None,
    rows_per_group: int = 1_000_000,
    distinct_keys: int = 1_000_000,
    bits: int = BITS,
) -> None:
    """Write ``df`` in folders of one column, along the curve inside, with Bloom filters on ``keys``.

    ``files`` is about the number of files (by default that of shuffle partitions). A folder that
    holds a large share of the rows is spread over many of them by the curve and, where rows are
    equal on it, by a hash of the first key. ``distinct_keys`` is the expected number of different
    values of a row group, which sizes its filter. Temporary columns start with ``_curve``.
    """
    numbers = {
        f"_curve{i}": (F.unix_micros(c) if dict(df.dtypes)[c].startswith("timestamp") else F.col(c))
        for i, c in enumerate(along)
    }
    borders = {
        f"{name}_borders": _borders(df, value, bits).scalar() for name, value in numbers.items()
    }
    ranked = df.withColumns({**borders, **numbers})
    ranks = {
        f"{name}_rank": _rank(F.col(name), F.col(f"{name}_borders"), bits) for name in numbers
    }
    ranked = ranked.withColumns(ranks).withColumn("_curve", _interleaved(list(ranks), bits))
    order = [folder, "_curve", F.xxhash64(keys[0])]
    placed = ranked.drop(*borders, *numbers, *ranks)
    placed = placed.repartitionByRange(files, *order) if files else placed.repartitionByRange(*order)
    writer = placed.sortWithinPartitions(folder, "_curve").drop("_curve").write.mode("overwrite")
    for key in keys:
        # A filter replaces the dictionary, which is of no use where nearly every value differs.
        writer = (
            writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
            .option(f"parquet.bloom.filter.expected.ndv#{key}", str(distinct_keys))
            .option(f"parquet.enable.dictionary#{key}", "false")
        )
    writer = writer.option("parquet.block.row.count.limit", str(rows_per_group)).partitionBy(folder)
    # Spark's default form of a timestamp keeps no least and greatest value, so no range could skip.
    conf, name = df.sparkSession.conf, "spark.sql.parquet.outputTimestampType"
    before = conf.get(name)
    conf.set(name, "TIMESTAMP_MICROS")
    try:
        writer.parquet(path)
    finally:
        conf.set(name, before)


def write_landed(pages: DataFrame, path: str, files: int, mode: str = "errorifexists") -> None:
    """Landed pages in so many files of small row groups: a task reads whole row groups, and a trigger
    of few files with the usual ones leaves most cores idle."""
    pages.repartition(files).write.mode(mode).option("parquet.block.size", LANDED_GROUP).parquet(path)
    release(pages.sparkSession)
