"""Clustered files hold the same rows and let a search skip most of them."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from bazaarlens.sources.layout import write_clustered

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    """Two thirds of the rows in one category; null prices, times and categories, repeated rows."""
    rng = random.Random(4)
    data = [
        (f"{rng.random():.17f}", f"u{i}", "rings" if i % 3 else rng.choice(["watches", None]),
         None if i % 50 == 0 else rng.randrange(100_000) / 100,
         None if i % 70 == 0 else START + timedelta(minutes=rng.randrange(500_000)))
        for i in range(6000)
    ]
    return spark.createDataFrame(
        [*data, *data[:5]],
        "listing_id string, url string, category string, price double, scraped_at timestamp").cache()


def box(df):
    return df.where((F.col("category") == "rings") & F.col("price").between(100, 200)
                    & F.col("scraped_at").between(START, START + timedelta(days=60)))


def touched(path):
    """Row groups of the folder and those whose price and time ranges meet the search's."""
    groups = met = 0
    for file in Path(path, "category=rings").glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        place = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            price, at = (meta.row_group(g).column(place[c]).statistics for c in ("price", "scraped_at"))
            groups += 1
            if not (price.has_min_max and at.has_min_max):
                continue  # nulls only
            end = START + timedelta(days=60)
            met += bool(price.min <= 200 and price.max >= 100
                        and at.min.replace(tzinfo=None) <= end and at.max.replace(tzinfo=None) >= START)
    return groups, met


def read_rows(df):
    """Rows the scan gave to the query."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply(
        "numOutputRows").value()


def test_ranges_touch_few_row_groups(spark, rows, tmp_path):
    plain, laid = str(tmp_path / "plain"), str(tmp_path / "laid")
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    rows.repartition(12).write.partitionBy("category").parquet(plain)
    spark.conf.unset("spark.sql.parquet.outputTimestampType")
    write_clustered(rows, laid, files=24, rows_per_group=200, distinct_keys=200)
    stored = spark.read.parquet(laid)
    assert sorted(stored.columns) == sorted(rows.columns)
    assert stored.select(rows.columns).exceptAll(rows).isEmpty()
    assert rows.exceptAll(stored.select(rows.columns)).isEmpty()
    groups, met = touched(laid)
    assert groups >= 16 and met * 3 <= groups
    assert touched(plain)[0] == touched(plain)[1]
    assert sorted(map(str, box(stored).select(rows.columns).collect())) == sorted(map(str, box(rows).collect()))
    assert read_rows(box(stored)) * 3 <= rows.where("category = 'rings'").count()


def test_look_ups_use_the_filters(spark, rows, tmp_path):
    laid, bare = str(tmp_path / "laid"), str(tmp_path / "bare")
    write_clustered(rows, laid, files=8, rows_per_group=500, distinct_keys=500)
    write_clustered(rows, bare, files=8, rows_per_group=500, keys=("url",))
    known = rows.first()["listing_id"]
    found = spark.read.parquet(laid).where(F.col("listing_id") == known)
    assert {r["listing_id"] for r in found.collect()} == {known}
    assert read_rows(found) < rows.count() / 4
    absent = F.col("listing_id") == "0.5000000000000000x"
    assert read_rows(spark.read.parquet(laid).where(absent)) < rows.count() / 4


def test_no_rows_and_one_value(spark, rows, tmp_path):
    write_clustered(rows.where("price = -1"), str(tmp_path / "none"))
    one = rows.limit(40).withColumn("price", F.lit(1.0)).withColumn("scraped_at", F.lit(START))
    write_clustered(one, str(tmp_path / "one"), files=3)
    assert spark.read.parquet(str(tmp_path / "one")).count() == 40
