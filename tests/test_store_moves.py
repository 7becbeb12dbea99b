"""A change of the current table moves every row once, and its result is that of the plain upsert."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from bazaarlens.operators.latest import upsert
from bazaarlens.sources import store

NOW = datetime(2024, 5, 1)
TABLE = "listing_id string, url string, price double, scraped_at timestamp"


def exchanges(df, column):
    """Exchanges of a plan that a column goes through."""
    text = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    found = [part.split("\n") for part in text.split("\n\n") if ") Exchange" in part.split("\n")[0]]
    return sum(any(line.startswith("Input") and column in line for line in part) for part in found)


def test_a_change_moves_wide_rows_once(spark, tmp_path, monkeypatch):
    def rows(day):
        return spark.range(60).select(
            F.col("id").cast("string").alias("listing_id"), F.concat(F.lit("u"), "id").alias("url"),
            F.sha2(F.concat_ws(" ", "id", F.lit(day)), 512).alias("payload"),
            F.lit(NOW + timedelta(day)).cast("timestamp").alias("scraped_at"))

    table, moved = store.CurrentTable(spark, str(tmp_path), buckets=4), []
    write = DataFrameWriter.parquet

    def spied(self, path, *args, **more):
        moved.append(sum(exchanges(self._df, c) for c in ("payload", "before", "after")))
        write(self, path, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", spied)
    for day in range(2):
        moved.clear()
        table.upsert(rows(day), str(day))
        assert sum(moved) == 1
    moved.clear()
    table.delete(F.col("listing_id") < "3", "gone")
    assert sum(moved) == 0
    assert table.read().where("listing_id < '3'").count() == 0


@pytest.mark.parametrize("crowded", [False, True])
def test_changes_are_those_of_the_plain_upsert(spark, tmp_path, monkeypatch, crowded):
    """Ids under several addresses, addresses under several ids, ids and addresses that are null."""
    if crowded:
        monkeypatch.setattr(store, "CROWDED_ID", 2)
        monkeypatch.setattr(store, "CROWDED_PLACE", 3)
    pick = random.Random(7)
    table = store.CurrentTable(spark, str(tmp_path), buckets=2)
    want, places, minute = spark.createDataFrame([], TABLE), 2 if crowded else 12, 0
    for batch in range(2):
        rows = []
        for _ in range(30):
            minute += 1  # no two rows of one time
            name = pick.choice([None, *"abcdefghijklmnop"])
            url = pick.choice([None, f"u{pick.randrange(places)}", f"own-{name}"])
            rows.append((name, url, float(pick.randrange(3)), NOW + timedelta(minutes=minute * pick.choice([1, -1]))))
        incoming = spark.createDataFrame(rows, TABLE)
        want = spark.createDataFrame(upsert(want, incoming).collect(), TABLE)
        table.upsert(incoming, str(batch))
        kept = want.where("listing_id IS NOT NULL")
        mine = table.read().where("listing_id IS NOT NULL")
        assert sorted(mine.collect(), key=str) == sorted(kept.collect(), key=str)
        replay = store.replayed(table.changes()).where("listing_id IS NOT NULL")
        assert sorted(replay.collect(), key=str) == sorted(kept.collect(), key=str)
        placed = table._bucketed(kept).select("listing_id", "_bucket")
        assert sorted(spark.read.parquet(table.index).select("listing_id", "_bucket").collect()) == sorted(placed.collect())
