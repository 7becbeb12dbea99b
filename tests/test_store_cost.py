"""What the current table reads, writes and computes more than once, and how landed pages lie."""

from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from bazaarlens.sources import layout, store

NOW = datetime(2024, 5, 1)
TABLE = "listing_id string, url string, price double, scraped_at timestamp"


def rows(spark, n, price, day=0):
    return spark.createDataFrame([(str(i), f"u{i}", price, NOW + timedelta(day)) for i in range(n)], TABLE)


def state(table):
    return sorted((r["listing_id"], r["url"], r["price"]) for r in table.read().collect())


def test_landed_files_have_row_groups_for_many_tasks(spark, tmp_path):
    noise = F.concat_ws("", *[F.sha2(F.concat("id", F.lit(str(k))), 512) for k in range(20)])
    pages = spark.range(16_000).select(F.col("id").alias("page_id"), noise.alias("html"))
    layout.write_landed(pages, str(tmp_path / "landed"), 2)
    files = list((tmp_path / "landed").glob("*.parquet"))
    assert len(files) == 2 and all(pq.ParquetFile(f).num_row_groups >= 2 for f in files)


def test_what_a_batch_writes_is_moved_and_not_written_again(spark, tmp_path, monkeypatch):
    def files(folder):
        return {f.name for f in folder.rglob("*.parquet") if f.is_file()}

    table = store.CurrentTable(spark, str(tmp_path), buckets=4)
    publish, seen = store.CurrentTable._publish, {}

    def spied(self, record):
        for part in ("data", "index", "changes"):
            seen[part] = files(tmp_path / record.aside / part)
        publish(self, record)

    monkeypatch.setattr(store.CurrentTable, "_publish", spied)
    table.upsert(rows(spark, 50, 1.0), "a")
    for part in ("data", "index", "changes"):
        assert seen[part] and files(tmp_path / part) == seen[part]


@pytest.mark.parametrize("dies_at", [0, 1, 3, 5])
def test_a_crash_between_two_moves_is_repaired(spark, tmp_path, monkeypatch, dies_at):
    class Died(Exception):
        pass

    table = store.CurrentTable(spark, str(tmp_path), buckets=4)
    table.upsert(rows(spark, 40, 1.0), "a")
    # "9" goes to another address, so folders of both tables change and one may be left empty
    change = rows(spark, 9, 2.0, 1).union(
        spark.createDataFrame([("9", "elsewhere", 2.0, NOW + timedelta(1))], TABLE))
    move, calls = store.move, []

    def dying(*args):
        if len(calls) == dies_at:
            raise Died
        calls.append(args)
        move(*args)

    with monkeypatch.context() as patch:
        patch.setattr(store, "move", dying)
        with pytest.raises(Died):
            table.upsert(change, "b")
    got = state(table)
    want = [(str(i), f"u{i}" if i != 9 else "elsewhere", 2.0 if i < 10 else 1.0) for i in range(40)]
    assert got == sorted(want)
    assert sorted(r["listing_id"] for r in spark.read.parquet(table.index).collect()) == sorted(map(str, range(40)))
    assert table.changes().where("batch = 'b'").count() == 10


def test_a_batch_for_every_folder_is_computed_twice_only(spark, tmp_path):
    table = store.CurrentTable(spark, str(tmp_path), buckets=4)
    table.upsert(rows(spark, 40, 1.0), "a")
    count = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(price):
        count.add(1)
        return price

    table.upsert(rows(spark, 40, 2.0, 1).withColumn("url", F.when(counted("price") > 0, F.col("url"))), "b")
    assert count.value <= 2 * 40
    assert {r[2] for r in state(table)} == {2.0}


def test_emptied_folders_are_empty_after_a_delete(spark, tmp_path):
    table = store.CurrentTable(spark, str(tmp_path), buckets=4)
    table.upsert(rows(spark, 40, 1.0), "a")
    table.delete(F.col("price") == 1.0, "b")
    assert state(table) == [] and spark.read.parquet(table.index).count() == 0
    table.upsert(rows(spark, 2, 3.0, 2), "c")
    assert state(table) == [("0", "u0", 3.0), ("1", "u1", 3.0)]
