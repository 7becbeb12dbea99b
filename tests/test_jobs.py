"""Pages, rules, stores, caches and streams end to end on small literal data."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from bazaarlens.operators import folds
from bazaarlens.operators.latest import upsert
from bazaarlens.plans import logs, pages, rules
from bazaarlens.plans.cache import ReportCache
from bazaarlens.plans.ingest import ingest, split_gate
from bazaarlens.plans.reports import REPORTS, ReportRequest, base, generate
from bazaarlens.sources import copies, derived, export, schemas, store
from bazaarlens.streaming import streams

NOW = datetime(2024, 5, 1)
PAGE = """<html><body><h1 id="it-ttl">14K Gold Diamond Engagement Ring</h1>
<span class="notranslate">$599.99</span><div class="u-flL condText">New</div>
<span class="mbg-nw">seller_123</span><img src="https://i.example.com/s-l64.jpg" class="tdThumb">
<img class="tdThumb" src="https://i.example.com/2.jpg"></body></html>"""
RESULTS = """<div class="s-item"><h3 class="s-item__title"><a href="/itm/one/123">Gold Ring</a></h3>
<span class="s-item__price">$10.50</span></div>
<div class="s-item"><h3 class="s-item__title"><a href="/itm/two/124?x=1">Silver Necklace</a></h3>
</div><div class="s-item"><a href="/itm/one/999">again</a></div>"""


def page_table(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id long, url string, html string")


def test_listing_page(spark):
    df = page_table(spark, (1, "https://a/itm/155", PAGE), (2, "https://a/x", "<h1>none</h1>"))
    row = pages.extract_listings(df).collect()
    assert len(row) == 1
    row = row[0]
    assert (row["listing_id"], row["title"]) == ("155", "14K Gold Diamond Engagement Ring")
    assert (row["price"], row["condition"], row["seller_name"]) == (599.99, "New", "seller_123")
    assert (row["category"], row["material"]) == ("rings", "gold")
    assert row["image_urls"] == ["https://i.example.com/s-l1600.jpg", "https://i.example.com/2.jpg"]
    good, bad = split_gate(ingest(df))
    assert good.count() == 1 and bad.count() == 0


NESTED = """<h1 id=it data-id="it-ttl">no</h1><h1 id="it-ttl">A &eacute; <b>&#36;&#x42;</b>
 &amp;lt; &nosuch; ring</h1><span class="notranslate"><div>US</div> $12.50</span>
<div class="condText"><div>New</div> <div>boxed</div></div><span class="mbg-nw">x<br>y
<img data-src="https://i/late.jpg" class="tdThumb"><img class="tdThumb" src="https://i/s-l64.jpg"
 data-src="https://i/no.jpg"><img id="icImg" src="//i/main.jpg"><script>"originalImg":"https://i/s-l64.jpg"
</script>"""


def test_nested_elements_and_references(spark):
    df = page_table(spark, (1, "https://a/itm/1", NESTED), (2, "u", None), (3, "u", ""))
    row, = pages.extract_listings(df, site="https://a").collect()
    assert row["title"] == "A é $B &lt; &nosuch; ring" and row["price"] == 12.5
    assert row["condition"] == "New boxed" and row["seller_name"] == "xy"
    assert row["image_urls"] == ["https://i/main.jpg", "https://i/late.jpg", "https://i/s-l1600.jpg"]
    assert pages.extract_listings(df, keep_incomplete=True).count() == 3


def test_text_functions_keep_ordinary_text(spark):
    from bazaarlens.functions import text

    df = spark.createDataFrame(
        [("Signed ring. Manufacturer item number 55, made of 18k gold, boxed See original listing",)],
        "t string")
    out = df.select(text.clean_text(F.col("t")).alias("a"), text.clean_text(
        F.col("t"), [r"\bManufacturer item number.*$"]).alias("b")).first()
    assert out["a"] == "Signed ring. Manufacturer item number 55, made of 18k gold, boxed"
    assert out["b"] == "Signed ring."
    long = "<ul>" + "".join(f"<li>feature number {i} <b>bold</b></li>" for i in range(30)) + "</ul>"
    page = page_table(spark, (1, "u", long + '<div class="a feature">a feature <p>block</p></div>'))
    found = [r["feature"] for r in pages.page_features(page).orderBy("position").collect()]
    assert len(found) == 31 and found[29:] == ["feature number 29 bold", "a feature block"]
    many = "".join(f'<a href="/itm/{i}">x</a>' for i in range(80))
    assert pages.page_links(page_table(spark, (1, "u", many)), "https://a").count() == 80


def test_result_page(spark):
    df = page_table(spark, (1, "https://a/s", RESULTS))
    links = pages.page_links(df, "https://a").orderBy("position").collect()
    assert [r["link"] for r in links] == ["https://a/itm/one/123", "https://a/itm/two/124?x=1"]
    cards = pages.result_cards(df, "https://a").orderBy("position").collect()
    assert [(c["title"], c["price"], c["category"]) for c in cards] == [
        ("Gold Ring", 10.5, "rings"), ("Silver Necklace", 0.0, "necklaces")]


def test_reports_accept_no_rows(spark):
    empty = spark.createDataFrame([], schemas.LISTINGS)
    request = ReportRequest(as_of=NOW, time_range="month")
    for kind in REPORTS:
        for part in generate(kind, empty, request).values():
            assert part.count() <= 1


def test_clean_table_scores_full(spark):
    tables = {"listings": spark.createDataFrame([], schemas.LISTINGS)}
    findings = rules.validate(tables, "pedantic")
    assert findings.count() == 0
    assert rules.overall_score(findings, tables).collect()[0]["score"] == 0.0


def test_user_rule(spark):
    tables = {"listings": spark.createDataFrame([("a", 5.0)], "listing_id string, price double")
              .select(*[F.col(c) if c in ("listing_id", "price") else F.lit(None).cast(t).alias(c)
                        for c, t in spark.createDataFrame([], schemas.LISTINGS).dtypes])}
    own = rules.TableRule(
        "cheap", "basic",
        lambda t: rules._finding(t["listings"].where("price < 9"), "cheap", "info", "custom",
                                 "listings", "price", "listing_id", F.lit("cheap"), F.col("price")))
    found = rules.validate(tables, "basic", [own]).where("rule_id = 'cheap'").collect()
    assert [r["record_id"] for r in found] == ["a"]


def test_export_without_rows_fails(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "listing_id string, n int")
    result = export.export(df.where("n > 5"), str(tmp_path / "x"), export.ExportOptions("json"))
    assert not result["success"]
    assert not export.export(df, "x", export.ExportOptions("xlsx"))["success"]
    result = export.export(df, str(tmp_path / "y"), export.ExportOptions("csv"))
    assert result["record_count"] == 1


TABLE = "listing_id string, url string, price double, scraped_at timestamp"


def test_current_table_keeps_the_newest_row_per_key(spark, tmp_path):
    table = store.CurrentTable(spark, str(tmp_path), buckets=4)
    assert table.read() is None

    def put(*rows):
        table.upsert(spark.createDataFrame(list(rows), TABLE))

    def prices():
        return sorted((r["listing_id"], r["url"], r["price"]) for r in table.read().collect())

    put(*[(str(i), f"u{i}", 1.0, NOW) for i in range(20)], ("x", None, 5.0, NOW))
    put(("1", "u1", 2.0, NOW + timedelta(1)), ("2", "u2", 3.0, NOW - timedelta(1)))
    assert ("1", "u1", 2.0) in prices() and ("2", "u2", 1.0) in prices() and len(prices()) == 21
    put(("3", "moved", 4.0, NOW + timedelta(1)))  # an id under a new address
    assert ("3", "moved", 4.0) in prices() and len(prices()) == 21
    put(("new", "u4", 6.0, NOW + timedelta(1)))  # an address under a new id
    assert ("new", "u4", 6.0) in prices() and len(prices()) == 21
    table.delete(F.col("price") < 5)
    assert {p for _, _, p in prices()} == {5.0, 6.0}
    table.delete(F.lit(True))
    assert prices() == []


def test_untouched_buckets_stay_as_they_are(spark, tmp_path):
    table = store.CurrentTable(spark, str(tmp_path), buckets=16)
    table.upsert(spark.createDataFrame([(str(i), f"u{i}", 1.0, NOW) for i in range(64)], TABLE))
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "data").rglob("*.parquet")}
    table.upsert(spark.createDataFrame([("1", "u1", 2.0, NOW + timedelta(1))], TABLE))
    kept = [f for f, t in before.items() if f.exists() and f.stat().st_mtime_ns == t]
    assert 0 < len(before) - len(kept) < len(before) / 4
    plan = upsert(table.read(), table.read())._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "WindowGroupLimit" in plan


def test_upsert_reads_touched_folders_of_both_tables_only(spark, tmp_path):
    table = store.CurrentTable(spark, str(tmp_path), buckets=16)
    table.upsert(spark.createDataFrame([(str(i), f"u{i}", 1.0, NOW) for i in range(200)], TABLE))
    incoming = spark.createDataFrame([("7", "elsewhere", 2.0, NOW + timedelta(1))], TABLE)
    touched = table._touched(incoming)
    assert 1 <= len(touched) <= 2
    for folder, name, numbers in ((table.data, "_bucket", touched), (table.index, "_id_bucket", [3])):
        plan = table._within(folder, name, numbers)._jdf.queryExecution().executedPlan().toString()
        filters = plan.split("PartitionFilters: [")[1].split("]")[0]
        assert name in filters
    # files of untouched folders are spoilt: reading any of them would fail
    ids = table._numbers(table._hashed(incoming, "_id_bucket", "listing_id"), "_id_bucket")
    spoilt = []
    for folder, kept in (("data", touched), ("index", ids)):
        files = sorted((tmp_path / folder).rglob("*.parquet"))
        for file in files:
            if int(file.parent.name.split("=")[1]) not in kept and file != files[0]:
                spoilt.append((file, file.read_bytes()))
    assert len(spoilt) > 20
    for file, _ in spoilt:
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
        file.write_bytes(b"spoilt")
    table.upsert(incoming)
    for file, data in spoilt:
        file.write_bytes(data)
    got = {r["listing_id"]: r["url"] for r in table.read().collect()}
    assert len(got) == 200 and got["7"] == "elsewhere"
    table.upsert(spark.createDataFrame([("7", "u7", 3.0, NOW + timedelta(2))], TABLE))  # and back
    assert {r["listing_id"]: r["url"] for r in table.read().collect()}["7"] == "u7"
    entries = spark.read.parquet(table.index)
    assert entries.count() == 200
    placed = table._bucketed(table.read()).select("listing_id", "_bucket")
    assert placed.exceptAll(entries.select("listing_id", "_bucket")).count() == 0


def test_no_copy_is_left_and_a_crash_inside_the_swap_is_repaired(spark, tmp_path, monkeypatch):
    def state():
        return sorted((r["listing_id"], r["url"], r["price"]) for r in table.read().collect())

    def left():
        return {p.name for p in tmp_path.iterdir()} - {"data", "index", "changes"}

    table = store.CurrentTable(spark, str(tmp_path), buckets=4)
    table.upsert(spark.createDataFrame([(str(i), f"u{i}", 1.0, NOW) for i in range(20)], TABLE), "a")
    assert left() == set()
    change = spark.createDataFrame([("1", "u1", 2.0, NOW + timedelta(1)), ("z", "u2", 3.0, NOW + timedelta(1))], TABLE)

    class Died(Exception):
        pass

    def die(*_):
        raise Died

    before = state()
    for step in ("_moved", "_publish"):
        with monkeypatch.context() as patch:
            patch.setattr(store.CurrentTable, step, die)
            with pytest.raises(Died):
                table.upsert(change, "b")
        if step == "_moved":  # no record yet: nothing has happened
            assert left() and state() == before and left() == set()
    # dead with a record, and the touched folders already deleted by the overwrite
    record = spark.read.schema(store.TABLE_RECORD).json(f"{tmp_path}/record").first()
    for number in record.buckets:
        for file in (tmp_path / "data" / f"_bucket={number}").glob("*"):
            file.unlink()
    after = state()
    assert ("1", "u1", 2.0) in after and ("z", "u2", 3.0) in after and len(after) == 20
    assert left() == set()
    table.upsert(change, "b")  # repeated
    assert state() == after
    log = table.changes()
    assert log.where("batch = 'b'").groupBy("change").count().sort("change").collect() == [
        ("delete", 1), ("insert", 1), ("update", 1)]


def test_change_log_replays_to_the_table(spark, tmp_path):
    table = store.CurrentTable(spark, str(tmp_path), buckets=4)
    states = []

    def step(work):
        work()
        states.append(sorted(table.read().collect(), key=str))

    def put(name, *rows):
        step(lambda: table.upsert(spark.createDataFrame(list(rows), TABLE), name))

    put("0", *[(str(i), f"u{i}", 10.0, NOW) for i in range(12)], (None, "none", 1.0, NOW), ("x", None, 1.0, NOW))
    put("1", ("1", "u1", 8.0, NOW + timedelta(1)), ("2", "u2", 12.0, NOW - timedelta(1)))
    put("1", ("1", "u1", 8.0, NOW + timedelta(1)), ("2", "u2", 12.0, NOW - timedelta(1)))
    put("2", ("1", "u1", 4.0, NOW + timedelta(2)), ("3", "moved", 10.0, NOW + timedelta(2)))
    step(lambda: table.delete(F.col("listing_id") == "4", "3"))
    put("4", ("4", "u4", 7.0, NOW + timedelta(3)))
    put("5", ("4", "u4", 7.0, NOW + timedelta(3)))  # nothing new
    log = table.changes()
    assert [r[0] for r in log.groupBy("seq").count().sort("seq").select("seq").collect()] == [0, 1, 2, 3, 4]
    for seq, want in zip([0, 1, 2, 3, 4, 5], states[:2] + states[3:], strict=True):
        assert sorted(store.replayed(log, seq).collect(), key=str) == want
    prices = store.price_changes(log).where("listing_id IN ('1', '4')").sort("listing_id", "seq").collect()
    assert [(r["listing_id"], r["prev_price"], r["price"], r["price_change"], r["drop_percentage"]) for r in prices] == [
        ("1", None, 10.0, None, None), ("1", 10.0, 8.0, -2.0, 20.0), ("1", 8.0, 4.0, -4.0, 50.0),
        ("4", None, 10.0, None, None), ("4", None, 7.0, None, None)]


def test_retention_keeps_images_without_a_deleted_listing(spark):
    listings = spark.createDataFrame(
        [("old", False, NOW - timedelta(90)), ("kept", True, NOW - timedelta(90)),
         ("new", False, NOW)], "listing_id string, is_validated boolean, scraped_at timestamp")
    images = spark.createDataFrame(
        [("a", "old"), ("b", "kept"), ("c", "orphan"), ("d", None)], "image_id string, listing_id string")
    left = store.retained_images(images, listings, NOW)
    assert sorted(r["image_id"] for r in left.collect()) == ["b", "c", "d"]


def test_second_partitioned_export_replaces_the_first(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "listing_id string, category string")
    options = export.ExportOptions("parquet", partition_by=["category"])
    for mode in ("dynamic", "static"):
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
        export.export(rows, str(tmp_path / mode), options)
        export.export(rows.where("category = 'x'"), str(tmp_path / mode), options)
        assert spark.read.parquet(str(tmp_path / mode)).count() == 1
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")


def test_copies_hold_late_and_timeless_rows_and_their_bytes(spark, tmp_path):
    copies = store.TableCopies(spark, str(tmp_path))
    rows = [("a", NOW), ("b", NOW - timedelta(1)), ("c", None), ("d", NOW + timedelta(1))]
    schema = "id string, at timestamp"
    copies.copy("t", spark.createDataFrame(rows[:1], schema), "at", "full", NOW, keys=["id"])
    path = copies.copy("t", spark.createDataFrame(rows, schema), "at", "incremental",
                       NOW + timedelta(1), keys=["id"])
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == ["b", "c", "d"]
    path = copies.copy("t", spark.createDataFrame(rows, schema), "at", "incremental",
                       NOW + timedelta(2), keys=["id"])
    assert spark.read.schema(schema).parquet(path).count() == 0
    import os

    for r in copies.history().collect():
        files = [e for e in os.scandir(r["path"]) if not e.name.startswith(("_", "."))]
        assert r["size_bytes"] == sum(e.stat().st_size for e in files)


def test_streamed_copies_take_every_row_once(spark, tmp_path, monkeypatch):
    """Late, equal and null times are copied once each, also after a copy that failed."""
    made, folder = copies.StreamedCopies(spark, str(tmp_path / "copies")), str(tmp_path / "in")
    schema = spark.createDataFrame([], "id string, at timestamp").schema

    def land(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(folder)

    def take(strategy, day):
        copy_id = made.copy("t", folder, schema, strategy, NOW + timedelta(day), per_batch=1)
        return sorted(r["id"] for r in made.read(copy_id, schema).collect())

    land(("a", NOW), ("b", None))
    assert take("incremental", 0) == ["a", "b"]  # the first one is full
    land(("late", NOW - timedelta(9)), ("equal", NOW), ("none", None))
    assert take("incremental", 1) == ["equal", "late", "none"]
    assert take("incremental", 2) == []
    land(("c", NOW + timedelta(1)))
    land(("d", NOW - timedelta(1)))
    put, calls = copies.StreamedCopies._put, []

    def fail(self, *args):
        calls.append(1)
        if len(calls) > 1:
            raise OSError("the disk is gone")
        put(self, *args)

    with monkeypatch.context() as patch:
        patch.setattr(copies.StreamedCopies, "_put", fail)
        with pytest.raises(Exception, match="the disk is gone"):
            take("incremental", 3)
    assert [r["status"] for r in made.history().sort("created_at").collect()] == ["completed"] * 3 + ["failed"]
    assert take("incremental", 4) == ["c", "d"]
    assert take("differential", 5) == ["c", "d", "equal", "late", "none"]
    assert sorted(r["id"] for r in made.restored("t", schema).collect()) == ["a", "b", "c", "d", "equal", "late", "none"]
    assert take("full", 6) == ["a", "b", "c", "d", "equal", "late", "none"]
    assert take("differential", 7) == []


def test_last_hour_ends_at_the_clock(spark):
    errors = spark.createDataFrame(
        [(NOW + timedelta(minutes=m), "network", "low") for m in (-61, -60, -30, 0, 1)],
        "timestamp timestamp, category string, severity string")
    out = logs.last_hour_errors(errors, NOW).where("kind = 'category'").collect()
    assert [r["errors"] for r in out] == [2]


def test_cache_expires_and_clears(spark, tmp_path):
    cache, calls = ReportCache(spark, str(tmp_path)), []

    def build():
        calls.append(1)
        return spark.range(1)

    request = ReportRequest(as_of=NOW)
    for hours in (0, 5, 30):
        cache.get("r", request, NOW + timedelta(hours=hours), build)
    assert len(calls) == 2
    cache.clear("r", NOW + timedelta(hours=31))
    cache.get("r", request, NOW + timedelta(hours=32), build)
    assert len(calls) == 3
    assert ReportRequest(as_of=NOW, sellers=("x",)).key("r") != request.key("r")


def request_log(spark):
    rows = [(i, f"s{i % 4}", NOW + timedelta(seconds=37 * i), i % 3 != 0) for i in range(300)]
    df = spark.createDataFrame(
        rows, "request_id long, session_id string, timestamp timestamp, success boolean")
    return df.select(
        "*", F.lit("fetch").alias("operation"), F.lit(0.5).alias("response_time"),
        F.when(~F.col("success"), "TimeoutError").alias("error_type"),
        F.when(~F.col("success"), "rate limit").alias("error_message"),
        F.lit(200).alias("status_code"), F.lit(0).alias("retry_count"),
        F.lit("u").alias("url"))


def test_streams_match_batch(spark, tmp_path):
    log = request_log(spark)
    for part in range(3):  # one file after the other, so that no row is late
        log.where(F.floor(F.col("request_id") / 100) == part).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))

    def stream():
        return streams.read_stream(spark, str(tmp_path / "in"), log.schema, per_trigger=1)

    got = streams.run_updates(spark, streams.request_counts(stream(), "1 hour"),
                              str(tmp_path / "a"), ["window_start"])
    want = logs.request_windows(log, "1 hour")
    assert sorted(got.collect()) == sorted(want.collect())
    got = streams.run_updates(spark, streams.recurring_errors(stream(), 60, 60),
                              str(tmp_path / "b"), ["window_start", "error_type", "category"])
    want = logs.error_windows(logs.classified(log), 60)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    got = streams.run_updates(
        spark, streams.decaying_risk(streams.with_request_risk(stream())), str(tmp_path / "c"),
        ["session_id"])
    assert got.agg(F.sum("steps")).collect()[0][0] == 300


def test_stream_risk_does_not_depend_on_triggers(spark, tmp_path):
    """Files in any order, one or many a trigger, give what the batch fold gives."""
    log = streams.with_request_risk(request_log(spark)).persist()
    spread = log.withColumn("part", F.pmod(F.xxhash64("request_id"), F.lit(6)))
    for part in range(6):
        spread.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in"))
    weighted = folds.weighted_risk(log, F.col("risk"))
    decaying = folds.decaying_risk(log, F.col("success"), F.col("risk"))
    for per_trigger in (1, 4):
        for name, fold, want in (("w", streams.weighted_risk, weighted), ("d", streams.decaying_risk, decaying)):
            stream = streams.read_stream(spark, str(tmp_path / "in"), log.schema, per_trigger=per_trigger)
            got = streams.run_updates(
                spark, fold(stream, "5 hours", 600_000), str(tmp_path / f"{name}{per_trigger}"), ["session_id"])
            got = {r["session_id"]: (r["steps"], round(r["risk"], 9), r["upto"]) for r in got.collect()}
            last = {r[0]: r[1] for r in log.groupBy("session_id").agg(F.max("timestamp")).collect()}
            assert got == {r["session_id"]: (r["steps"], round(r["risk"], 9), last[r["session_id"]])
                           for r in want.collect()}
    log.unpersist()


def test_closed_slots_leave_the_state(spark, tmp_path):
    """Two hours in order with a short watermark: what has been folded holds no rows any more."""
    log = streams.with_request_risk(request_log(spark))
    for part in range(6):
        log.where(F.floor(F.col("request_id") / 50) == part).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), log.schema, per_trigger=1)
    got = streams.run_updates(spark, streams.decaying_risk(stream), str(tmp_path / "out"), ["session_id"])
    want = folds.decaying_risk(log, F.col("success"), F.col("risk"))
    assert {(r["session_id"], r["steps"], round(r["risk"], 9)) for r in got.collect()} == {
        (r["session_id"], r["steps"], round(r["risk"], 9)) for r in want.collect()}
    rows = (spark.read.format("statestore").option("stateVarName", "rows")
            .load(str(tmp_path / "out" / "checkpoint")))
    newest = log.agg(F.max("timestamp")).first()[0]
    kept = rows.select(F.explode("map_value").alias("k", "v")) if "map_value" in rows.columns else rows.select(
        F.col("user_map_key").alias("k"))
    slots = [r["k"][0] for r in kept.collect()]
    assert slots and min(slots) >= (newest - timedelta(minutes=45)).timestamp() // 60


def test_late_rows_are_counted(spark, tmp_path):
    log = request_log(spark)
    ahead = log.withColumn("timestamp", F.col("timestamp") + F.expr("interval 5 days"))
    for part in (log.limit(100), ahead.limit(100), log.limit(100)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.read_stream(spark, str(tmp_path / "in"), log.schema, per_trigger=1)
        query = streams.start_updates(streams.request_counts(stream, "1 hour"),
                                      str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        query.awaitTermination()
    assert streams.late_rows(query) > 0


def test_late_rows_of_forgotten_triggers_are_counted(spark, tmp_path):
    log = request_log(spark)
    ahead = log.withColumn("timestamp", F.col("timestamp") + F.expr("interval 5 days"))
    # rows are late by the watermark of the trigger before
    parts = (log.limit(100), ahead.limit(100), ahead.limit(10), log.limit(100), *[ahead.limit(10)] * 4)
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    counts = []
    for kept in ("100", "2"):
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)
        try:
            stream = streams.read_stream(spark, str(tmp_path / "in"), log.schema, per_trigger=1)
            query = streams.start_updates(streams.request_counts(stream, "1 hour"),
                                          str(tmp_path / kept), str(tmp_path / f"c{kept}"))
            query.awaitTermination()
        finally:
            spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
        counts.append((streams.late_rows(query), len(query.recentProgress)))
    assert counts[0][0] == counts[1][0] > 0 and counts[0][1] >= 7 and counts[1][1] <= 2


def test_session_windows_and_bounded_deduplication_in_a_stream(spark, tmp_path):
    log = request_log(spark)
    for part in range(3):
        log.where(F.floor(F.col("request_id") / 100) == part).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))

    def stream():
        return streams.read_stream(spark, str(tmp_path / "in"), log.schema, per_trigger=1)

    got = streams.gap_sessions(stream(), "session_id", "1 minute")
    query = (got.writeStream.format("memory").queryName("gaps").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "g")).trigger(availableNow=True).start())
    query.awaitTermination()
    closed = spark.table("gaps")
    assert closed.count() > 0 and closed.where("ends_at - started_at < interval 1 minute").count() == 0
    first = streams.unseen(stream(), "session_id")
    query = (first.writeStream.format("memory").queryName("seen").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert spark.table("seen").select("session_id").distinct().count() == 4


def test_cluster_needs_shared_folder(spark):
    from bazaarlens.session import work_dir

    assert "/job-" in work_dir(spark, "job")


def test_registered_queries_on_smallest_tables(spark):
    from checks.catalog import load
    from checks.compare import compare, connect

    sf_dir = "/root/testdata/sf0.001"
    con, checks = connect(sf_dir), load()
    names = ["overview", "price_distribution", "premium_brands", "material_price_analysis",
             "listing_summaries", "validate_strict", "join_sessions_full", "page_fields",
             "trailing_error_rate", "weighted_risk", "table_copies", "quality_score_by_table"]
    for name in names:
        ok, note = compare(spark, con, sf_dir, name, checks[name])
        assert ok, note
    assert base(derived.listings(spark, sf_dir), ReportRequest(as_of=derived.AS_OF)).count() > 0
