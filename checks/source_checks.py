"""Source, sink, retention, copy and cache checks; files go to the shared work folder."""

from datetime import timedelta

from pyspark.sql import functions as F

from bazaarlens.operators.filters import ListingFilter, apply_filter
from bazaarlens.plans import reports as R
from bazaarlens.plans.cache import ReportCache
from bazaarlens.plans.ingest import ingest, merge, split_gate
from bazaarlens.session import work_dir, written
from bazaarlens.sources import copies as C
from bazaarlens.sources import export as X
from bazaarlens.sources import layout, schemas
from bazaarlens.sources import store as S
from bazaarlens.sources.derived import AS_OF as NOW
from bazaarlens.sources.derived import datetime, request_columns
from bazaarlens.streaming import streams
from checks.catalog import check
from checks.tables import AS_OF

COLUMNS = ["listing_id", "title", "price", "bids", "is_validated", "scraped_at"]
SAME = "SELECT listing_id, title, price, bids, is_validated, scraped_at FROM base"


def _round_trip(t, fmt, **options):
    """Export validated listings, then read them back with the declared types."""
    path = work_dir(t.spark, f"export-{fmt}")
    chosen = X.ExportOptions(format=fmt, include=COLUMNS, **options)
    result = X.export_listings(t.listings, ListingFilter(is_validated=True), path, chosen)
    assert result["success"], result
    schema = t.listings.select(*COLUMNS).schema
    reader = t.spark.read.schema(schema)
    if fmt == "csv":
        return reader.options(sep=options.get("delimiter", ","), header=True, escape='"').csv(path)
    if fmt == "xml":
        return reader.option("rowTag", "listing").xml(path)
    return reader.format("json" if fmt == "jsonl" else fmt).load(path)


for fmt, options in [("csv", {"delimiter": ";", "quote_all": True}), ("json", {}), ("jsonl", {}),
                     ("xml", {}), ("parquet", {"compression": "zstd"})]:
    check(f"export_{fmt}", lambda t, fmt=fmt, o=options: _round_trip(t, fmt, **o), SAME, "base")
check("export_csv_gzip", lambda t: _round_trip(t, "csv", compression="gzip"), SAME, "base")
check("export_high_quality", lambda t: X.high_quality_rows(t.listings).select("listing_id", "price"),
      "SELECT listing_id, price FROM base WHERE data_completeness_score >= 0.8 AND image_count > 0",
      "base")
check("export_category_summary", lambda t: X.category_rows(t.listings, "rings"),
      """SELECT listing_id, title, price, currency, condition, seller_name, brand, main_stone,
  image_count, watchers, views, round(data_completeness_score, 4) AS data_completeness_score,
  scraped_at, url FROM base WHERE category = 'rings'""", "base")
_TAGGED = """CASE watchers % 5 WHEN 0 THEN concat('["', category, '","', material, '"]')
  WHEN 1 THEN '[]' WHEN 2 THEN 'not json' WHEN 3 THEN '{"a":1}' END"""
check(
    "export_flatten_rename",
    lambda t: X.prepared(
        t.listings.withColumns({"tags": F.expr(_TAGGED), "metadata": F.lit("m"),
                                "raw_data": F.lit("r")}),
        X.ExportOptions(
            exclude=None, rename={"tags": "labels", "price": "amount"},
            transform=lambda df: df.withColumn("amount", F.col("amount") * 2),
        ),
    ).select("listing_id", "labels", "amount"),
    """SELECT listing_id, CASE watchers % 5 WHEN 0 THEN category || ', ' || material WHEN 1 THEN ''
    WHEN 2 THEN 'not json' WHEN 3 THEN '{"a":1}' END AS labels, price * 2 AS amount FROM listings""",
    "listings",
)
def _filled(rows):
    """How many values each exported column has."""
    counts = rows.agg(*[F.count(c).alias(c) for c in rows.columns])
    return counts.unpivot([], counts.columns, "column", "filled")


check("export_fields",
      lambda t: _filled(X.choose_fields(
          t.listings.withColumns({"metadata": F.lit(1), "raw_data": F.lit(1)}), X.ExportOptions())),
      " UNION ALL ".join(
          f"""SELECT '{c}' AS "column", count({c}) AS filled FROM listings""" for c in [
              "listing_id", "url", "title", "description", "price",
              "original_price", "currency", "condition", "seller_name", "seller_rating",
              "category", "material", "brand", "main_stone", "watchers",
              "views", "bids", "image_count", "data_completeness_score", "is_validated",
              "scraped_at",
          ]),
      "listings")


def _history(t):
    log = work_dir(t.spark, "history")
    for day, category in enumerate(["rings", "watches", "pendants"]):
        rows = t.base.where(F.col("category") == category)
        result = X.export(rows, work_dir(t.spark, "export"), X.ExportOptions(format="json"))
        X.log_export(t.spark, log, result, "json", NOW + timedelta(days=day))
    return X.export_history(t.spark, log, 2).select("format", "record_count", "status")


check("export_history", _history,
      """SELECT 'json' AS format, count(*) AS record_count, 'completed' AS status FROM base
  WHERE category IN ('watches', 'pendants') GROUP BY category""", "base")


def _scan(t):
    path = work_dir(t.spark, "scan")
    t.listings.write.parquet(path)
    return S.scan(t.spark, "listings", path).groupBy("category").agg(
        F.count("*").alias("listings"), F.count("brand").alias("brands"),
        F.count("designer").alias("designers"))


check("scan_declared_schema", _scan,
      """SELECT category, count(*) AS listings, count(brand) AS brands, 0 AS designers FROM listings
  GROUP BY category""", "listings")


def _error_log(t):
    path = work_dir(t.spark, "errors")
    errors = t.errors.select("error_id", "timestamp", "error_type", "error_message", "severity",
                             "category", "operation", "url")
    S.append_errors(errors.where("severity = 'low'"), path)
    S.append_errors(errors.where("severity <> 'low'"), path)
    return S.read_errors(t.spark, path).select("error_type", "category", "severity", "timestamp")


check("error_log_append_read", _error_log,
      "SELECT error_type, category, severity, timestamp FROM errors", "errors")


def _nested(t):
    rows = t.listings.select(
        "listing_id", F.array("category", "material").alias("tags"),
        F.create_map(F.lit("brand"), "brand").alias("metadata"))
    text = S.serialise_nested(rows)
    back = S.parse_nested(text, schemas.LISTINGS)
    return back.select("listing_id", F.element_at("tags", 2).alias("second"),
                       F.element_at("metadata", "brand").alias("brand"),
                       F.size("tags").alias("tags"))


check("nested_round_trip", _nested,
      "SELECT listing_id, material AS second, brand, 2::INT AS tags FROM listings", "listings")
check("retention_preview",
      lambda t: S.retention_preview(t.full, derived_images(t), NOW, 200),
      f"""SELECT count(*) AS listings_to_delete, (SELECT count(*) FROM images
    WHERE created_at < {AS_OF} - INTERVAL 200 DAY AND listing_id IN (SELECT listing_id FROM listings
      WHERE NOT is_validated AND scraped_at < {AS_OF} - INTERVAL 200 DAY)) AS images_to_delete
  FROM listings WHERE NOT is_validated AND scraped_at < {AS_OF} - INTERVAL 200 DAY""",
      "listings", "images")


def derived_images(t):
    from bazaarlens.sources import derived

    return derived.images(t.spark, t.dir, with_orders=True)


check("retained_listings", lambda t: S.retained(t.listings, NOW, 200).select("listing_id"),
      f"""SELECT listing_id FROM listings WHERE is_validated
  OR scraped_at >= {AS_OF} - INTERVAL 200 DAY""", "listings")
check("retained_images",
      lambda t: S.retained_images(t.images, t.listings, NOW, 200).select("image_id"),
      f"""SELECT image_id FROM images WHERE NOT EXISTS (FROM listings l
  WHERE l.listing_id = images.listing_id AND NOT is_validated
    AND scraped_at < {AS_OF} - INTERVAL 200 DAY)""", "listings", "images")


def _table(t):
    """Load, upsert twice in the same batch, then age out one category of a current-version table."""
    table = S.CurrentTable(t.spark, work_dir(t.spark, "table"), buckets=8)
    columns = ["listing_id", "url", "category", "price", "scraped_at"]
    table.upsert(t.listings.where("bids <= 3 OR bids IS NULL").select(*columns), "load")
    changed = t.listings.where("bids >= 3 OR bids IS NULL").select(*columns)
    for _ in range(2):
        table.upsert(changed.withColumn("price", F.col("price") + 1), "change")
    table.delete(S.older_than(NOW, 600, "rings"), "age")
    return table


STATES = """WITH first AS (SELECT listing_id, url, category, price, scraped_at FROM listings
  WHERE bids <= 3 OR bids IS NULL QUALIFY row_number() OVER (PARTITION BY url
    ORDER BY scraped_at DESC, listing_id DESC) = 1),
rows AS (SELECT *, 0 AS fresh FROM first UNION ALL
  SELECT listing_id, url, category, price + 1, scraped_at, 1 FROM listings
    WHERE bids >= 3 OR bids IS NULL),
by_id AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY listing_id
    ORDER BY scraped_at DESC, fresh DESC) = 1),
by_url AS (SELECT * FROM by_id QUALIFY row_number() OVER (PARTITION BY url
    ORDER BY scraped_at DESC, fresh DESC, listing_id DESC) = 1)"""
KEPT = f"""{STATES}
SELECT listing_id, url, category, price, scraped_at FROM by_url
WHERE NOT (category = 'rings' AND scraped_at < {AS_OF} - INTERVAL 600 DAY)"""
check("current_table", lambda t: _table(t).read(), KEPT, "listings", digits=2)
check("replayed_table", lambda t: S.replayed(_table(t).changes()), KEPT, "listings", digits=2)
check("price_change_log", lambda t: S.price_changes(_table(t).changes()).select(
          "listing_id", "seq", "price", "prev_price", F.round("price_change", 0).alias("price_change")),
      f"""{STATES}
SELECT listing_id, 0 AS seq, price, NULL::DOUBLE AS prev_price, NULL::DOUBLE AS price_change FROM first
UNION ALL
SELECT listing_id, 1, b.price, a.price, round(b.price - a.price) FROM by_url b LEFT JOIN first a USING (listing_id) WHERE b.price IS DISTINCT FROM a.price""",
      "listings", digits=2)
check("table_changes",
      lambda t: _table(t).changes().groupBy("batch", "seq", "change").agg(F.count("*").alias("rows")),
      f"""{STATES}
SELECT 'load' AS batch, 0 AS seq, 'insert' AS change, count(*) AS rows FROM first UNION ALL
SELECT 'change', 1, CASE WHEN a.listing_id IS NULL THEN 'insert' WHEN b.listing_id IS NULL
  THEN 'delete' ELSE 'update' END AS change, count(*)
FROM by_url b FULL JOIN first a USING (listing_id)
WHERE a.listing_id IS NULL OR b.listing_id IS NULL OR a.price IS DISTINCT FROM b.price GROUP BY 3 UNION ALL
SELECT 'age', 2, 'delete', count(*) FROM by_url
  WHERE category = 'rings' AND scraped_at < {AS_OF} - INTERVAL 600 DAY HAVING count(*) > 0""",
      "listings")
DAYS = [datetime(1998, 1, 1), datetime(2000, 1, 1), datetime(2001, 1, 1), datetime(2002, 1, 1)]


def _copies(t):
    """Full copy, incremental, differential and again incremental of a growing table.

    From the second step on, rows of 11 watchers appear whose time lies before the watermark, and
    rows of 12 watchers without a time.
    """
    copies = S.TableCopies(t.spark, work_dir(t.spark, "copies"))
    when = F.when(F.col("watchers") != 12, F.col("scraped_at"))
    rows = t.listings.where("bids IS NOT NULL").select(
        "listing_id", "url", "watchers", when.alias("scraped_at"))
    steps = zip(["full", "incremental", "differential", "incremental"], DAYS)
    for strategy, day in steps:
        there = F.coalesce(F.col("scraped_at") < F.lit(day), F.lit(True))
        if strategy == "full":
            there = there & ~F.col("watchers").isin(11, 12)
        copies.copy("listings", rows.where(there), "scraped_at", strategy, day,
                    keys=["listing_id", "url"])
    return S.list_copies(copies.history(), status="completed").select(
        "strategy", "row_count", "created_at", (F.col("size_bytes") > 0).alias("has_bytes"))


check("table_copies", _copies,
      """WITH d AS (SELECT watchers, CASE WHEN watchers <> 12 THEN scraped_at END AS s FROM listings
    WHERE bids IS NOT NULL)
SELECT 'full' AS strategy, count(*) AS row_count, TIMESTAMP '1998-01-01' AS created_at,
  true AS has_bytes FROM d WHERE s < '1998-01-01' AND watchers <> 11 UNION ALL
SELECT 'incremental', count(*), TIMESTAMP '2000-01-01', true FROM d
  WHERE s IS NULL OR s < '2000-01-01' AND (s >= '1998-01-01' OR watchers = 11) UNION ALL
SELECT 'differential', count(*), TIMESTAMP '2001-01-01', true FROM d
  WHERE s IS NULL OR s < '2001-01-01' AND (s >= '1998-01-01' OR watchers = 11) UNION ALL
SELECT 'incremental', count(*), TIMESTAMP '2002-01-01', true FROM d WHERE s >= '2001-01-01'""",
      "listings")


def _landed(t):
    """The rows of ``_copies`` by the step that they arrive in (``step``), times as they are."""
    at, late = F.col("scraped_at"), F.col("watchers").isin(11, 12)
    step = F.when(at < F.lit(DAYS[0]), F.when(late, 1).otherwise(0)).when(at < F.lit(DAYS[1]), 1)
    return t.listings.where("bids IS NOT NULL").select(
        "listing_id", "url", "watchers", F.when(F.col("watchers") != 12, at).alias("scraped_at"),
        step.when(at < F.lit(DAYS[2]), 2).otherwise(3).alias("step"))


def _streamed_copies(t):
    """Full, incremental, differential and twice incremental of a folder that gets files."""
    copies = C.StreamedCopies(t.spark, work_dir(t.spark, "streamed"))
    folder, rows = work_dir(t.spark, "growing"), _landed(t)
    schema = rows.drop("step").schema
    for i, strategy in enumerate(["full", "incremental", "differential", "incremental", "incremental"]):
        rows.where(F.col("step") == i).drop("step").write.mode("append").parquet(folder)
        copies.copy("listings", folder, schema, strategy, DAYS[0] + timedelta(days=i), per_batch=2)
    return copies, schema


LANDED = """WITH d AS (SELECT listing_id, watchers, CASE WHEN watchers <> 12 THEN scraped_at END AS scraped_at,
  CASE WHEN scraped_at < '1998-01-01' THEN (watchers IN (11, 12))::INT WHEN scraped_at < '2000-01-01' THEN 1
    WHEN scraped_at < '2001-01-01' THEN 2 ELSE 3 END AS step FROM listings WHERE bids IS NOT NULL)"""
check("streamed_copies",
      lambda t: S.list_copies(_streamed_copies(t)[0].history(), status="completed").select(
          "strategy", "row_count", "created_at", (F.col("size_bytes") > 0).alias("has_bytes")),
      f"""{LANDED}
SELECT 'full' AS strategy, count(*) AS row_count, TIMESTAMP '1998-01-01' AS created_at, true AS has_bytes
  FROM d WHERE step = 0 UNION ALL
SELECT 'incremental', count(*), TIMESTAMP '1998-01-02', true FROM d WHERE step = 1 UNION ALL
SELECT 'differential', count(*), TIMESTAMP '1998-01-03', true FROM d WHERE step IN (1, 2) UNION ALL
SELECT 'incremental', count(*), TIMESTAMP '1998-01-04', true FROM d WHERE step = 3 UNION ALL
SELECT 'incremental', 0, TIMESTAMP '1998-01-05', true""", "listings")


def _restored(t):
    copies, schema = _streamed_copies(t)
    return copies.restored("listings", schema).select("listing_id", "watchers", "scraped_at")


check("restored_copies", _restored, f"{LANDED} SELECT listing_id, watchers, scraped_at FROM d", "listings")


def _copy_stats(t):
    copies = S.TableCopies(t.spark, work_dir(t.spark, "copies"))
    copies.copy_all({"listings": t.base.select("listing_id", "scraped_at"),
                     "sessions": t.sessions.select("session_id", "started_at")},
                    {"listings": "scraped_at", "sessions": "started_at"}, NOW, "json")
    return S.copy_stats(copies.history())


check("copy_stats",
      lambda t: _copy_stats(t).withColumn("total_size_mb", F.col("total_size_mb") > 0),
      f"""SELECT n AS total_copies, n AS completed_copies, 0 AS failed_copies, 0 AS active_copies,
  (SELECT count(*) FROM base) > 0 AS total_size_mb, {AS_OF} AS latest_copy, 100.0 AS success_rate
  FROM (SELECT ((SELECT count(*) FROM base) > 0)::INT + (count(*) > 0)::INT AS n FROM sessions)""",
      "base", "sessions")


def _cached(t):
    """A report read twice from the cache, then after it has expired."""
    cache = ReportCache(t.spark, work_dir(t.spark, "cache"))
    request = t.request(time_range="year")
    for hours in (0, 1, 30):
        out = cache.get("price_by_material", request, NOW + timedelta(hours=hours),
                        lambda: R.price_by_material(R.base(t.listings, request)))
    stats = cache.stats().select("entries", "hits")
    entries, hits = stats.select("entries").scalar(), stats.select("hits").scalar()
    return out.select("material", "count", entries.alias("entries"), hits.alias("hits"))


check("report_cache", _cached,
      f"""SELECT material, count(*) AS count, 1 AS entries, 1 AS hits FROM base
  WHERE scraped_at >= {AS_OF} - INTERVAL 365 DAY GROUP BY material HAVING count(*) >= 5""", "base")


def _stream_ingest(t):
    """Landed pages as a stream in four triggers: every listing is seen twice, the second time
    with another price, and the newest files may arrive first."""
    landing = work_dir(t.spark, "landing")
    pages = t.listing_pages.withColumn("seen_at", F.lit(NOW - timedelta(days=2)))
    again = pages.withColumns({
        "seen_at": F.lit(NOW),
        "html": F.regexp_replace("html", r"<b>\$[0-9,]+", r"<b>\$9")})
    layout.write_landed(again, landing, 8)
    layout.write_landed(pages, landing, 8, "append")
    stream = streams.read_stream(t.spark, landing, pages.schema, per_trigger=4)
    table = S.CurrentTable(t.spark, work_dir(t.spark, "current"), buckets=8)
    streams.start_upsert(streams.ingest_stream(stream), table, lambda: NOW,
                         work_dir(t.spark, "checkpoint")).awaitTermination()
    return table.read().select("listing_id", "url", F.floor("price").alias("whole_price"))


check("stream_ingest", _stream_ingest,
      """SELECT DISTINCT replace(url, 'https://shop.example.com/itm/', '') AS listing_id, url,
  9 AS whole_price FROM listings WHERE watchers NOT IN (7, 13)""", "listings")


def _ingested(t):
    """Landed pages of two sightings through the whole ingest job, rejects kept."""
    landing = work_dir(t.spark, "landing")
    pages = t.listing_pages.withColumn("seen_at", F.lit(NOW))
    layout.write_landed(pages, landing, 4)
    stream = streams.read_stream(t.spark, landing, pages.schema, per_trigger=2)
    table = S.CurrentTable(t.spark, work_dir(t.spark, "current"), buckets=8)
    rejects = work_dir(t.spark, "rejects")
    streams.start_ingest(stream, table, rejects, lambda: NOW,
                         work_dir(t.spark, "checkpoint")).awaitTermination()
    return rejects


check("ingest_rejects",
      lambda t: streams.rejects_of(t.spark, _ingested(t)).select(
          "page_id", F.array_join("reasons", "; ").alias("reasons"), F.col("scraped_at").alias("seen_at")),
      f"""SELECT listing_id AS page_id, CASE watchers WHEN 7 THEN 'Valid price is required'
  ELSE 'Title is required' END AS reasons, {AS_OF} AS seen_at FROM listings WHERE watchers IN (7, 13)""",
      "listings")
check("ingest_counts",
      lambda t: streams.ingest_counts(t.spark, _ingested(t)).agg(
          F.count("*").alias("batches"), F.sum("pages").alias("pages"),
          F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")),
      """SELECT 2 AS batches, count(*) AS pages, count(*) FILTER (watchers NOT IN (7, 13)) AS accepted,
  count(*) FILTER (watchers IN (7, 13)) AS rejected FROM listings""", "listings")


def _merged(t):
    """Stored listings of an earlier sighting, part of which the incoming pages replace."""
    # both sides come from the accepted listings; the pages are parsed once
    accepted = written(split_gate(ingest(t.listing_pages))[0], "accepted")
    first = F.lit(NOW - timedelta(days=1)).cast("timestamp")
    stored = accepted.withColumns({"scraped_at": first, "title": F.lit("stored")})
    fresh = accepted.where("image_count % 2 = 0").withColumn(
        "scraped_at", F.lit(NOW).cast("timestamp"))
    return merge(stored, fresh).select(
        "listing_id", "url", (F.col("title") == "stored").alias("is_stored"))


check("batch_ingest_merge", _merged,
      """SELECT replace(url, 'https://shop.example.com/itm/', '') AS listing_id, url,
  bool_and(image_count % 2 = 0) AS is_stored FROM listings WHERE watchers NOT IN (7, 13)
  GROUP BY url""", "listings")
check("stream_unseen",
      lambda t: streams.run_updates(
          t.spark,
          streams.unseen(
              streams.read_stream(
                  t.spark, t.dir, t.spark.read.parquet(f"{t.dir}/events.parquet").schema,
                  files="events.parquet").select(*request_columns()), "url", None).select("url"),
          work_dir(t.spark, "unseen"), ["url"]),
      "SELECT DISTINCT url FROM requests", "requests")
check("filter_then_export_count",
      lambda t: apply_filter(t.listings, ListingFilter(category="rings")).agg(
          F.count("*").alias("records")),
      "SELECT count(*) AS records FROM listings WHERE category = 'rings'", "listings")


def _clustered(t, *wanted):
    """Listings written along the price and time curve, read back for a search."""
    path = work_dir(t.spark, "clustered")
    layout.write_clustered(t.listings, path)
    columns = ["listing_id", "url", "category", "price", "scraped_at"]
    stored = t.spark.read.schema(t.listings.schema).parquet(path)
    return stored.where(*wanted).select(*columns)


CLUSTERED = "SELECT listing_id, url, category, price, scraped_at FROM listings WHERE "
check("clustered_range_search",
      lambda t: _clustered(t, F.expr("""category = 'rings' AND price BETWEEN 500 AND 2000
        AND scraped_at >= TIMESTAMP '1996-01-01 00:00:00'""")),
      CLUSTERED + """category = 'rings' AND price BETWEEN 500 AND 2000
  AND scraped_at >= TIMESTAMP '1996-01-01 00:00:00'""", "listings")
check("clustered_url_lookup",
      lambda t: _clustered(t, F.col("url") == t.listings.agg(F.max("url")).first()[0]),
      CLUSTERED + "url = (SELECT max(url) FROM listings)", "listings")
