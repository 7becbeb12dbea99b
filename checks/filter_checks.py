"""Projection, predicate, sort, paging and fluent-query checks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from bazaarlens.functions import scoring
from bazaarlens.functions.bands import quality_class
from bazaarlens.operators import filters as flt
from bazaarlens.operators.filters import ListingFilter
from bazaarlens.plans import query as Q
from bazaarlens.plans.query import ListingQuery, SortChoice
from bazaarlens.sources.derived import AS_OF as NOW
from bazaarlens.sources.derived import datetime
from bazaarlens.session import work_dir
from checks.catalog import check
from checks.tables import AS_OF

SUMMARY = """listing_id, title, price, currency, category, material, brand, seller_name, condition,
  round(data_completeness_score, 4) AS data_completeness_score, image_count, watchers, views,
  scraped_at, url"""


def found(name: str, build, where: str, *tables: str) -> None:
    """Ids and prices of the rows a predicate keeps."""
    check(
        name,
        lambda t: build(t).select("listing_id", "price"),
        f"SELECT listing_id, price FROM listings WHERE {where}",
        "listings", *tables,
    )


def q(t) -> ListingQuery:
    return ListingQuery(t.listings, NOW)


check("select_summary", lambda t: Q.listing_query(t.listings).build(),
      f"SELECT {SUMMARY} FROM listings", "listings")
check("select_all", lambda t: q(t).select_all().build(),
      """SELECT * EXCLUDE (listing_status, created_at, seller_rating, data_completeness_score),
  round(seller_rating, 4) AS seller_rating,
  round(data_completeness_score, 4) AS data_completeness_score FROM listings""", "listings")
check("select_distinct", lambda t: q(t).select("category", "material", "brand").distinct().build(),
      "SELECT DISTINCT category, material, brand FROM listings", "listings")

for name, op, value, where in [
    ("equal", "=", 3, "bids = 3"),
    ("not_equal", "!=", 3, "bids <> 3"),
    ("greater", ">", 3, "bids > 3"),
    ("at_least", ">=", 3, "bids >= 3"),
    ("less", "<", 3, "bids < 3"),
    ("at_most", "<=", 3, "bids <= 3"),
    ("in", "in", [1, 5], "bids IN (1, 5)"),
    ("in_single", "in", 2, "bids = 2"),
    ("not_in", "not in", [1, 5], "bids NOT IN (1, 5)"),
    ("is_null", "is null", None, "bids IS NULL"),
    ("is_not_null", "is not null", None, "bids IS NOT NULL"),
]:
    found(f"where_{name}", lambda t, op=op, value=value: q(t).where("bids", op, value).build(), where)
found("where_between", lambda t: q(t).price_between(500, 501.5).build(),
      "price BETWEEN 500 AND 501.5")
found("where_like_ignores_case", lambda t: q(t).where("title", "like", "RED %ing").build(),
      "title ILIKE 'RED %ing'")
found("where_ilike", lambda t: q(t).where("seller_name", "ilike", "supplier%7").build(),
      "seller_name ILIKE 'supplier%7'")
found("filter_scalar_and_list",
      lambda t: q(t).category("rings").material(["small", "promo"]).brand("Brand#3").build(),
      "category = 'rings' AND material IN ('small', 'promo') AND brand = 'Brand#3'")
found("filter_gemstone_seller",
      lambda t: q(t).gemstone(["ruby", "pearl"]).seller("Supplier#000000007").build(),
      "main_stone IN ('ruby', 'pearl') AND seller_name = 'Supplier#000000007'")
found("filter_has_gemstone", lambda t: q(t).has_gemstone().price_range(4000).build(),
      "main_stone <> '' AND price >= 4000")
found("filter_thresholds",
      lambda t: q(t).price_range(100, 900).quality_range(0.5, 0.9).has_watchers(10).has_bids(2)
      .has_images(3).build(),
      """price BETWEEN 100 AND 900 AND data_completeness_score BETWEEN 0.5 AND 0.9
  AND watchers >= 10 AND bids >= 2 AND image_count >= 3""")
found("filter_validated", lambda t: q(t).validated_only().high_quality(0.9).build(),
      "is_validated AND data_completeness_score >= 0.9")
found("filter_scraped_window",
      lambda t: q(t).scraped_after(datetime(2001, 1, 1)).scraped_before(datetime(2001, 2, 1)).build(),
      "scraped_at BETWEEN TIMESTAMP '2001-01-01' AND TIMESTAMP '2001-02-01'")
found("filter_today", lambda t: q(t).scraped_today().build(), f"scraped_at >= {AS_OF}")
found("filter_last_week", lambda t: q(t).scraped_last_days(7).build(),
      f"scraped_at >= {AS_OF} - INTERVAL 7 DAY")
for kind, days in flt.TIME_RANGES.items():
    found(f"time_range_{kind}", lambda t, kind=kind: q(t).where(flt.time_range(kind, NOW)).build(),
          f"scraped_at >= {AS_OF} - INTERVAL {days} DAY")
found("time_range_custom",
      lambda t: q(t).where(flt.time_range("custom", NOW, datetime(2000, 5, 1), datetime(2000, 5, 9)))
      .build(),
      "scraped_at BETWEEN TIMESTAMP '2000-05-01' AND TIMESTAMP '2000-05-09'")
found("search_text", lambda t: q(t).search_text("D RI").build(),
      "title ILIKE '%D RI%' OR description ILIKE '%D RI%'")
found("search_brand_seller",
      lambda t: q(t).filter(ListingFilter(brand_contains="brand#1", seller_contains="0001")).build(),
      "brand ILIKE '%brand#1%' AND seller_name ILIKE '%0001%'")


def _one_filter(t):
    return flt.apply_filter(
        t.full,
        ListingFilter(
            category=["rings", "earrings"],
            condition="new",
            listing_status=["sold", "active"],
            currency="USD",
            has_original_price=True,
            quality_class=["good", "fair"],
            created_after=datetime(1997, 1, 1),
            created_before=datetime(2001, 1, 1),
            max_watchers=40,
            min_views=20,
            max_views=450,
            has_bids=True,
            min_seller_rating=82,
            max_seller_rating=99,
            max_image_count=6,
            min_description_length=14,
            search_title="i",
            search_description="l",
            extra=[F.col("price") > 60],
        ),
    )


found("filter_object", _one_filter,
      """category IN ('rings', 'earrings') AND condition = 'new'
  AND listing_status IN ('sold', 'active') AND original_price > 0
  AND data_completeness_score >= 0.5 AND data_completeness_score < 0.9
  AND created_at BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '2001-01-01'
  AND watchers <= 40 AND views BETWEEN 20 AND 450 AND bids > 0
  AND seller_rating BETWEEN 82 AND 99 AND image_count <= 6 AND length(description) >= 14
  AND title ILIKE '%i%' AND description ILIKE '%l%' AND price > 60""")
check(
    "filter_image_quality",
    lambda t: flt.apply_filter(t.listings, ListingFilter(min_image_quality=0.6), t.images).select(
        "listing_id", "avg_image_quality"
    ),
    """SELECT listing_id, round(avg(i.quality_score), 4) AS avg_image_quality
  FROM listings JOIN images i USING (listing_id) GROUP BY ALL HAVING avg(i.quality_score) >= 0.6""",
    "listings", "images",
)
found("filter_flags_off",
      lambda t: flt.apply_filter(
          t.listings, ListingFilter(is_validated=False, has_images=False, has_gemstone=False)),
      """NOT is_validated AND NOT coalesce(image_count > 0, false)
  AND NOT coalesce(main_stone <> '', false)""")
_TYPED = """(SELECT *, CASE bids WHEN 1 THEN 'Buy It Now' WHEN 2 THEN 'Auction' END AS listing_type,
  (watchers % 5)::DOUBLE AS shipping_cost, views % 3 = 0 AS has_video FROM listings)"""
check(
    "filter_formats_shipping",
    lambda t: flt.apply_filter(
        t.listings.withColumns(
            {
                "listing_type": F.when(F.col("bids") == 1, "Buy It Now").when(
                    F.col("bids") == 2, "Auction"
                ),
                "shipping_cost": (F.col("watchers") % 5).cast("double"),
                "has_video": F.col("views") % 3 == 0,
            }
        ),
        ListingFilter(auction_format=True, free_shipping=True, has_video=False,
                      buy_it_now_format=False),
    ).select("listing_id"),
    f"""SELECT listing_id FROM {_TYPED} WHERE listing_type = 'Auction' AND shipping_cost = 0
  AND NOT has_video""",
    "listings",
)

check("listing_by_id", lambda t: Q.listing_by_id(t.listings, "7341-3-499-12").select("listing_id", "title"),
      "SELECT listing_id, title FROM listings WHERE listing_id = '7341-3-499-12'", "listings")
check("images_of_listing",
      lambda t: Q.images_of(t.images, "7341-3-499-12").select("image_id", "sequence_order"),
      """SELECT image_id, sequence_order FROM images WHERE listing_id = '7341-3-499-12'""", "images")
check(
    "enhanced_summary",
    lambda t: t.base.select(*scoring.summary_columns()),
    """SELECT listing_id, title, currency || ' ' || format('{:.2f}', price) AS price,
  currency || ' ' || format('{:.2f}', original_price) AS original_price, category, material,
  coalesce(brand, 'Unknown') AS brand, condition, seller_name AS seller,
  format('{:.1f}%', seller_rating) AS seller_rating, image_count AS images, watchers, bids,
  format('{:.1f}%', data_completeness_score * 100) AS quality_score,
  CASE WHEN data_completeness_score >= 0.9 THEN 'excellent'
    WHEN data_completeness_score >= 0.7 THEN 'good' WHEN data_completeness_score >= 0.5 THEN 'fair'
    WHEN data_completeness_score >= 0.3 THEN 'poor' ELSE 'invalid' END AS quality_class,
  strftime(scraped_at, '%Y-%m-%d %H:%M') AS scraped, is_validated AS validated, url FROM base""",
    "base",
)
check("quality_classes", lambda t: t.listings.groupBy(quality_class().alias("quality_class")).count(),
      """SELECT CASE WHEN data_completeness_score >= 0.9 THEN 'excellent'
    WHEN data_completeness_score >= 0.7 THEN 'good' WHEN data_completeness_score >= 0.5 THEN 'fair'
    WHEN data_completeness_score >= 0.3 THEN 'poor' ELSE 'invalid' END AS quality_class,
  count(*) AS count FROM listings GROUP BY 1""", "listings")

# Sort and paging: a total order makes every place and page exact.
def placed(df):
    """Every row with its place in the order the query gives: numbered inside the partitions of the
    sort, each of which begins where the ones before it end."""
    path = work_dir(df.sparkSession, "placed")
    df.select(
        "*", F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_nth"),
    ).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    # one row per partition of the sort
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = (F.col("_before") + F.col("_nth") + 1).alias("place")
    return rows.join(starts, "_part").select(*df.columns, place)


for name, choice, order in [
    ("price_asc", SortChoice(price_asc=True), "price"),
    ("price_desc", SortChoice(price_desc=True), "price DESC"),
    ("quality", SortChoice(quality_desc=True), "data_completeness_score DESC"),
    ("popularity", SortChoice(popularity_desc=True), "watchers + views DESC"),
    ("newest", SortChoice(newest=True), "scraped_at DESC"),
    ("column", SortChoice(column="bids", ascending=False), "bids DESC NULLS LAST"),
]:
    choice.then = (("listing_id", True),)
    check(
        f"sort_{name}",
        lambda t, choice=choice: placed(q(t).select("listing_id", "title").sort(choice).build()),
        f"""SELECT listing_id, title, row_number() OVER (ORDER BY {order}, listing_id) AS place
  FROM listings""",
        "listings",
    )
check("sort_multi_key",
      lambda t: placed(q(t).select("listing_id").order_by("category").order_by("price", False)
                       .order_by("listing_id").build()),
      """SELECT listing_id, row_number() OVER (ORDER BY category, price DESC, listing_id) AS place
  FROM listings""", "listings")
check("sort_ending_soon",
      lambda t: placed(Q.ListingQuery(
          t.listings.withColumn("end_time", F.when(F.col("bids") > 2, F.col("scraped_at"))), NOW)
          .select("listing_id").sort(SortChoice(ending_soon=True, then=(("listing_id", True),)))
          .build()),
      """SELECT listing_id, row_number() OVER (
    ORDER BY CASE WHEN bids > 2 THEN scraped_at END NULLS FIRST, listing_id) AS place
  FROM listings""", "listings")
check("page_three",
      lambda t: q(t).select("listing_id").order_by_price().order_by("listing_id").page(3, 25).build(),
      "SELECT listing_id FROM listings ORDER BY price, listing_id LIMIT 25 OFFSET 50", "listings")
check("offset_alone",
      lambda t: q(t).validated_only().select("listing_id").order_by_price().order_by("listing_id")
      .offset(1000).build(),
      "SELECT listing_id FROM base ORDER BY price, listing_id OFFSET 1000", "base")
check("recent_listings", lambda t: Q.recent_listings(t.listings, 30).select("listing_id", "title"),
      "SELECT listing_id, title FROM listings ORDER BY scraped_at DESC, listing_id LIMIT 30",
      "listings")
check("high_quality_query", lambda t: Q.high_quality_query(t.listings).build(),
      f"SELECT {SUMMARY} FROM base WHERE data_completeness_score >= 0.8 AND image_count > 0", "base")
check("recent_query", lambda t: Q.recent_query(t.listings, NOW, 7).build(),
      f"SELECT {SUMMARY} FROM listings WHERE scraped_at >= {AS_OF} - INTERVAL 7 DAY", "listings")
check("popular_query",
      lambda t: placed(Q.popular_query(t.listings).order_by("listing_id").build()),
      f"""SELECT {SUMMARY}, row_number() OVER (ORDER BY watchers + views DESC, listing_id) AS place
  FROM listings WHERE watchers > 0""", "listings")
check("category_query", lambda t: Q.category_query(t.listings, "rings").build(),
      """SELECT category, count(*) AS listing_count, round(avg(price), 4) AS avg_price,
  min(price) AS min_price, max(price) AS max_price,
  round(avg(data_completeness_score), 4) AS avg_quality FROM base WHERE category = 'rings'
  GROUP BY category""", "base")
check(
    "group_by_having",
    lambda t: q(t).group_by("brand", "condition")
    .agg(F.count("*").alias("n"), F.max("price").alias("top")).having("n", ">=", 500)
    .having("top", "<", 60000).build(),
    """SELECT brand, condition, count(*) AS n, max(price) AS top FROM listings GROUP BY ALL
  HAVING count(*) >= 500 AND max(price) < 60000""",
    "listings",
)
check("count_query",
      lambda t: q(t).category(["rings", "watches"]).order_by_price().page(2, 10).count(),
      "SELECT count(*) AS total FROM listings WHERE category IN ('rings', 'watches')", "listings")
