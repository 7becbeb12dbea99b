"""Reports, views and store statistics."""

from datetime import timedelta

from pyspark.sql import functions as F

from bazaarlens.plans import partials as P
from bazaarlens.plans import reports as R
from bazaarlens.plans import stats as S
from bazaarlens.plans import views as V
from bazaarlens.plans.reports import base
from bazaarlens.session import work_dir
from bazaarlens.sources import derived
from checks.catalog import CHECKS, check
from checks.tables import AS_OF

PRICES = "round(avg(price), 4) AS avg_price, min(price) AS min_price, max(price) AS max_price"
QUALITY = "round(avg(data_completeness_score), 4) AS avg_quality"
PRICE_BAND = """CASE WHEN price < 100 THEN 'Under $100' WHEN price < 500 THEN '$100-$500'
  WHEN price < 1000 THEN '$500-$1,000' WHEN price < 5000 THEN '$1,000-$5,000'
  ELSE 'Over $5,000' END"""
HIGH = "count(*) FILTER (data_completeness_score >= 0.8)"
STONES = "count(*) FILTER (main_stone <> '')"


def avg(column: str, name: str | None = None) -> str:
    return f"round(avg({column}), 4) AS {name or 'avg_' + column}"


OVERVIEW = f"""
SELECT count(*) AS total_listings, count(DISTINCT category) AS unique_categories,
  count(DISTINCT material) AS unique_materials, count(DISTINCT seller_name) AS unique_sellers,
  count(DISTINCT brand) AS unique_brands, {PRICES}, {QUALITY},
  sum(image_count)::BIGINT AS total_images, {avg('image_count', 'avg_images_per_listing')},
  sum(watchers)::BIGINT AS total_watchers, sum(views)::BIGINT AS total_views,
  sum(bids)::BIGINT AS total_bids, {STONES} AS listings_with_gemstones
FROM base"""
check("overview", lambda t: R.overview(t.base), OVERVIEW, "base")
check(
    "overview_last_year",
    lambda t: R.overview(base(t.listings, t.request(time_range="year"))),
    OVERVIEW + f" WHERE scraped_at >= {AS_OF} - INTERVAL 365 DAY",
    "base",
)
check(
    "overview_filtered",
    lambda t: R.overview(
        base(
            t.listings,
            t.request(
                time_range="custom",
                start=derived.datetime(1999, 1, 1),
                end=derived.datetime(2001, 6, 30),
                categories=("rings", "watches"),
                materials=("economy", "small"),
                min_price=100,
                max_price=4000,
                min_quality=0.3,
            ),
        )
    ),
    OVERVIEW
    + """ WHERE scraped_at BETWEEN TIMESTAMP '1999-01-01' AND TIMESTAMP '2001-06-30'
  AND category IN ('rings', 'watches') AND material IN ('economy', 'small')
  AND price BETWEEN 100 AND 4000 AND data_completeness_score >= 0.3""",
    "base",
)
check(
    "price_distribution",
    lambda t: R.price_distribution(t.base),
    f"""SELECT {PRICE_BAND} AS price_range, count(*) AS count,
  round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS percentage FROM base GROUP BY 1""",
    "base",
)
for column, query in [("category", R.top_categories), ("material", R.top_materials)]:
    check(
        query.__name__,
        lambda t, query=query: query(t.base),
        f"""SELECT {column}, count(*) AS count FROM base GROUP BY ALL
  ORDER BY count DESC, {column} LIMIT 10""",
        "base",
    )
check(
    "category_summary",
    lambda t: R.category_summary(t.base),
    f"""SELECT category, count(*) AS listing_count, {PRICES}, {QUALITY},
  {avg('image_count', 'avg_images')}, {avg('watchers')}, {avg('views')},
  {STONES} AS with_gemstones, count(DISTINCT seller_name) AS unique_sellers,
  count(DISTINCT brand) AS unique_brands FROM base GROUP BY category""",
    "base",
)
check(
    "category_materials",
    lambda t: R.category_materials(t.base),
    f"""SELECT category, material, count(*) AS count, {avg('price')} FROM base
  GROUP BY ALL HAVING count(*) >= 3""",
    "base",
)
check(
    "category_price_ranges",
    lambda t: R.category_price_ranges(t.base),
    f"SELECT category, {PRICE_BAND} AS price_range, count(*) AS count FROM base GROUP BY ALL",
    "base",
)
check(
    "price_by_category",
    lambda t: R.price_by_category(t.base),
    f"""SELECT category, count(*) AS count, {PRICES},
  round(coalesce(stddev_samp(price), 0), 4) AS price_stddev
  FROM base GROUP BY category HAVING count(*) >= 5""",
    "base",
)
check(
    "price_by_material",
    lambda t: R.price_by_material(t.base),
    f"SELECT material, count(*) AS count, {PRICES} FROM base GROUP BY material HAVING count(*) >= 5",
    "base",
)
check(
    "most_expensive",
    lambda t: R.most_expensive(t.base),
    """SELECT listing_id, title, price, currency, category, material, brand, seller_name,
  watchers, views FROM base ORDER BY price DESC NULLS LAST, listing_id LIMIT 20""",
    "base",
)
check(
    "price_trends",
    lambda t: R.price_trends(t.base),
    f"""SELECT scraped_at::DATE AS date, count(*) AS listings_count, {PRICES} FROM base
  GROUP BY 1 ORDER BY date DESC LIMIT 30""",
    "base",
)
check(
    "top_sellers_by_count",
    lambda t: R.top_sellers_by_count(t.base).drop("avg_feedback_count"),
    f"""SELECT seller_name, count(*) AS listing_count, {PRICES},
  {avg('seller_rating', 'avg_rating')}, {QUALITY}, count(DISTINCT category) AS categories_sold,
  {avg('watchers')}, {avg('views')} FROM base GROUP BY seller_name HAVING count(*) >= 3
  ORDER BY listing_count DESC, seller_name LIMIT 50""",
    "base",
)
check(
    "top_sellers_by_value",
    lambda t: R.top_sellers_by_value(t.base),
    f"""SELECT seller_name, count(*) AS listing_count, round(sum(price), 4) AS total_value,
  {avg('price')}, {avg('seller_rating', 'avg_rating')}, {QUALITY}
  FROM base GROUP BY seller_name HAVING count(*) >= 3
  ORDER BY total_value DESC, seller_name LIMIT 20""",
    "base",
)
check(
    "seller_rating_distribution",
    lambda t: R.seller_rating_distribution(t.base),
    """SELECT CASE WHEN seller_rating >= 99 THEN '99-100%' WHEN seller_rating >= 95 THEN '95-99%'
  WHEN seller_rating >= 90 THEN '90-95%' WHEN seller_rating >= 80 THEN '80-90%'
  ELSE 'Under 80%' END AS rating_range, count(DISTINCT seller_name) AS seller_count,
  count(*) AS listing_count FROM base WHERE seller_rating IS NOT NULL GROUP BY 1""",
    "base",
)
check(
    "quality_distribution",
    lambda t: R.quality_distribution(t.base),
    """SELECT CASE WHEN s >= 0.9 THEN 'Excellent (90-100%)' WHEN s >= 0.7 THEN 'Good (70-89%)'
  WHEN s >= 0.5 THEN 'Fair (50-69%)' WHEN s >= 0.3 THEN 'Poor (30-49%)'
  ELSE 'Very Poor (0-29%)' END AS quality_range, count(*) AS count,
  round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS percentage
  FROM (SELECT data_completeness_score AS s FROM base) GROUP BY 1""",
    "base",
)
check(
    "quality_by_category",
    lambda t: R.quality_by_category(t.base),
    f"""SELECT category, count(*) AS count, {QUALITY}, {HIGH} AS high_quality_count,
  round({HIGH} * 100.0::DOUBLE / count(*), 2) AS high_quality_percentage
  FROM base GROUP BY category""",
    "base",
)
FILLED = {
    "title_completeness": "title <> ''",
    "description_completeness": "description <> ''",
    "brand_completeness": "brand <> ''",
    "gemstone_completeness": "main_stone <> ''",
    "size_completeness": "false",
    "image_completeness": "image_count > 0",
    "seller_rating_completeness": "seller_rating IS NOT NULL",
}
check(
    "field_completeness",
    lambda t: R.field_completeness(t.base),
    "SELECT "
    + ", ".join(
        f"round(count(*) FILTER ({test}) * 100.0::DOUBLE / count(*), 4) AS {name}"
        for name, test in FILLED.items()
    )
    + " FROM base",
    "base",
)
check(
    "field_completeness_long",
    lambda t: R.field_completeness_long(t.base),
    " UNION ALL ".join(
        f"SELECT '{name}' AS field, round(count(*) FILTER ({test}) * 100.0::DOUBLE / count(*), 4) "
        "AS completeness FROM base"
        for name, test in FILLED.items()
    ),
    "base",
)
check(
    "daily_trends",
    lambda t: R.daily_trends(t.base),
    f"""SELECT scraped_at::DATE AS date, count(*) AS listings_count,
  count(DISTINCT seller_name) AS unique_sellers, {avg('price')}, {QUALITY},
  sum(image_count)::BIGINT AS total_images FROM base GROUP BY 1 ORDER BY date DESC LIMIT 30""",
    "base",
)
check(
    "category_trends",
    lambda t: R.category_trends(t.base),
    f"""SELECT scraped_at::DATE AS date, category, count(*) AS count, {avg('price')} FROM base
  GROUP BY ALL ORDER BY date DESC, count DESC, category LIMIT 100""",
    "base",
)
check(
    "quality_trends",
    lambda t: R.quality_trends(t.base),
    f"""SELECT scraped_at::DATE AS date, {QUALITY}, {HIGH} AS high_quality_count,
  count(*) AS total_count FROM base GROUP BY 1 ORDER BY date DESC LIMIT 30""",
    "base",
)
ENGAGED = "(watchers > 0 OR views > 0 OR bids > 0)"
check(
    "hot_categories",
    lambda t: R.hot_categories(t.base),
    f"""SELECT category, count(*) AS listing_count, {avg('watchers')}, {avg('views')},
  {avg('bids')}, {avg('price')},
  sum(watchers + views + coalesce(bids, 0))::BIGINT AS total_engagement
  FROM base WHERE {ENGAGED} GROUP BY category HAVING count(*) >= 10
  ORDER BY total_engagement DESC NULLS LAST, category LIMIT 10""",
    "base",
)
check(
    "undervalued_items",
    lambda t: R.undervalued_items(t.base),
    f"""SELECT listing_id, title, price, category, material, watchers, views, bids,
  round(data_completeness_score, 4) AS data_completeness_score, round(e, 4) AS engagement_per_dollar
  FROM (SELECT *, (watchers + views + coalesce(bids, 0)) / price AS e FROM base
        WHERE {ENGAGED} AND price > 0)
  ORDER BY e DESC NULLS LAST, listing_id LIMIT 20""",
    "base",
)
check(
    "premium_brands",
    lambda t: R.premium_brands(t.base),
    f"""SELECT brand, count(*) AS listing_count, {avg('price')}, {avg('watchers')}, {QUALITY},
  count(DISTINCT category) AS categories FROM base
  WHERE brand <> '' AND price >= (SELECT avg(price) FROM base)
  GROUP BY brand HAVING count(*) >= 5 ORDER BY avg(price) DESC, brand LIMIT 15""",
    "base",
)
check(
    "gemstone_popularity",
    lambda t: R.gemstone_popularity(t.base),
    f"""SELECT main_stone, count(*) AS listing_count, {avg('price')}, {avg('watchers')},
  count(DISTINCT category) AS categories FROM base WHERE main_stone <> ''
  GROUP BY main_stone HAVING count(*) >= 5 ORDER BY listing_count DESC, main_stone LIMIT 15""",
    "base",
)
SESSIONS_AS_OF = derived.datetime(2001, 7, 15)
check(
    "session_metrics",
    lambda t: R.session_metrics(t.sessions, SESSIONS_AS_OF, days=400),
    """SELECT round(avg(CASE WHEN listings_scraped + listings_failed > 0
    THEN listings_scraped * 100.0::DOUBLE / (listings_scraped + listings_failed) ELSE 0 END), 4)
    AS avg_success_rate, round(avg(average_quality_score), 4) AS avg_quality_score,
  sum(listings_scraped)::BIGINT AS total_scraped, sum(listings_failed)::BIGINT AS total_failed,
  round(avg(epoch(completed_at - started_at) / 60), 4) AS avg_duration_minutes
  FROM sessions WHERE started_at >= TIMESTAMP '2001-07-15' - INTERVAL 400 DAY""",
    "sessions",
)
check(
    "recent_quality",
    lambda t: R.recent_quality(t.listings, derived.AS_OF),
    f"""SELECT {avg('data_completeness_score', 'current_avg_quality')},
  round({HIGH} * 100.0::DOUBLE / count(*), 4) AS high_quality_percentage,
  round(count(*) FILTER (is_validated) * 100.0::DOUBLE / count(*), 4) AS validation_percentage
  FROM listings WHERE scraped_at >= {AS_OF} - INTERVAL 7 DAY""",
    "listings",
)
check(
    "executive_summary",
    lambda t: R.executive_summary(t.base).selectExpr(
        "total_listings", "avg_price", "avg_quality", "total_sellers",
        "array_join(key_insights, '; ') AS key_insights",
    ),
    """SELECT total_listings, avg_price, round(q, 3) AS avg_quality, total_sellers,
  concat_ws('; ', CASE WHEN total_listings > 1000 THEN 'Large dataset with over 1,000 listings' END,
    CASE WHEN q > 0.8 THEN 'High average data quality (>80%)'
         WHEN q < 0.5 THEN 'Data quality needs improvement (<50%)' END) AS key_insights
  FROM (SELECT count(*) AS total_listings, round(avg(price), 2) AS avg_price,
    avg(data_completeness_score) AS q, count(DISTINCT seller_name) AS total_sellers FROM base)""",
    "base",
)
check(
    "category_insights_rings",
    lambda t: R.category_insights(t.listings, "rings", t.request())["category_summary"].select(
        "category", "listing_count", "avg_price"
    ),
    f"""SELECT category, count(*) AS listing_count, {avg('price')} FROM base
  WHERE category = 'rings' GROUP BY ALL""",
    "base",
)
check(
    "price_analysis_range",
    lambda t: R.price_analysis(t.listings, 500, 2000, t.request())["price_by_material"],
    f"""SELECT material, count(*) AS count, {PRICES} FROM base WHERE price BETWEEN 500 AND 2000
  GROUP BY material HAVING count(*) >= 5""",
    "base",
)
check(
    "dashboard_bundle",
    lambda t: _bundle(t, R.DASHBOARD),
    """SELECT 'summary.top_categories' AS part, category AS name, count(*) AS listings
  FROM base GROUP BY ALL UNION ALL
  SELECT 'category_analysis.category_summary', category, count(*) FROM base GROUP BY ALL UNION ALL
  SELECT 'quality_analysis.quality_by_category', category, count(*) FROM base GROUP BY ALL""",
    "base",
)
check(
    "market_bundle",
    lambda t: _bundle(t, R.MARKET),
    """SELECT 'market_insights.hot_categories' AS part, category AS name, count(*) AS listings
  FROM base WHERE watchers > 0 OR views > 0 OR bids > 0 GROUP BY ALL HAVING count(*) >= 10
  UNION ALL
  SELECT 'price_analysis.price_by_category', category, count(*) FROM base GROUP BY ALL
  HAVING count(*) >= 5 UNION ALL
  SELECT 'category_analysis.category_summary', category, count(*) FROM base GROUP BY ALL""",
    "base",
)


def _bundle(t, kinds):
    """Per-category counts of every bundled part that has them."""
    from functools import reduce

    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F

    reports, _ = R.bundle(kinds, t.listings, t.request())
    parts = []
    for kind, made in reports.items():
        for name, df in made.items():
            count = next((c for c in ("count", "listing_count") if c in df.columns), None)
            per_category = df.columns[0] == "category" and df.columns[1] == count
            if per_category and name not in ("category_trends",):
                parts.append(
                    df.select(
                        F.lit(f"{kind}.{name}").alias("part"),
                        F.col("category").alias("name"),
                        F.col(count).alias("listings"),
                    )
                )
    return reduce(DataFrame.unionByName, parts)


def _part_sizes(t, kinds):
    """Rows of every part of a bundle."""
    from functools import reduce

    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F

    reports, _ = R.bundle(kinds, t.listings, t.request())
    sizes = [
        df.agg(F.count("*").alias("rows")).select(F.lit(f"{kind}.{name}").alias("part"), "rows")
        for kind, made in reports.items() for name, df in made.items()
    ]
    return reduce(DataFrame.unionByName, sizes)


for _name, _kinds in (("dashboard_parts", R.DASHBOARD), ("market_parts", R.MARKET)):
    check(
        _name,
        lambda t, kinds=_kinds: _part_sizes(t, kinds),
        " UNION ALL ".join(
            f"SELECT '{kind}.{part}' AS part, count(*) AS rows FROM ({CHECKS[part].sql})"
            for kind in _kinds for part in R.REPORTS[kind]
        ),
    )


# Stored days and one pass ----------------------------------------------------------------

def _stored_days(t):
    """Measures of some hundred days, stored by two refreshes that overlap."""
    end = t.listings.agg(F.max(F.to_date("scraped_at"))).first()[0]
    store = P.DailyPartials(t.spark, work_dir(t.spark, "days"))
    for first, last in ((150, 80), (90, 10)):
        store.refresh(t.listings, end - timedelta(days=first), end - timedelta(days=last))
    return store


for _kind, _part in (
    ("summary", "overview"), ("category_analysis", "category_summary"),
    ("price_analysis", "price_by_category"), ("seller_analysis", "seller_rating_distribution"),
):
    check(
        f"stored_days_{_part}",
        lambda t, kind=_kind, part=_part: _stored_days(t).report(kind, t.listings, t.request())[part],
        CHECKS[_part].sql,
    )
check(
    "stored_days_daily_trends",
    lambda t: _stored_days(t).report("trend_analysis", t.listings, t.request())["daily_trends"].select(
        "date", "listings_count", "unique_sellers", "total_images",
        *[F.round(F.col(c) * F.col("listings_count"), 2).alias(c.replace("avg", "sum"))
          for c in ("avg_price", "avg_quality")],
    ),
    """SELECT scraped_at::DATE AS date, count(*) AS listings_count,
  count(DISTINCT seller_name) AS unique_sellers, sum(image_count)::BIGINT AS total_images,
  round(sum(price), 2) AS sum_price, round(sum(data_completeness_score), 2) AS sum_quality
  FROM base GROUP BY 1 ORDER BY 1 DESC LIMIT 30""",
    "base",
)
check(
    "one_pass_top_sellers_by_count",
    lambda t: P.one_pass_bundle(["seller_analysis"], t.listings, t.request())["seller_analysis"][
        "top_sellers_by_count"].drop("avg_feedback_count"),
    CHECKS["top_sellers_by_count"].sql,
)
check(
    "stored_days_last_year",
    lambda t: _stored_days(t).report("summary", t.listings, t.request(time_range="year"))["overview"],
    CHECKS["overview_last_year"].sql,
)
for _kind, _part in (
    ("summary", "price_distribution"), ("category_analysis", "category_materials"),
    ("quality_analysis", "quality_by_category"), ("quality_analysis", "field_completeness"),
    ("trend_analysis", "category_trends"),
):
    check(
        f"one_pass_{_part}",
        lambda t, kind=_kind, part=_part: P.one_pass_bundle([kind], t.listings, t.request())[kind][part],
        CHECKS[_part].sql,
    )


# Views ---------------------------------------------------------------------------------

check(
    "high_quality_listings",
    lambda t: V.high_quality_listings(t.listings),
    """SELECT listing_id, title, price, currency, category, material, brand, seller_name,
  round(seller_rating, 4) AS seller_rating,
  round(data_completeness_score, 4) AS data_completeness_score, image_count, watchers, views,
  scraped_at, url FROM base WHERE data_completeness_score >= 0.7 AND image_count > 0""",
    "base",
)
check(
    "listing_summaries",
    lambda t: V.listing_summaries(t.listings, t.images, t.specifications),
    """SELECT listing_id, title, price, original_price, currency, category, material, brand,
  seller_name, round(seller_rating, 4) AS seller_rating, condition,
  round(data_completeness_score, 4) AS data_completeness_score, image_count, watchers, views, bids,
  scraped_at, is_validated, url, round(coalesce(q, 0), 4) AS avg_image_quality,
  coalesce(s, 0) AS specification_count
  FROM base LEFT JOIN (SELECT listing_id, avg(quality_score) AS q FROM images
      WHERE quality_score IS NOT NULL GROUP BY 1) USING (listing_id)
  LEFT JOIN (SELECT listing_id, count(*) AS s FROM specifications GROUP BY 1) USING (listing_id)""",
    "base", "images", "specifications",
)
COUNTS = f"""count(*) FILTER (watchers > 0) AS listings_with_watchers,
  count(*) FILTER (bids > 0) AS listings_with_bids, {avg('watchers')}, {avg('views')},
  count(*) FILTER (listing_status = 'sold') AS sold_count"""
check(
    "category_statistics",
    lambda t: V.category_statistics(t.full),
    f"""SELECT category, count(*) AS listing_count, {PRICES}, {QUALITY},
  {avg('image_count', 'avg_images')}, {avg('seller_rating')}, {COUNTS},
  round(quantile_cont(price, 0.5), 4) AS median_price
  FROM base WHERE price > 0 GROUP BY category HAVING count(*) >= 5""",
    "base",
)
check(
    "seller_statistics",
    lambda t: V.seller_statistics(t.full).drop("avg_feedback_count"),
    f"""SELECT seller_name, count(*) AS listing_count, {PRICES},
  {avg('seller_rating', 'avg_rating')}, {QUALITY}, {avg('image_count', 'avg_images')}, {COUNTS},
  count(DISTINCT category) AS categories_sold, min(scraped_at) AS first_listing,
  max(scraped_at) AS latest_listing
  FROM base WHERE seller_name IS NOT NULL GROUP BY seller_name HAVING count(*) >= 3""",
    "base",
)
check(
    "material_price_analysis",
    lambda t: V.material_prices(t.listings),
    f"""SELECT material, category, count(*) AS listing_count, {PRICES}, {QUALITY},
  {STONES} AS with_gemstone_count, round(quantile_cont(price, 0.25), 4) AS q1_price,
  round(quantile_cont(price, 0.5), 4) AS median_price,
  round(quantile_cont(price, 0.75), 4) AS q3_price
  FROM base WHERE price > 0 GROUP BY ALL HAVING count(*) >= 3""",
    "base",
)
check(
    "session_performance",
    lambda t: V.session_performance(t.sessions, derived.AS_OF).drop(
        "progress_percentage", "average_quality_score"
    ),
    f"""SELECT session_id, status, started_at, completed_at, listings_found, listings_scraped,
  listings_failed, images_downloaded, images_failed, requests_made, requests_successful,
  round(epoch(coalesce(completed_at, {AS_OF}) - started_at) / 60, 2) AS duration_minutes,
  coalesce(round(listings_scraped * 100.0::DOUBLE / nullif(listings_scraped + listings_failed, 0),
    2), 0) AS success_rate_percent,
  coalesce(round(images_downloaded * 100.0::DOUBLE / nullif(images_downloaded + images_failed, 0),
    2), 0) AS image_success_rate_percent,
  coalesce(round(requests_successful * 100.0::DOUBLE / nullif(requests_made, 0), 2), 0)
    AS request_success_rate_percent FROM sessions""",
    "sessions",
)
check(
    "daily_activity",
    lambda t: V.daily_activity(t.listings, derived.AS_OF),
    f"""SELECT scraped_at::DATE AS scraping_date, count(*) AS listings_scraped,
  count(DISTINCT seller_name) AS unique_sellers, count(DISTINCT category) AS categories_covered,
  {PRICES}, {QUALITY}, sum(image_count)::BIGINT AS total_images,
  count(*) FILTER (is_validated) AS validated_listings, {HIGH} AS high_quality_listings
  FROM listings WHERE scraped_at >= {AS_OF} - INTERVAL 30 DAY GROUP BY 1""",
    "listings",
)
check(
    "image_quality_analysis",
    lambda t: V.image_quality(t.listings, t.images),
    """SELECT category, material, count(image_id) AS total_images,
  round(avg(quality_score), 4) AS avg_quality,
  count(*) FILTER (is_processed) AS processed_count,
  count(*) FILTER (is_duplicate) AS duplicate_count,
  count(*) FILTER (contains_text) AS with_text_count,
  round(avg(file_size) / 1024.0, 4) AS avg_size_kb
  FROM base JOIN images USING (listing_id) GROUP BY ALL HAVING count(image_id) >= 10""",
    "base", "images",
)
check(
    "simple_category_stats",
    lambda t: V.simple_category_stats(t.listings),
    f"""SELECT category, count(*) AS count, {PRICES}, {QUALITY} FROM listings WHERE price > 0
  GROUP BY category""",
    "listings",
)
check(
    "simple_seller_stats",
    lambda t: V.simple_seller_stats(t.listings),
    f"""SELECT seller_name, count(*) AS listing_count, {avg('price')},
  {avg('seller_rating', 'avg_rating')}, {QUALITY} FROM listings
  WHERE seller_name IS NOT NULL GROUP BY seller_name HAVING count(*) >= 5""",
    "listings",
)
check(
    "sql_over_views",
    lambda t: _free_sql(t),
    f"""SELECT material, count(*) AS rows, {avg('price')} FROM base
  WHERE data_completeness_score >= 0.7 AND image_count > 0 AND price >= 250 GROUP BY material""",
    "base",
)


def _free_sql(t):
    V.register(t.spark, {"listings": t.listings}, derived.AS_OF)
    return V.run_sql(
        t.spark,
        "SELECT material, count(*) AS rows, avg(price) AS avg_price FROM high_quality_listings "
        "WHERE price >= :low GROUP BY material",
        {"low": 250},
    )


# Statistics ----------------------------------------------------------------------------

check(
    "store_figures",
    lambda t: S.store_figures(t.store),
    f"""SELECT count(*) AS total_listings, {avg('data_completeness_score', 'avg_quality_score')},
  coalesce(min(price) FILTER (price > 0), 0) AS min_price,
  coalesce(max(price) FILTER (price > 0), 0) AS max_price,
  (SELECT count(*) FROM images) AS total_images,
  (SELECT count(*) FROM specifications) AS total_specifications,
  (SELECT count(*) FROM sessions) AS total_sessions FROM listings""",
    "listings", "images", "specifications", "sessions",
)
check(
    "store_breakdown",
    lambda t: S.store_breakdown(t.listings, derived.AS_OF),
    f"""SELECT 'category' AS kind, category AS name, count(*) AS listings FROM listings GROUP BY ALL
  UNION ALL SELECT 'material', material, count(*) FROM listings GROUP BY ALL
  UNION ALL SELECT 'day', scraped_at::DATE::VARCHAR, count(*) FROM listings
  WHERE scraped_at >= {AS_OF} - INTERVAL 7 DAY GROUP BY ALL""",
    "listings",
)
check(
    "category_shares",
    lambda t: S.category_shares(t.listings),
    """SELECT category, upper(category[1]) || category[2:] AS name, count(*) AS count,
  round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM listings), 1) AS percentage
  FROM listings GROUP BY category""",
    "listings",
)
check(
    "table_sizes",
    lambda t: S.table_sizes(t.store),
    """SELECT 'listings' AS "table", count(*) AS rows FROM listings UNION ALL
  SELECT 'images', count(*) FROM images UNION ALL
  SELECT 'specifications', count(*) FROM specifications UNION ALL
  SELECT 'sessions', count(*) FROM sessions""",
    "listings", "images", "specifications", "sessions",
)
check(
    "table_profile",
    lambda t: S.table_profile({"specifications": t.specifications, "events": t.read("events")}),
    """SELECT 'specifications' AS "table", count(*) AS rows, 4 AS columns,
  'spec_id, listing_id, attribute_name, attribute_value' AS column_names FROM specifications
  UNION ALL SELECT 'events', count(*), 6, 'event_id, ts, user_id, event_type, value, props'
  FROM events""",
    "specifications",
)
# All columns whose values both engines write as the same text.
PROFILED = [
    "listing_id", "url", "title", "description", "currency", "condition", "seller_name", "category",
    "material", "brand", "main_stone", "watchers", "views", "bids", "image_count", "is_validated",
]
check(
    "column_profile",
    lambda t: S.column_profile(t.listings.select(*PROFILED)),
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS filled, min({c})::VARCHAR AS smallest,
  max({c})::VARCHAR AS largest FROM listings"""
        for c in PROFILED
    ),
    "listings",
)
check(
    "collection_status",
    lambda t: S.collection_status(t.listings, t.sessions, derived.AS_OF),
    f"""SELECT max(scraped_at) AS last_scrape, count(*) AS listings,
  count(*) FILTER (scraped_at >= {AS_OF} - INTERVAL 1 DAY) AS last_24h,
  (SELECT count(*) FROM sessions WHERE status = 'running') AS running_sessions FROM listings""",
    "listings", "sessions",
)
check(
    "batch_quality",
    lambda t: S.batch_quality(t.listings, "data_completeness_score"),
    f"SELECT {avg('data_completeness_score', 'batch_quality')} FROM listings",
    "listings",
)

ATTEMPTS = """SELECT event_type AS rule_type, 'rule' || (user_id % 10) AS rule_name,
  value > 5 AS success, value / 60 AS seconds FROM events"""
EFFECT = f"""SELECT rule_type, rule_name, count(*) AS attempts,
  count(*) FILTER (success) AS successes, round(avg(success::INT), 4) AS success_rate,
  round(avg(seconds), 4) AS avg_seconds FROM ({ATTEMPTS}) GROUP BY ALL"""


def _attempts(t):
    return t.read("events").selectExpr(
        "event_type AS rule_type", "concat('rule', user_id % 10) AS rule_name",
        "value > 5 AS success", "value / 60 AS seconds",
    )


check("rule_effectiveness", lambda t: S.rule_effectiveness(_attempts(t)), EFFECT)
check(
    "effective_rules",
    lambda t: S.effective_rules(_attempts(t), 0.9, 0.85),
    EFFECT + " HAVING avg(success::INT) >= 0.9 AND avg(seconds) <= 0.85",
)
check(
    "weak_rules",
    lambda t: S.weak_rules(_attempts(t), 0.9),
    EFFECT + " HAVING avg(success::INT) > 0 AND avg(success::INT) < 0.9",
)
check(
    "rules_per_type",
    lambda t: S.rules_per_type(_attempts(t)),
    f"""SELECT rule_type, count(DISTINCT rule_name) AS rules, count(*) AS attempts
  FROM ({ATTEMPTS}) GROUP BY ALL""",
)
