"""Named views over listings, images, specifications and sessions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.operators.filters import present, since_days
from bazaarlens.operators.quantiles import exact_quantiles
from bazaarlens.plans.reports import distinct, high_quality_count, mean, n, price_range, quality, total


def high_quality_listings(listings: DataFrame) -> DataFrame:
    columns = [
        "listing_id", "title", "price", "currency", "category", "material", "brand",
        "seller_name", "seller_rating", "data_completeness_score", "image_count", "watchers",
        "views", "scraped_at", "url",
    ]
    return listings.where(
        "data_completeness_score >= 0.7 AND is_validated AND image_count > 0"
    ).select(*columns)


def listing_summaries(
    listings: DataFrame, images: DataFrame, specifications: DataFrame
) -> DataFrame:
    """Validated listings with mean image quality and specification count."""
    image_stats = (
        images.where("quality_score IS NOT NULL").groupBy("listing_id").agg(mean("quality_score", "_q"))
    )
    spec_stats = specifications.groupBy("listing_id").agg(n("_s"))
    columns = [
        "listing_id", "title", "price", "original_price", "currency", "category", "material",
        "brand", "seller_name", "seller_rating", "condition", "data_completeness_score",
        "image_count", "watchers", "views", "bids", "scraped_at", "is_validated", "url",
    ]
    return (
        listings.where("is_validated")
        .select(*columns)
        .join(image_stats, "listing_id", "left")
        .join(spec_stats, "listing_id", "left")
        .select(
            *columns,
            F.coalesce("_q", F.lit(0.0)).alias("avg_image_quality"),
            F.coalesce("_s", F.lit(0)).alias("specification_count"),
        )
    )


def _engagement_counts():
    return [
        F.count_if(F.col("watchers") > 0).alias("listings_with_watchers"),
        F.count_if(F.col("bids") > 0).alias("listings_with_bids"),
        mean("watchers"),
        mean("views"),
        F.count_if(F.col("listing_status") == "sold").alias("sold_count"),
    ]


def _with_quantiles(
    stats: DataFrame, rows: DataFrame, keys: list[str], wanted: dict[str, float], exact: bool
) -> DataFrame:
    if exact:
        marks = exact_quantiles(rows, keys, "price", wanted)
    else:
        marks = rows.groupBy(*keys).agg(
            *[F.percentile_approx("price", q).alias(name) for name, q in wanted.items()]
        )
    same = F.lit(True)
    for key in keys:
        same = same & stats[key].eqNullSafe(marks[key])
    return stats.join(marks, same).drop(*[marks[k] for k in keys])


def category_statistics(listings: DataFrame, exact: bool = True) -> DataFrame:
    rows = listings.where("price > 0 AND is_validated")
    stats = (
        rows.groupBy("category")
        .agg(
            n("listing_count"),
            *price_range(),
            quality(),
            mean("image_count", "avg_images"),
            mean("seller_rating"),
            *_engagement_counts(),
        )
        .where("listing_count >= 5")
    )
    return _with_quantiles(stats, rows, ["category"], {"median_price": 0.5}, exact).orderBy(
        F.desc("listing_count"), "category"
    )


def seller_statistics(listings: DataFrame) -> DataFrame:
    if "seller_feedback_count" not in listings.columns:
        listings = listings.withColumn("seller_feedback_count", F.lit(None).cast("long"))
    return (
        listings.where("seller_name IS NOT NULL AND is_validated")
        .groupBy("seller_name")
        .agg(
            n("listing_count"),
            *price_range(),
            mean("seller_rating", "avg_rating"),
            mean("seller_feedback_count", "avg_feedback_count"),
            quality(),
            mean("image_count", "avg_images"),
            *_engagement_counts(),
            distinct("category", "categories_sold"),
            F.min("scraped_at").alias("first_listing"),
            F.max("scraped_at").alias("latest_listing"),
        )
        .where("listing_count >= 3")
        .orderBy(F.desc("listing_count"), "seller_name")
    )


def material_prices(listings: DataFrame, exact: bool = True) -> DataFrame:
    rows = listings.where("price > 0 AND is_validated")
    keys = ["material", "category"]
    stats = (
        rows.groupBy(*keys)
        .agg(
            n("listing_count"),
            *price_range(),
            quality(),
            F.count_if(present("main_stone")).alias("with_gemstone_count"),
        )
        .where("listing_count >= 3")
    )
    wanted = {"q1_price": 0.25, "median_price": 0.5, "q3_price": 0.75}
    return _with_quantiles(stats, rows, keys, wanted, exact).orderBy(*keys)


def session_performance(sessions: DataFrame, as_of: datetime) -> DataFrame:
    """Duration so far and three success percentages per session."""
    end = F.coalesce("completed_at", F.lit(as_of).cast("timestamp"))
    minutes = (F.unix_micros(end) - F.unix_micros("started_at")) / 60e6

    def percent(part: str, whole):
        return F.coalesce(
            F.round(F.try_divide(F.col(part) * F.lit(100.0), whole), 2), F.lit(0.0)
        )

    added = {
        "duration_minutes": F.round(minutes, 2),
        "success_rate_percent": percent(
            "listings_scraped", F.col("listings_scraped") + F.col("listings_failed")
        ),
        "image_success_rate_percent": percent(
            "images_downloaded", F.col("images_downloaded") + F.col("images_failed")
        ),
        "request_success_rate_percent": percent("requests_successful", F.col("requests_made")),
    }
    return sessions.withColumns(added).orderBy(F.desc("started_at"), "session_id")


def daily_activity(listings: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    return (
        listings.where(since_days(as_of, days))
        .groupBy(F.to_date("scraped_at").alias("scraping_date"))
        .agg(
            n("listings_scraped"),
            distinct("seller_name", "unique_sellers"),
            distinct("category", "categories_covered"),
            *price_range(),
            quality(),
            total("image_count", "total_images"),
            F.count_if("is_validated").alias("validated_listings"),
            high_quality_count("high_quality_listings"),
        )
        .orderBy(F.desc("scraping_date"))
    )


def image_quality(listings: DataFrame, images: DataFrame, at_least: int = 10) -> DataFrame:
    """Image measures per category and material of validated listings.

    Images are reduced to one row per listing before they meet the listings.
    """
    measured = [c for c in ("resolution_score", "sharpness_score", "brightness_score")
                if c in images.columns]
    flags = {"is_processed": "processed_count", "is_duplicate": "duplicate_count",
             "contains_text": "with_text_count", "contains_watermark": "with_watermark_count"}
    flags = {c: name for c, name in flags.items() if c in images.columns}
    numbers = ["quality_score", *measured, "file_size"]
    per_listing = images.groupBy("listing_id").agg(
        n("_n"),
        *[F.sum(c).alias(f"_s_{c}") for c in numbers],
        *[F.count(c).alias(f"_c_{c}") for c in numbers],
        *[F.count_if(F.col(c)).alias(name) for c, name in flags.items()],
    )

    def ratio(column: str):
        return F.try_divide(F.sum(f"_s_{column}"), F.sum(f"_c_{column}").cast("double"))

    return (
        listings.where("is_validated")
        .select("listing_id", "category", "material")
        .join(per_listing, "listing_id")
        .groupBy("category", "material")
        .agg(
            F.sum("_n").alias("total_images"),
            ratio("quality_score").alias("avg_quality"),
            *[ratio(c).alias("avg_" + c.removesuffix("_score")) for c in measured],
            *[F.sum(name).alias(name) for name in flags.values()],
            (ratio("file_size") / 1024.0).alias("avg_size_kb"),
        )
        .where(F.col("total_images") >= at_least)
        .orderBy("category", "material")
    )


def simple_category_stats(listings: DataFrame) -> DataFrame:
    return listings.where("price > 0").groupBy("category").agg(n(), *price_range(), quality())


def simple_seller_stats(listings: DataFrame) -> DataFrame:
    return (
        listings.where("seller_name IS NOT NULL")
        .groupBy("seller_name")
        .agg(n("listing_count"), mean("price"), mean("seller_rating", "avg_rating"), quality())
        .where("listing_count >= 5")
    )


def register(spark: SparkSession, tables: dict[str, DataFrame], as_of: datetime) -> list[str]:
    """Register tables and views as temporary views for free SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    listings = tables["listings"]
    views = {
        "high_quality_listings": high_quality_listings(listings),
        "daily_activity_summary": daily_activity(listings, as_of),
        "category_stats": simple_category_stats(listings),
        "seller_stats": simple_seller_stats(listings),
        "seller_statistics": seller_statistics(listings)
        if "listing_status" in listings.columns
        else None,
        "category_statistics": category_statistics(listings)
        if "listing_status" in listings.columns
        else None,
        "material_price_analysis": material_prices(listings),
    }
    if "images" in tables and "specifications" in tables:
        views["listing_summaries"] = listing_summaries(
            listings, tables["images"], tables["specifications"]
        )
        views["image_quality_analysis"] = image_quality(listings, tables["images"])
    if "sessions" in tables:
        views["session_performance_summary"] = session_performance(tables["sessions"], as_of)
    made = {name: df for name, df in views.items() if df is not None}
    for name, df in made.items():
        df.createOrReplaceTempView(name)
    return [*tables, *made]


def run_sql(
    spark: SparkSession, text: str, args: dict | None = None, limit: int | None = None, offset: int = 0
) -> DataFrame:
    """Parametrised free SQL over the registered views; ``limit`` and ``offset`` give one page."""
    out = spark.sql(text, args=args or {})
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)
