"""Market reports over listings.

``ReportRequest`` selects the validated rows of a time range; every report is a
lazy DataFrame over that one filtered base.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bazaarlens.functions.bands import price_band, quality_band, rating_band
from bazaarlens.operators.filters import present, since_days, time_range


@dataclass(frozen=True)
class ReportRequest:
    as_of: datetime
    time_range: str = "all"
    start: datetime | None = None
    end: datetime | None = None
    categories: tuple[str, ...] = ()
    materials: tuple[str, ...] = ()
    sellers: tuple[str, ...] = ()
    min_price: float | None = None
    max_price: float | None = None
    min_quality: float | None = None

    def key(self, report: str) -> str:
        """Digest of every field, used to name stored results."""
        text = json.dumps({"report": report, **asdict(self)}, default=str, sort_keys=True)
        return hashlib.md5(text.encode()).hexdigest()


def base(listings: DataFrame, request: ReportRequest) -> DataFrame:
    """Validated listings the request asks for."""
    out = listings.where("is_validated")
    span = time_range(request.time_range, request.as_of, request.start, request.end)
    if span is not None:
        out = out.where(span)
    for name, values in [
        ("category", request.categories),
        ("material", request.materials),
        ("seller_name", request.sellers),
    ]:
        if values:
            out = out.where(F.col(name).isin(list(values)))
    if request.min_price is not None:
        out = out.where(F.col("price") >= request.min_price)
    if request.max_price is not None:
        out = out.where(F.col("price") <= request.max_price)
    if request.min_quality is not None:
        out = out.where(F.col("data_completeness_score") >= request.min_quality)
    return out


# Measures shared by the reports ------------------------------------------------

def n(name: str = "count") -> Column:
    return F.count("*").alias(name)


def mean(column: str, name: str | None = None) -> Column:
    return F.avg(column).alias(name or f"avg_{column}")


def total(column: str, name: str | None = None) -> Column:
    return F.sum(column).alias(name or f"total_{column}")


def distinct(column: str, name: str) -> Column:
    return F.count_distinct(column).alias(name)


def price_range() -> list[Column]:
    return [mean("price"), F.min("price").alias("min_price"), F.max("price").alias("max_price")]


def quality(name: str = "avg_quality") -> Column:
    return mean("data_completeness_score", name)


def high_quality_count(name: str = "high_quality_count") -> Column:
    return F.count_if(F.col("data_completeness_score") >= 0.8).alias(name)


def with_share(grouped: DataFrame, count: str = "count", name: str = "percentage") -> DataFrame:
    """Percentage of the grand total; one row per band reaches this window."""
    everything = Window.partitionBy()
    return grouped.withColumn(
        name, F.round(F.col(count) * 100.0 / F.sum(count).over(everything), 2)
    )


def engaged(df: DataFrame) -> DataFrame:
    return df.where((F.col("watchers") > 0) | (F.col("views") > 0) | (F.col("bids") > 0))


def engagement() -> Column:
    """Watchers, views and bids; NULL when watchers or views are unknown."""
    return F.col("watchers") + F.col("views") + F.coalesce("bids", F.lit(0))


def newest(df: DataFrame, rows: int, *then: Column) -> DataFrame:
    return df.orderBy(F.desc("date"), *then).limit(rows)


# Summary -----------------------------------------------------------------------

def overview(b: DataFrame) -> DataFrame:
    return b.agg(
        n("total_listings"),
        distinct("category", "unique_categories"),
        distinct("material", "unique_materials"),
        distinct("seller_name", "unique_sellers"),
        distinct("brand", "unique_brands"),
        *price_range(),
        quality(),
        total("image_count", "total_images"),
        mean("image_count", "avg_images_per_listing"),
        total("watchers"),
        total("views"),
        total("bids"),
        F.count_if(present("main_stone")).alias("listings_with_gemstones"),
    )


def price_distribution(b: DataFrame) -> DataFrame:
    bands = b.groupBy(price_band().alias("price_range")).agg(n(), F.min("price").alias("_low"))
    return with_share(bands).orderBy("_low").drop("_low")


def _top(b: DataFrame, column: str, rows: int) -> DataFrame:
    return b.groupBy(column).agg(n()).orderBy(F.desc("count"), column).limit(rows)


def top_categories(b: DataFrame, rows: int = 10) -> DataFrame:
    return _top(b, "category", rows)


def top_materials(b: DataFrame, rows: int = 10) -> DataFrame:
    return _top(b, "material", rows)


def executive_summary(b: DataFrame) -> DataFrame:
    """Rounded key figures and the insight texts their thresholds trigger."""
    facts = b.agg(
        n("total_listings"),
        F.round(F.coalesce(F.avg("price"), F.lit(0.0)), 2).alias("avg_price"),
        F.coalesce(F.avg("data_completeness_score"), F.lit(0.0)).alias("_quality"),
        distinct("seller_name", "total_sellers"),
    )
    q = F.col("_quality")
    # Insight sentences.
    insights = F.array_compact(
        F.array(
            F.when(F.col("total_listings") > 1000, "Large dataset with over 1,000 listings"),
            F.when(q > 0.8, "High average data quality (>80%)").when(
                q < 0.5, "Data quality needs improvement (<50%)"
            ),
        )
    )
    return facts.select(
        "total_listings",
        "avg_price",
        F.round(q, 3).alias("avg_quality"),
        "total_sellers",
        insights.alias("key_insights"),
    )


# Categories ----------------------------------------------------------------------

def category_summary(b: DataFrame) -> DataFrame:
    return (
        b.groupBy("category")
        .agg(
            n("listing_count"),
            *price_range(),
            quality(),
            mean("image_count", "avg_images"),
            mean("watchers"),
            mean("views"),
            F.count_if(present("main_stone")).alias("with_gemstones"),
            distinct("seller_name", "unique_sellers"),
            distinct("brand", "unique_brands"),
        )
        .orderBy(F.desc("listing_count"), "category")
    )


def category_materials(b: DataFrame, at_least: int = 3) -> DataFrame:
    return (
        b.groupBy("category", "material")
        .agg(n(), mean("price"))
        .where(F.col("count") >= at_least)
        .orderBy("category", F.desc("count"), "material")
    )


def category_price_ranges(b: DataFrame) -> DataFrame:
    return (
        b.groupBy("category", price_band().alias("price_range"))
        .agg(n(), F.min("price").alias("_low"))
        .orderBy("category", "_low")
        .drop("_low")
    )


# Prices --------------------------------------------------------------------------

def price_by_category(b: DataFrame, at_least: int = 5) -> DataFrame:
    spread = F.coalesce(F.stddev_samp("price"), F.lit(0.0)).alias("price_stddev")
    return (
        b.groupBy("category")
        .agg(n(), *price_range(), spread)
        .where(F.col("count") >= at_least)
        .orderBy(F.desc("avg_price"), "category")
    )


def price_by_material(b: DataFrame, at_least: int = 5) -> DataFrame:
    return (
        b.groupBy("material")
        .agg(n(), *price_range())
        .where(F.col("count") >= at_least)
        .orderBy(F.desc("avg_price"), "material")
    )


def most_expensive(b: DataFrame, rows: int = 20) -> DataFrame:
    columns = [
        "listing_id", "title", "price", "currency", "category", "material", "brand",
        "seller_name", "watchers", "views",
    ]
    return b.select(*columns).orderBy(F.desc_nulls_last("price"), "listing_id").limit(rows)


def price_trends(b: DataFrame, days: int = 30) -> DataFrame:
    daily = b.groupBy(F.to_date("scraped_at").alias("date")).agg(n("listings_count"), *price_range())
    return newest(daily, days)


# Sellers -------------------------------------------------------------------------

def top_sellers_by_count(b: DataFrame, at_least: int = 3, rows: int = 50) -> DataFrame:
    if "seller_feedback_count" not in b.columns:
        b = b.withColumn("seller_feedback_count", F.lit(None).cast("long"))
    return (
        b.groupBy("seller_name")
        .agg(
            n("listing_count"),
            *price_range(),
            mean("seller_rating", "avg_rating"),
            mean("seller_feedback_count", "avg_feedback_count"),
            quality(),
            distinct("category", "categories_sold"),
            mean("watchers"),
            mean("views"),
        )
        .where(F.col("listing_count") >= at_least)
        .orderBy(F.desc("listing_count"), "seller_name")
        .limit(rows)
    )


def top_sellers_by_value(b: DataFrame, at_least: int = 3, rows: int = 20) -> DataFrame:
    return (
        b.groupBy("seller_name")
        .agg(
            n("listing_count"),
            total("price", "total_value"),
            mean("price"),
            mean("seller_rating", "avg_rating"),
            quality(),
        )
        .where(F.col("listing_count") >= at_least)
        .orderBy(F.desc("total_value"), "seller_name")
        .limit(rows)
    )


def seller_rating_distribution(b: DataFrame) -> DataFrame:
    return (
        b.where("seller_rating IS NOT NULL")
        .groupBy(rating_band().alias("rating_range"))
        .agg(distinct("seller_name", "seller_count"), n("listing_count"),
             F.min("seller_rating").alias("_low"))
        .orderBy(F.desc("_low"))
        .drop("_low")
    )


# Quality -------------------------------------------------------------------------

def quality_distribution(b: DataFrame) -> DataFrame:
    bands = b.groupBy(quality_band().alias("quality_range")).agg(
        n(), F.min("data_completeness_score").alias("_low")
    )
    return with_share(bands).orderBy(F.desc("_low")).drop("_low")


def quality_by_category(b: DataFrame) -> DataFrame:
    high = high_quality_count()
    return (
        b.groupBy("category")
        .agg(n(), quality(), high)
        .withColumn(
            "high_quality_percentage", F.round(F.col("high_quality_count") * 100.0 / F.col("count"), 2)
        )
        .orderBy(F.desc("avg_quality"), "category")
    )


COMPLETENESS_FIELDS = {
    "title": "title",
    "description": "description",
    "brand": "brand",
    "gemstone": "main_stone",
    "size": "size",
    "image": "image_count",
    "seller_rating": "seller_rating",
}


def usable(b: DataFrame, column: str) -> Column:
    """Whether a row has a value that counts: a set text, a positive count, else any value."""
    kinds = dict(b.dtypes)
    if column not in kinds:
        return F.lit(False)
    if kinds[column] == "string":
        return present(column)
    if column.endswith("_count"):
        return F.coalesce(F.col(column) > 0, F.lit(False))
    return F.col(column).isNotNull()


def field_completeness(b: DataFrame, names: dict[str, str] = COMPLETENESS_FIELDS) -> DataFrame:
    """Percentage of rows with a usable value, one column per field."""
    return b.agg(
        *[
            F.avg(F.when(usable(b, column), 100.0).otherwise(0.0)).alias(f"{label}_completeness")
            for label, column in names.items()
        ]
    )


def field_completeness_long(b: DataFrame) -> DataFrame:
    wide = field_completeness(b)
    return wide.unpivot([], wide.columns, "field", "completeness")


# Trends --------------------------------------------------------------------------

def daily_trends(b: DataFrame, days: int = 30) -> DataFrame:
    daily = b.groupBy(F.to_date("scraped_at").alias("date")).agg(
        n("listings_count"),
        distinct("seller_name", "unique_sellers"),
        mean("price"),
        quality(),
        total("image_count", "total_images"),
    )
    return newest(daily, days)


def category_trends(b: DataFrame, rows: int = 100) -> DataFrame:
    daily = b.groupBy(F.to_date("scraped_at").alias("date"), "category").agg(n(), mean("price"))
    return newest(daily, rows, F.desc("count"), F.col("category"))


def quality_trends(b: DataFrame, days: int = 30) -> DataFrame:
    daily = b.groupBy(F.to_date("scraped_at").alias("date")).agg(
        quality(), high_quality_count(), n("total_count")
    )
    return newest(daily, days)


# Market --------------------------------------------------------------------------

def hot_categories(b: DataFrame, at_least: int = 10, rows: int = 10) -> DataFrame:
    return (
        engaged(b)
        .groupBy("category")
        .agg(
            n("listing_count"),
            mean("watchers"),
            mean("views"),
            mean("bids"),
            mean("price"),
            F.sum(engagement()).alias("total_engagement"),
        )
        .where(F.col("listing_count") >= at_least)
        .orderBy(F.desc_nulls_last("total_engagement"), "category")
        .limit(rows)
    )


def undervalued_items(b: DataFrame, rows: int = 20) -> DataFrame:
    return (
        engaged(b)
        .where("price > 0")
        .select(
            "listing_id",
            "title",
            "price",
            "category",
            "material",
            "watchers",
            "views",
            "bids",
            "data_completeness_score",
            (engagement() / F.col("price")).alias("engagement_per_dollar"),
        )
        .orderBy(F.desc_nulls_last("engagement_per_dollar"), "listing_id")
        .limit(rows)
    )


def premium_brands(b: DataFrame, at_least: int = 5, rows: int = 15) -> DataFrame:
    average = b.agg(F.avg("price").alias("m")).scalar()
    return (
        b.where(present("brand") & (F.col("price") >= average))
        .groupBy("brand")
        .agg(n("listing_count"), mean("price"), mean("watchers"), quality(),
             distinct("category", "categories"))
        .where(F.col("listing_count") >= at_least)
        .orderBy(F.desc("avg_price"), "brand")
        .limit(rows)
    )


def gemstone_popularity(b: DataFrame, at_least: int = 5, rows: int = 15) -> DataFrame:
    return (
        b.where(present("main_stone"))
        .groupBy("main_stone")
        .agg(n("listing_count"), mean("price"), mean("watchers"), distinct("category", "categories"))
        .where(F.col("listing_count") >= at_least)
        .orderBy(F.desc("listing_count"), "main_stone")
        .limit(rows)
    )


# Collection performance ------------------------------------------------------------

def session_metrics(sessions: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    done = F.col("listings_scraped") + F.col("listings_failed")
    minutes = (F.unix_micros("completed_at") - F.unix_micros("started_at")) / 60e6
    return sessions.where(since_days(as_of, days, "started_at")).agg(
        F.avg(
            F.when(done > 0, F.try_divide(F.col("listings_scraped") * F.lit(100.0), done))
            .otherwise(0.0)
        ).alias("avg_success_rate"),
        mean("average_quality_score", "avg_quality_score"),
        total("listings_scraped", "total_scraped"),
        total("listings_failed", "total_failed"),
        F.avg(minutes).alias("avg_duration_minutes"),
    )


def recent_quality(listings: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    rows = F.count("*")
    return listings.where(since_days(as_of, days)).agg(
        quality("current_avg_quality"),
        F.try_divide(F.count_if(F.col("data_completeness_score") >= 0.8) * F.lit(100.0), rows)
        .alias("high_quality_percentage"),
        F.try_divide(F.count_if("is_validated") * F.lit(100.0), rows).alias("validation_percentage"),
    )


REPORTS: dict[str, dict[str, Callable[[DataFrame], DataFrame]]] = {
    "summary": {
        "overview": overview,
        "price_distribution": price_distribution,
        "top_categories": top_categories,
        "top_materials": top_materials,
        "executive_summary": executive_summary,
    },
    "category_analysis": {
        "category_summary": category_summary,
        "category_materials": category_materials,
        "category_price_ranges": category_price_ranges,
    },
    "price_analysis": {
        "price_by_category": price_by_category,
        "price_by_material": price_by_material,
        "most_expensive": most_expensive,
        "price_trends": price_trends,
    },
    "seller_analysis": {
        "top_sellers_by_count": top_sellers_by_count,
        "top_sellers_by_value": top_sellers_by_value,
        "seller_rating_distribution": seller_rating_distribution,
    },
    "quality_analysis": {
        "quality_distribution": quality_distribution,
        "quality_by_category": quality_by_category,
        "field_completeness": field_completeness,
    },
    "trend_analysis": {
        "daily_trends": daily_trends,
        "category_trends": category_trends,
        "quality_trends": quality_trends,
    },
    "market_insights": {
        "hot_categories": hot_categories,
        "undervalued_items": undervalued_items,
        "premium_brands": premium_brands,
        "gemstone_popularity": gemstone_popularity,
    },
}


def generate(
    kind: str,
    listings: DataFrame,
    request: ReportRequest,
    sessions: DataFrame | None = None,
    filtered: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The parts of one report type as lazy DataFrames."""
    if kind == "performance_metrics":
        if sessions is None:
            raise ValueError("performance metrics need the sessions table")
        return {
            "session_metrics": session_metrics(sessions, request.as_of),
            "quality_metrics": recent_quality(listings, request.as_of),
        }
    if kind not in REPORTS:
        raise ValueError(f"unknown report type: {kind}")
    rows = base(listings, request) if filtered is None else filtered
    return {name: build(rows) for name, build in REPORTS[kind].items()}


DASHBOARD = ["summary", "category_analysis", "quality_analysis", "trend_analysis"]
MARKET = ["market_insights", "price_analysis", "category_analysis", "seller_analysis"]


def bundle(kinds: list[str], listings: DataFrame, request: ReportRequest):
    """Several report types over one filtered base.

    Returns the reports and the base; the caller may ``persist()`` the base
    before running many parts and ``unpersist()`` it afterwards.
    """
    rows = base(listings, request)
    return {k: generate(k, listings, request, filtered=rows) for k in kinds}, rows


def category_insights(listings: DataFrame, category: str, request: ReportRequest):
    return generate("category_analysis", listings, replace(request, categories=(category,)))


def price_analysis(listings: DataFrame, low: float, high: float, request: ReportRequest):
    return generate("price_analysis", listings, replace(request, min_price=low, max_price=high))
