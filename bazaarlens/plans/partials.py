"""Report measures kept as partial sums per day, merged by whatever report asks for them.

One pass counts the rows by several groupings at once (grouping sets: Spark expands each row and sums
it before the shuffle). Every stored grouping holds the day and the category, so the reports of any
time range and choice of categories are sums of few stored rows. Counts, sums, extremes and distinct
values are those of the rows themselves; sums of doubles may differ in the last digits.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.functions.bands import price_band, quality_band, rating_band
from bazaarlens.operators.filters import present, time_range
from bazaarlens.plans import reports as R
from bazaarlens.session import present as stored_at
from bazaarlens.session import written

GRAINS = {
    "material": ("material",),
    "seller": ("seller_name",),
    "brand": ("brand",),
    "price": ("price_range",),
    "quality": ("quality_range",),
    "rating": ("rating_range", "seller_name"),
}
ALWAYS = ["date", "category"]
KEYS = [*ALWAYS, *dict.fromkeys(c for columns in GRAINS.values() for c in columns)]
SUMMED = [
    "price", "data_completeness_score", "image_count", "watchers", "views", "bids",
    "seller_rating", "seller_feedback_count",
]
DAY = "day"  # marks a stored day, whether it has rows or not


def partials(rows: DataFrame, daily: dict[str, bool] | None = None) -> DataFrame:
    """Partial measures by category and each of ``GRAINS``, or those named in ``daily``; by day as
    well unless ``daily`` says that no day is asked of the grain, whose ``date`` is NULL then."""
    daily = dict.fromkeys(GRAINS, True) if daily is None else dict(daily)
    both = daily.keys() >= {"seller", "rating"}
    if both:  # sellers are sums over the ratings, so their rows are not counted by a set of their own
        daily["rating"] |= daily.pop("seller")
    held = {
        grain: [*(ALWAYS if by_day else ALWAYS[1:]), *GRAINS[grain]]
        for grain, by_day in daily.items()
    }
    if "seller_feedback_count" not in rows.columns:
        rows = rows.withColumn("seller_feedback_count", F.lit(None).cast("long"))
    keyed = rows.withColumns({
        "date": F.to_date("scraped_at"),
        "price_range": price_band(),
        "quality_range": quality_band(),
        "rating_range": F.when(F.col("seller_rating").isNotNull(), rating_band()),
    })
    usable = {label: R.usable(rows, column) for label, column in R.COMPLETENESS_FIELDS.items()}
    out = keyed.groupingSets(list(held.values()), *KEYS).agg(
        F.grouping_id().alias("_set"),
        F.count("*").alias("rows"),
        *[F.sum(c).alias(f"{c}_sum") for c in SUMMED],
        *[F.count(c).alias(f"{c}_n") for c in SUMMED],
        F.min("price").alias("price_min"),
        F.max("price").alias("price_max"),
        (F.var_pop("price") * F.count("price")).alias("price_spread"),
        F.min("data_completeness_score").alias("quality_min"),
        F.min("seller_rating").alias("rating_min"),
        F.count_if(F.col("data_completeness_score") >= 0.8).alias("high"),
        F.count_if(present("main_stone")).alias("stones"),
        *[F.count_if(found).alias(f"{label}_usable") for label, found in usable.items()],
    )
    name = F.lit(None).cast("string")
    for grain, columns in held.items():
        # A bit is set for each key that the grouping leaves out, the first key highest.
        code = sum(1 << (len(KEYS) - 1 - i) for i, key in enumerate(KEYS) if key not in columns)
        name = F.when(F.col("_set") == code, grain).otherwise(name)
    if both:
        name = F.when(name == "rating", F.array(F.lit("seller"), name)).otherwise(F.array(name))
        name = F.explode(name)
    return out.withColumn("grain", name).drop("_set").where("grain <> 'rating' OR rating_range IS NOT NULL")


# Merging ---------------------------------------------------------------------------

def _of(grain: str, column: str) -> Column:
    return F.when(F.col("grain") == grain, F.col(column))


def n(name: str = "count", grain: str = "material", column: str = "rows") -> Column:
    return F.coalesce(F.sum(_of(grain, column)), F.lit(0)).alias(name)


def total(column: str, name: str | None = None, grain: str = "material") -> Column:
    return F.sum(_of(grain, f"{column}_sum")).alias(name or f"total_{column}")


def mean(column: str, name: str | None = None, grain: str = "material") -> Column:
    number = F.sum(_of(grain, f"{column}_n"))
    return F.try_divide(F.sum(_of(grain, f"{column}_sum")), number).alias(name or f"avg_{column}")


def quality(grain: str = "material") -> Column:
    return mean("data_completeness_score", "avg_quality", grain)


def price_range(grain: str = "material") -> list[Column]:
    return [
        mean("price", grain=grain),
        F.min(_of(grain, "price_min")).alias("min_price"),
        F.max(_of(grain, "price_max")).alias("max_price"),
    ]


def distinct(column: str, name: str, grain: str) -> Column:
    return F.count_distinct(_of(grain, column)).alias(name)


def price_stddev(grain: str = "material") -> Column:
    """Sample deviation from the parts' spreads about their own means and those means' spread."""
    number = F.col("price_n")
    between = F.try_divide(F.col("price_sum") * F.col("price_sum"), number)
    all_n, all_sum = F.sum(_of(grain, "price_n")), F.sum(_of(grain, "price_sum"))
    squares = F.sum(F.when(F.col("grain") == grain, F.col("price_spread") + between))
    variance = F.try_divide(squares - F.try_divide(all_sum * all_sum, all_n), all_n - 1)
    return F.coalesce(F.sqrt(F.greatest(variance, F.lit(0.0))), F.lit(0.0)).alias("price_stddev")


def grains(p: DataFrame, *names: str) -> DataFrame:
    return p.where(F.col("grain").isin(list(names)))


def overview(p: DataFrame) -> DataFrame:
    return grains(p, "material", "seller", "brand").agg(
        n("total_listings"),
        distinct("category", "unique_categories", "material"),
        distinct("material", "unique_materials", "material"),
        distinct("seller_name", "unique_sellers", "seller"),
        distinct("brand", "unique_brands", "brand"),
        *price_range(),
        quality(),
        total("image_count", "total_images"),
        mean("image_count", "avg_images_per_listing"),
        total("watchers"),
        total("views"),
        total("bids"),
        n("listings_with_gemstones", column="stones"),
    )


def price_distribution(p: DataFrame) -> DataFrame:
    bands = grains(p, "price").groupBy("price_range").agg(
        n(grain="price"), F.min("price_min").alias("_low"))
    return R.with_share(bands).orderBy("_low").drop("_low")


def _top(p: DataFrame, column: str, rows: int) -> DataFrame:
    counts = grains(p, "material").groupBy(column).agg(n())
    return counts.orderBy(F.desc("count"), column).limit(rows)


def top_categories(p: DataFrame, rows: int = 10) -> DataFrame:
    return _top(p, "category", rows)


def top_materials(p: DataFrame, rows: int = 10) -> DataFrame:
    return _top(p, "material", rows)


def category_summary(p: DataFrame) -> DataFrame:
    return (
        grains(p, "material", "seller", "brand")
        .groupBy("category")
        .agg(
            n("listing_count"),
            *price_range(),
            quality(),
            mean("image_count", "avg_images"),
            mean("watchers"),
            mean("views"),
            n("with_gemstones", column="stones"),
            distinct("seller_name", "unique_sellers", "seller"),
            distinct("brand", "unique_brands", "brand"),
        )
        .orderBy(F.desc("listing_count"), "category")
    )


def category_materials(p: DataFrame, at_least: int = 3) -> DataFrame:
    groups = grains(p, "material").groupBy("category", "material").agg(n(), mean("price"))
    return groups.where(F.col("count") >= at_least).orderBy("category", F.desc("count"), "material")


def category_price_ranges(p: DataFrame) -> DataFrame:
    groups = grains(p, "price").groupBy("category", "price_range").agg(
        n(grain="price"), F.min("price_min").alias("_low"))
    return groups.orderBy("category", "_low").drop("_low")


def price_by_category(p: DataFrame, at_least: int = 5) -> DataFrame:
    groups = grains(p, "material").groupBy("category").agg(n(), *price_range(), price_stddev())
    return groups.where(F.col("count") >= at_least).orderBy(F.desc("avg_price"), "category")


def price_by_material(p: DataFrame, at_least: int = 5) -> DataFrame:
    groups = grains(p, "material").groupBy("material").agg(n(), *price_range())
    return groups.where(F.col("count") >= at_least).orderBy(F.desc("avg_price"), "material")


def price_trends(p: DataFrame, days: int = 30) -> DataFrame:
    daily = grains(p, "material").groupBy("date").agg(n("listings_count"), *price_range())
    return R.newest(daily, days)


def top_sellers_by_count(p: DataFrame, at_least: int = 3, rows: int = 50) -> DataFrame:
    return (
        grains(p, "seller")
        .groupBy("seller_name")
        .agg(
            n("listing_count", "seller"),
            *price_range("seller"),
            mean("seller_rating", "avg_rating", "seller"),
            mean("seller_feedback_count", "avg_feedback_count", "seller"),
            quality("seller"),
            distinct("category", "categories_sold", "seller"),
            mean("watchers", grain="seller"),
            mean("views", grain="seller"),
        )
        .where(F.col("listing_count") >= at_least)
        .orderBy(F.desc("listing_count"), "seller_name")
        .limit(rows)
    )


def top_sellers_by_value(p: DataFrame, at_least: int = 3, rows: int = 20) -> DataFrame:
    return (
        grains(p, "seller")
        .groupBy("seller_name")
        .agg(
            n("listing_count", "seller"),
            total("price", "total_value", "seller"),
            mean("price", grain="seller"),
            mean("seller_rating", "avg_rating", "seller"),
            quality("seller"),
        )
        .where(F.col("listing_count") >= at_least)
        .orderBy(F.desc("total_value"), "seller_name")
        .limit(rows)
    )


def seller_rating_distribution(p: DataFrame) -> DataFrame:
    bands = grains(p, "rating").groupBy("rating_range").agg(
        distinct("seller_name", "seller_count", "rating"),
        n("listing_count", "rating"),
        F.min("rating_min").alias("_low"),
    )
    return bands.orderBy(F.desc("_low")).drop("_low")


def quality_distribution(p: DataFrame) -> DataFrame:
    bands = grains(p, "quality").groupBy("quality_range").agg(
        n(grain="quality"), F.min("quality_min").alias("_low"))
    return R.with_share(bands).orderBy(F.desc("_low")).drop("_low")


def quality_by_category(p: DataFrame) -> DataFrame:
    share = F.round(F.col("high_quality_count") * 100.0 / F.col("count"), 2)
    return (
        grains(p, "material")
        .groupBy("category")
        .agg(n(), quality(), n("high_quality_count", column="high"))
        .withColumn("high_quality_percentage", share)
        .orderBy(F.desc("avg_quality"), "category")
    )


def field_completeness(p: DataFrame) -> DataFrame:
    return grains(p, "material").agg(*[
        F.try_divide(F.sum(f"{label}_usable") * F.lit(100.0), F.sum("rows"))
        .alias(f"{label}_completeness")
        for label in R.COMPLETENESS_FIELDS
    ])


def daily_trends(p: DataFrame, days: int = 30) -> DataFrame:
    daily = grains(p, "material", "seller").groupBy("date").agg(
        n("listings_count"),
        distinct("seller_name", "unique_sellers", "seller"),
        mean("price"),
        quality(),
        total("image_count", "total_images"),
    )
    return R.newest(daily, days)


def category_trends(p: DataFrame, rows: int = 100) -> DataFrame:
    daily = grains(p, "material").groupBy("date", "category").agg(n(), mean("price"))
    return R.newest(daily, rows, F.desc("count"), F.col("category"))


def quality_trends(p: DataFrame, days: int = 30) -> DataFrame:
    daily = grains(p, "material").groupBy("date").agg(
        quality(), n("high_quality_count", column="high"), n("total_count"))
    return R.newest(daily, days)


# Parts of the reports that partial measures can give, with the grains they merge; the others need
# the rows.
NEEDS: dict[Callable[[DataFrame], DataFrame], tuple[str, ...]] = {
    overview: ("material", "seller", "brand"),
    price_distribution: ("price",),
    top_categories: ("material",),
    top_materials: ("material",),
    category_summary: ("material", "seller", "brand"),
    category_materials: ("material",),
    category_price_ranges: ("price",),
    price_by_category: ("material",),
    price_by_material: ("material",),
    price_trends: ("material",),
    top_sellers_by_count: ("seller",),
    top_sellers_by_value: ("seller",),
    seller_rating_distribution: ("rating",),
    quality_distribution: ("quality",),
    quality_by_category: ("material",),
    field_completeness: ("material",),
    daily_trends: ("material", "seller"),
    category_trends: ("material",),
    quality_trends: ("material",),
}
BY_DAY = (price_trends, daily_trends, category_trends, quality_trends)
MERGED = {part.__name__: part for part in NEEDS}


def grains_of(kinds: list[str]) -> dict[str, bool]:
    """The grains that the summed parts of these reports merge, and whether by day."""
    out: dict[str, bool] = {}
    for kind in kinds:
        for part in [MERGED[name] for name in R.REPORTS.get(kind, ()) if name in MERGED]:
            for grain in NEEDS[part]:
                out[grain] = out.get(grain, False) or part in BY_DAY
    return out


def _parts(kind: str, merged: DataFrame | None, rows: DataFrame | None) -> dict[str, DataFrame]:
    if kind not in R.REPORTS:
        raise ValueError(f"unknown report type: {kind}")
    return {
        name: MERGED[name](merged) if name in MERGED else build(rows)
        for name, build in R.REPORTS[kind].items()
        if name in MERGED or rows is not None
    }


def one_pass_bundle(
    kinds: list[str], listings: DataFrame, request: R.ReportRequest
) -> dict[str, dict[str, DataFrame]]:
    """Several report types whose summed parts come from one pass over the filtered rows.

    The partial measures that these reports ask for are written once below
    ``spark.checkpoint.dir``; parts that list single rows, or measure what ``MERGED`` does not hold,
    read the filtered rows themselves.
    """
    rows, daily = R.base(listings, request), grains_of(kinds)
    merged = written(partials(rows, daily), "bundle") if daily else None
    return {kind: _parts(kind, merged, rows) for kind in kinds}


# Stored days -------------------------------------------------------------------------

class DailyPartials:
    """Partial measures of validated listings below ``root``, one folder a day.

    ``refresh`` replaces whole days, so it may be repeated, and is called again for days that got
    late, changed or deleted rows. Days outside the stored range, days a time range cuts and rows
    without a time are taken from the listings themselves, so reports are always whole. One
    refresh at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def stored_days(self) -> tuple[date, date] | None:
        """First and last stored day; an interrupted refresh that left a gap is an error."""
        if not stored_at(self.spark, self.root):
            return None
        days = self.spark.read.parquet(self.root).where(F.col("grain") == DAY)
        first, last, number = days.agg(
            F.min("date"), F.max("date"), F.count_distinct("date")).first()
        if first is None:
            return None
        if number != (last - first).days + 1:
            raise ValueError(f"days are missing between {first} and {last}: refresh them")
        return first, last

    def refresh(self, listings: DataFrame, first: date, last: date) -> None:
        """Count the days from ``first`` to ``last`` anew; they must touch the stored range."""
        if first > last:
            raise ValueError("the first day is after the last")
        if stored_at(self.spark, self.root):
            bounds = self.spark.read.parquet(self.root).agg(F.min("date"), F.max("date")).first()
            day = timedelta(days=1)
            if bounds[0] is not None and (first > bounds[1] + day or last < bounds[0] - day):
                raise ValueError(f"days {first} to {last} do not touch {bounds[0]} to {bounds[1]}")
        start, end = F.lit(first).cast("timestamp"), F.lit(last + timedelta(days=1)).cast("timestamp")
        rows = listings.where("is_validated").where(
            (F.col("scraped_at") >= start) & (F.col("scraped_at") < end))
        days = F.sequence(F.lit(first), F.lit(last))
        marks = self.spark.range(1).select(F.explode(days).alias("date"), F.lit(DAY).alias("grain"))
        (
            partials(rows)
            .unionByName(marks, allowMissingColumns=True)
            .hint("rebalance", "date")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("date")
            .parquet(self.root)
        )

    def measures(self, listings: DataFrame, request: R.ReportRequest) -> DataFrame:
        """Partial measures of the request: stored days it holds whole, the rest from the rows."""
        other = (request.materials, request.sellers, request.min_price, request.max_price,
                 request.min_quality)
        if any(value not in (None, ()) for value in other):
            raise ValueError("stored measures know days and categories only")
        stored, rows = self.stored_days(), R.base(listings, request)
        if stored is None:
            return partials(rows)
        low = F.lit(stored[0]).cast("timestamp")
        high = F.lit(stored[1] + timedelta(days=1)).cast("timestamp")
        whole = (F.col("date") >= stored[0]) & (F.col("date") <= stored[1])
        span = time_range(request.time_range, request.as_of, request.start, request.end, "_at")
        if span is not None:
            # A day is held whole if both its first and its last instant are.
            every = F.sequence(F.lit(stored[0]), F.lit(stored[1]))
            days = self.spark.range(1).select(F.explode(every).alias("d"))
            begin = days.withColumn("_at", F.col("d").cast("timestamp")).where(span).drop("_at")
            last = F.date_add("d", 1).cast("timestamp") - F.expr("interval 1 microsecond")
            held = begin.withColumn("_at", last).where(span).agg(F.min("d"), F.max("d")).first()
            if held[0] is None:
                return partials(rows)
            low = F.lit(held[0]).cast("timestamp")
            high = F.lit(held[1] + timedelta(days=1)).cast("timestamp")
            whole = (F.col("date") >= held[0]) & (F.col("date") <= held[1])
        kept = self.spark.read.parquet(self.root).where(whole & (F.col("grain") != DAY))
        if request.categories:
            kept = kept.where(F.col("category").isin(list(request.categories)))
        at = F.col("scraped_at")
        rest = rows.where(at.isNull() | (at < low) | (at >= high))
        return kept.unionByName(partials(rest))

    def report(
        self, kind: str, listings: DataFrame, request: R.ReportRequest
    ) -> dict[str, DataFrame]:
        """The parts of a report that ``MERGED`` holds; the result is that of ``generate``."""
        return _parts(kind, self.measures(listings, request), None)
