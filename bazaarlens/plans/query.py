"""Fluent listing queries that stay lazy DataFrames (an offset without a limit writes its rows once)."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bazaarlens.operators import filters as flt
from bazaarlens.operators import joins
from bazaarlens.session import written

SUMMARY = [
    "listing_id", "title", "price", "currency", "category", "material", "brand", "seller_name",
    "condition", "data_completeness_score", "image_count", "watchers", "views", "scraped_at",
    "url",
]


@dataclass
class SortChoice:
    """Named sort orders; the first one set wins, extra keys follow it."""

    price_asc: bool = False
    price_desc: bool = False
    quality_desc: bool = False
    popularity_desc: bool = False
    newest: bool = False
    ending_soon: bool = False
    column: str | None = None
    ascending: bool = True
    then: tuple[tuple[str, bool], ...] = ()


@dataclass(frozen=True)
class ListingQuery:
    """A listing search; every method returns a new query."""

    rows: DataFrame
    as_of: datetime | None = None
    columns: tuple = ()
    is_distinct: bool = False
    sorts: tuple[Column, ...] = ()
    groups: tuple = ()
    aggregates: tuple[Column, ...] = ()
    having_conditions: tuple[Column, ...] = ()
    row_limit: int | None = None
    row_offset: int | None = None

    def _with(self, **changes) -> ListingQuery:
        return replace(self, **changes)

    # projection
    def select(self, *columns) -> ListingQuery:
        return self._with(columns=self.columns + columns)

    def select_all(self) -> ListingQuery:
        return self._with(columns=())

    def select_summary(self) -> ListingQuery:
        return self.select(*SUMMARY)

    def distinct(self) -> ListingQuery:
        return self._with(is_distinct=True)

    # predicates
    def where(self, name: str | Column, op: str | None = None, value=None, upper=None):
        test = name if op is None else flt.condition(name, op, value, upper)
        return self._with(rows=self.rows.where(test))

    def filter(self, criteria: flt.ListingFilter, images: DataFrame | None = None):
        return self._with(rows=flt.apply_filter(self.rows, criteria, images))

    def _criteria(self, **values) -> ListingQuery:
        return self.filter(flt.ListingFilter(**values))

    def category(self, value) -> ListingQuery:
        return self._criteria(category=value)

    def material(self, value) -> ListingQuery:
        return self._criteria(material=value)

    def brand(self, value) -> ListingQuery:
        return self._criteria(brand=value)

    def seller(self, value) -> ListingQuery:
        return self._criteria(seller=value)

    def gemstone(self, value) -> ListingQuery:
        return self._criteria(gemstone=value)

    def has_gemstone(self) -> ListingQuery:
        return self._criteria(has_gemstone=True)

    def price_range(self, low: float | None = None, high: float | None = None) -> ListingQuery:
        return self._criteria(min_price=low, max_price=high)

    def price_between(self, low: float, high: float) -> ListingQuery:
        return self.where("price", "between", low, high)

    def quality_range(self, low: float | None = None, high: float | None = None) -> ListingQuery:
        return self._criteria(min_quality_score=low, max_quality_score=high)

    def high_quality(self, threshold: float = 0.8) -> ListingQuery:
        return self._criteria(min_quality_score=threshold)

    def validated_only(self) -> ListingQuery:
        return self._criteria(is_validated=True)

    def has_images(self, at_least: int = 1) -> ListingQuery:
        return self._criteria(min_image_count=at_least)

    def has_watchers(self, at_least: int = 1) -> ListingQuery:
        return self._criteria(min_watchers=at_least)

    def has_bids(self, at_least: int = 1) -> ListingQuery:
        return self._criteria(min_bids=at_least)

    def scraped_after(self, moment: datetime) -> ListingQuery:
        return self._criteria(scraped_after=moment)

    def scraped_before(self, moment: datetime) -> ListingQuery:
        return self._criteria(scraped_before=moment)

    def _now(self) -> datetime:
        if self.as_of is None:
            raise ValueError("this filter needs as_of")
        return self.as_of

    def scraped_today(self) -> ListingQuery:
        return self.where(flt.time_range("today", self._now()))

    def scraped_last_days(self, days: int = 7) -> ListingQuery:
        return self.where(flt.since_days(self._now(), days))

    def search_text(self, pattern: str, names=("title", "description")) -> ListingQuery:
        return self.where(flt.contains_text(names, pattern))

    # joins
    def join_images(self, images: DataFrame, how: str = "left") -> ListingQuery:
        return self._with(rows=joins.join_children(self.rows, images, how))

    def join_specifications(self, specifications: DataFrame, how: str = "left") -> ListingQuery:
        return self._with(
            rows=joins.join_children(self.rows, specifications, how)
        )

    def join_sessions(self, sessions: DataFrame, how: str = "inner") -> ListingQuery:
        return self._with(rows=joins.session_join(self.rows, sessions, self._now(), how))

    # order
    def order_by(self, name: str | Column, ascending: bool = True) -> ListingQuery:
        column = F.col(name) if isinstance(name, str) else name
        key = column.asc_nulls_first() if ascending else column.desc_nulls_last()
        return self._with(sorts=(*self.sorts, key))

    def order_by_price(self, ascending: bool = True) -> ListingQuery:
        return self.order_by("price", ascending)

    def order_by_quality(self, ascending: bool = False) -> ListingQuery:
        return self.order_by("data_completeness_score", ascending)

    def order_by_popularity(self) -> ListingQuery:
        zero = F.lit(0)
        return self.order_by(F.coalesce("watchers", zero) + F.coalesce("views", zero), False)

    def order_by_newest(self) -> ListingQuery:
        return self.order_by("scraped_at", False)

    def order_by_ending_soon(self) -> ListingQuery:
        return self.order_by("end_time")

    def sort(self, choice: SortChoice) -> ListingQuery:
        out = self._with(sorts=())
        if choice.price_asc or choice.price_desc:
            out = out.order_by_price(choice.price_asc)
        elif choice.quality_desc:
            out = out.order_by_quality()
        elif choice.popularity_desc:
            out = out.order_by_popularity()
        elif choice.newest:
            out = out.order_by_newest()
        elif choice.ending_soon:
            out = out.order_by_ending_soon()
        elif choice.column:
            out = out.order_by(choice.column, choice.ascending)
        for name, ascending in choice.then:
            out = out.order_by(name, ascending)
        return out

    # grouping
    def group_by(self, *columns) -> ListingQuery:
        return self._with(groups=self.groups + columns)

    def agg(self, *columns: Column) -> ListingQuery:
        return self._with(aggregates=self.aggregates + columns)

    def having(self, name: str | Column, op: str, value=None, upper=None) -> ListingQuery:
        test = flt.condition(name, op, value, upper)
        return self._with(having_conditions=(*self.having_conditions, test))

    # paging
    def limit(self, rows: int) -> ListingQuery:
        return self._with(row_limit=rows)

    def offset(self, rows: int) -> ListingQuery:
        return self._with(row_offset=rows)

    def page(self, number: int, size: int) -> ListingQuery:
        return self.limit(size).offset((number - 1) * size)

    # results
    def _matched(self) -> DataFrame:
        out = self.rows
        if self.groups:
            out = out.groupBy(*self.groups).agg(*self.aggregates)
            for test in self.having_conditions:
                out = out.where(test)
        elif self.aggregates:
            out = out.agg(*self.aggregates)
        return out

    def build(self) -> DataFrame:
        """The result; pages are cut after a total order on the given keys."""
        out = self._matched()
        if not self.is_distinct and self.sorts:
            out = out.orderBy(*self.sorts)
        if self.columns:
            out = out.select(*self.columns)
        if self.is_distinct:
            out = out.distinct()
            out = out.orderBy(*self.sorts) if self.sorts else out
        if self.row_offset and self.row_limit is None:
            return _after(out, self.row_offset)
        if self.row_offset:
            out = out.offset(self.row_offset)
        return out if self.row_limit is None else out.limit(self.row_limit)

    def count(self) -> DataFrame:
        """Matching rows before sort and paging."""
        return self._matched().agg(F.count("*").alias("total"))


def _after(rows: DataFrame, skipped: int) -> DataFrame:
    """All rows but the first, in order. Spark's own offset brings every row to one task; here the
    ordered rows are written once with task and place in it, and the counts of the tasks tell where
    to begin."""
    held = written(rows.withColumn("_place", F.monotonically_increasing_id()), "ordered")
    task = F.shiftright("_place", 33)
    upto = F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, 0))
    # one row per task
    tasks = held.groupBy(task.alias("task")).agg(F.count("*").alias("n")).select("task", "n", upto.alias("upto"))
    first = tasks.where((F.col("upto") > skipped) & (F.col("upto") - F.col("n") <= skipped)).agg(
        F.min(F.shiftleft("task", 33) + skipped - (F.col("upto") - F.col("n")))
    ).scalar()
    return held.where(F.col("_place") >= first).orderBy("_place").drop("_place")


def listing_query(listings: DataFrame, as_of: datetime | None = None) -> ListingQuery:
    return ListingQuery(listings, as_of).select_summary()


def high_quality_query(listings: DataFrame, threshold: float = 0.8) -> ListingQuery:
    return (
        listing_query(listings).high_quality(threshold).validated_only().has_images()
        .order_by_quality()
    )


def recent_query(listings: DataFrame, as_of: datetime, days: int = 7) -> ListingQuery:
    return listing_query(listings, as_of).scraped_after(as_of - timedelta(days=days)).order_by_newest()


def popular_query(listings: DataFrame) -> ListingQuery:
    return listing_query(listings).has_watchers().order_by_popularity()


def category_query(listings: DataFrame, category) -> ListingQuery:
    return (
        ListingQuery(listings)
        .category(category)
        .validated_only()
        .group_by("category")
        .agg(
            F.count("*").alias("listing_count"),
            F.avg("price").alias("avg_price"),
            F.min("price").alias("min_price"),
            F.max("price").alias("max_price"),
            F.avg("data_completeness_score").alias("avg_quality"),
        )
    )


def listing_by_id(listings: DataFrame, listing_id: str) -> DataFrame:
    return listings.where(F.col("listing_id") == listing_id)


def images_of(images: DataFrame, listing_id: str) -> DataFrame:
    return images.where(F.col("listing_id") == listing_id).orderBy("sequence_order")


def recent_listings(listings: DataFrame, rows: int = 10) -> DataFrame:
    return listings.orderBy(F.desc_nulls_last("scraped_at"), "listing_id").limit(rows)
