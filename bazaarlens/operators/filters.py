"""Predicates over listings: one filter object, one combined condition."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, fields
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.bands import quality_class


def _as_time(value) -> Column:
    return F.lit(value).cast("timestamp")


COMPARISONS = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(as_list(v)),
    "not in": lambda c, v: ~c.isin(as_list(v)),
    "like": lambda c, v: c.ilike(v),
    "ilike": lambda c, v: c.ilike(v),
    "is null": lambda c, v: c.isNull(),
    "is not null": lambda c, v: c.isNotNull(),
}


def as_list(value) -> list:
    if isinstance(value, (list, tuple, set, frozenset)):
        return list(value)
    return [value]


def condition(name: str | Column, op: str, value=None, upper=None) -> Column:
    """One comparison; ``like`` ignores case, ``between`` includes both ends."""
    col = F.col(name) if isinstance(name, str) else name
    op = op.lower()
    if op == "between":
        return col.between(value, upper)
    if op not in COMPARISONS:
        raise ValueError(f"unknown comparison: {op}")
    return COMPARISONS[op](col, value)


def equals_any(name: str, value) -> Column:
    """Equality for one value, membership for several."""
    values = as_list(value)
    return F.col(name) == values[0] if len(values) == 1 else F.col(name).isin(values)


def contains_text(names: Iterable[str], pattern: str) -> Column:
    """Case-blind substring match over any of the columns.

    ``%`` and ``_`` in the pattern keep their wildcard meaning.
    """
    hits = [F.col(n).ilike(f"%{pattern}%") for n in names]
    return reduce(lambda a, b: a | b, hits)


def present(name: str) -> Column:
    return F.col(name).isNotNull() & (F.col(name) != "")


def since_days(as_of: datetime, days: int, name: str = "scraped_at") -> Column:
    return F.col(name) >= _as_time(as_of - timedelta(days=days))


TIME_RANGES = {"week": 7, "month": 30, "quarter": 90, "year": 365}


def time_range(
    kind: str,
    as_of: datetime,
    start: datetime | None = None,
    end: datetime | None = None,
    name: str = "scraped_at",
) -> Column | None:
    """Condition of a named range; ``None`` where the range is open."""
    if kind == "custom":
        if start is None or end is None:
            return None
        return F.col(name).between(_as_time(start), _as_time(end))
    if kind == "today":
        return F.col(name) >= _as_time(as_of.replace(hour=0, minute=0, second=0, microsecond=0))
    if kind in TIME_RANGES:
        return since_days(as_of, TIME_RANGES[kind], name)
    if kind == "all":
        return None
    raise ValueError(f"unknown time range: {kind}")


@dataclass
class ListingFilter:
    """Optional search criteria; unset fields do not filter."""

    listing_ids: list[str] | None = None
    category: str | list[str] | None = None
    material: str | list[str] | None = None
    brand: str | list[str] | None = None
    seller: str | list[str] | None = None
    condition: str | list[str] | None = None
    listing_status: str | list[str] | None = None
    currency: str | list[str] | None = None
    min_price: float | None = None
    max_price: float | None = None
    has_original_price: bool | None = None
    price_drop_min: float | None = None
    min_quality_score: float | None = None
    max_quality_score: float | None = None
    quality_class: str | list[str] | None = None
    is_validated: bool | None = None
    min_validation_score: float | None = None
    scraped_after: datetime | None = None
    scraped_before: datetime | None = None
    created_after: datetime | None = None
    created_before: datetime | None = None
    updated_after: datetime | None = None
    updated_before: datetime | None = None
    listing_date_after: datetime | None = None
    listing_date_before: datetime | None = None
    min_watchers: int | None = None
    max_watchers: int | None = None
    min_views: int | None = None
    max_views: int | None = None
    min_bids: int | None = None
    has_watchers: bool | None = None
    has_bids: bool | None = None
    min_seller_rating: float | None = None
    max_seller_rating: float | None = None
    min_feedback_count: int | None = None
    seller_level: str | list[str] | None = None
    has_images: bool | None = None
    min_image_count: int | None = None
    max_image_count: int | None = None
    min_image_quality: float | None = None
    has_main_image: bool | None = None
    search_text: str | None = None
    search_title: str | None = None
    search_description: str | None = None
    brand_contains: str | None = None
    seller_contains: str | None = None
    min_description_length: int | None = None
    has_features: bool | None = None
    has_specifications: bool | None = None
    gemstone: str | list[str] | None = None
    has_gemstone: bool | None = None
    stone_color: str | list[str] | None = None
    stone_clarity: str | list[str] | None = None
    stone_cut: str | list[str] | None = None
    size: str | list[str] | None = None
    era: str | list[str] | None = None
    designer: str | list[str] | None = None
    collection: str | list[str] | None = None
    free_shipping: bool | None = None
    international_shipping: bool | None = None
    expedited_shipping: bool | None = None
    ships_from: str | list[str] | None = None
    has_video: bool | None = None
    best_offer_available: bool | None = None
    auction_format: bool | None = None
    buy_it_now_format: bool | None = None
    extra: list[Column] = field(default_factory=list)

    def given(self) -> dict[str, object]:
        return {
            f.name: getattr(self, f.name)
            for f in fields(self)
            if f.name != "extra" and getattr(self, f.name) is not None
        }


_EQUAL = {
    "listing_ids": "listing_id",
    "seller": "seller_name",
    "gemstone": "main_stone",
} | {
    n: n
    for n in [
        "category", "material", "brand", "condition", "listing_status", "currency",
        "seller_level", "stone_color", "stone_clarity", "stone_cut", "size", "era", "designer",
        "collection", "ships_from",
    ]
}
_AT_LEAST = {
    "min_price": "price",
    "price_drop_min": "price_drop",
    "min_quality_score": "data_completeness_score",
    "min_validation_score": "validation_score",
    "min_watchers": "watchers",
    "min_views": "views",
    "min_bids": "bids",
    "min_seller_rating": "seller_rating",
    "min_feedback_count": "seller_feedback_count",
    "min_image_count": "image_count",
    "min_image_quality": "avg_image_quality",
}
_AT_MOST = {
    "max_price": "price",
    "max_quality_score": "data_completeness_score",
    "max_watchers": "watchers",
    "max_views": "views",
    "max_seller_rating": "seller_rating",
    "max_image_count": "image_count",
}
_TIMES = {"scraped": "scraped_at", "created": "created_at", "updated": "updated_at",
          "listing_date": "listing_date"}
_FLAGS = {
    "is_validated": "is_validated",
    "has_video": "has_video",
    "best_offer_available": "best_offer",
    "international_shipping": "international_shipping",
    "expedited_shipping": "expedited_shipping",
}
_COUNTS = {"has_images": "image_count", "has_watchers": "watchers", "has_bids": "bids"}


def _yes_no(hit: Column, wanted: bool) -> Column:
    hit = F.coalesce(hit, F.lit(False))
    return hit if wanted else ~hit


def predicates(criteria: ListingFilter) -> list[Column]:
    """One condition per given criterion."""
    out: list[Column] = []
    for name, value in criteria.given().items():
        if name in _EQUAL:
            out.append(equals_any(_EQUAL[name], value))
        elif name in _AT_LEAST:
            out.append(F.col(_AT_LEAST[name]) >= value)
        elif name in _AT_MOST:
            out.append(F.col(_AT_MOST[name]) <= value)
        elif name in _FLAGS:
            out.append(_yes_no(F.col(_FLAGS[name]), value))
        elif name in _COUNTS:
            out.append(_yes_no(F.col(_COUNTS[name]) > 0, value))
        elif name.endswith("_after"):
            out.append(F.col(_TIMES[name.removesuffix("_after")]) >= _as_time(value))
        elif name.endswith("_before"):
            out.append(F.col(_TIMES[name.removesuffix("_before")]) <= _as_time(value))
        else:
            out.append(_SPECIAL[name](value))
    return out + list(criteria.extra)


_SPECIAL = {
    "has_original_price": lambda v: _yes_no(F.col("original_price") > 0, v),
    "quality_class": lambda v: quality_class().isin(as_list(v)),
    "has_main_image": lambda v: _yes_no(present("main_image_path"), v),
    "search_text": lambda v: contains_text(["title", "description"], v),
    "search_title": lambda v: contains_text(["title"], v),
    "search_description": lambda v: contains_text(["description"], v),
    "brand_contains": lambda v: contains_text(["brand"], v),
    "seller_contains": lambda v: contains_text(["seller_name"], v),
    "min_description_length": lambda v: F.length("description") >= v,
    "has_features": lambda v: _yes_no(F.size("features") > 0, v),
    "has_specifications": lambda v: _yes_no(F.size("specifications") > 0, v),
    "has_gemstone": lambda v: _yes_no(present("main_stone"), v),
    "free_shipping": lambda v: _yes_no(F.col("shipping_cost") == 0, v),
    "auction_format": lambda v: _yes_no(F.col("listing_type").ilike("%auction%"), v),
    "buy_it_now_format": lambda v: _yes_no(F.col("listing_type").ilike("%buy it now%"), v),
}


def apply_filter(
    listings: DataFrame, criteria: ListingFilter, images: DataFrame | None = None
) -> DataFrame:
    """Filter listings; an image-quality bound joins the mean score per listing."""
    if criteria.min_image_quality is not None and "avg_image_quality" not in listings.columns:
        if images is None:
            raise ValueError("min_image_quality needs the images table")
        means = images.groupBy("listing_id").agg(F.avg("quality_score").alias("avg_image_quality"))
        listings = listings.join(means, "listing_id")
    parts = predicates(criteria)
    return listings.where(reduce(lambda a, b: a & b, parts)) if parts else listings
