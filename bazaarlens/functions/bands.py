"""Bucketing of prices, scores and ratings into named bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed band edges and labels.
PRICE_BELOW = [
    (100, "Under $100"),
    (500, "$100-$500"),
    (1000, "$500-$1,000"),
    (5000, "$1,000-$5,000"),
]
PRICE_REST = "Over $5,000"
QUALITY_FROM = [
    (0.9, "Excellent (90-100%)"),
    (0.7, "Good (70-89%)"),
    (0.5, "Fair (50-69%)"),
    (0.3, "Poor (30-49%)"),
]
QUALITY_REST = "Very Poor (0-29%)"
RATING_FROM = [(99, "99-100%"), (95, "95-99%"), (90, "90-95%"), (80, "80-90%")]
RATING_REST = "Under 80%"
CLASS_FROM = [(0.9, "excellent"), (0.7, "good"), (0.5, "fair"), (0.3, "poor")]
CLASS_REST = "invalid"


def _chain(cases, rest: str) -> Column:
    head, *tail = cases
    out = F.when(*head)
    for condition, label in tail:
        out = out.when(condition, label)
    return out.otherwise(rest)


def band_below(value: Column, edges, rest: str) -> Column:
    """Label of the first upper edge the value lies under; NULL falls to ``rest``."""
    return _chain([(value < edge, F.lit(label)) for edge, label in edges], rest)


def band_from(value: Column, edges, rest: str) -> Column:
    """Label of the first lower edge the value reaches; NULL falls to ``rest``."""
    return _chain([(value >= edge, F.lit(label)) for edge, label in edges], rest)


def price_band(price="price") -> Column:
    return band_below(F.col(price), PRICE_BELOW, PRICE_REST)


def quality_band(score="data_completeness_score") -> Column:
    return band_from(F.col(score), QUALITY_FROM, QUALITY_REST)


def rating_band(rating="seller_rating") -> Column:
    return band_from(F.col(rating), RATING_FROM, RATING_REST)


def quality_class(score="data_completeness_score") -> Column:
    return band_from(F.col(score), CLASS_FROM, CLASS_REST)
