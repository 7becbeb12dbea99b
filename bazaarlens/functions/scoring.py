"""Completeness scores, content hash and the ingest gate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.functions import text

# Field groups and weights of the two score versions.
_REQUIRED = [
    "listing_id", "title", "price", "currency", "condition", "seller_name", "url", "category",
    "material",
]
_IMPORTANT = [
    "brand", "main_stone", "size", "weight", "description", "image_urls", "shipping_cost",
]


@dataclass(frozen=True)
class ScoreRule:
    """Weighted field groups plus a capped bonus part."""

    groups: tuple[tuple[tuple[str, ...], float], ...]
    bonus_weight: float
    image_divisor: float
    image_cap: float
    description_divisor: float
    description_cap: float = 0.3
    completeness_fields: int | None = None
    completeness_cap: float = 0.3
    extra: dict[str, float] = field(default_factory=dict)
    validate_from: float = 0.6


SCORE_V2 = ScoreRule(
    groups=(
        (tuple(_REQUIRED), 0.30),
        (tuple(_IMPORTANT + ["seller_rating"]), 0.25),
        (
            tuple(
                [
                    "stone_color", "stone_clarity", "stone_cut", "features", "specifications",
                    "materials", "metal_purity",
                ]
            ),
            0.20,
        ),
        (tuple([
            "watchers", "views", "bids", "seller_feedback_count",
        ]), 0.10),
    ),
    bonus_weight=0.15,
    image_divisor=15,
    image_cap=0.4,
    description_divisor=2000,
    completeness_fields=50,
    validate_from=0.6,
)
SCORE_V1 = ScoreRule(
    groups=(
        (tuple(_REQUIRED), 0.40),
        (tuple(_IMPORTANT), 0.35),
        (tuple([
            "stone_color", "stone_clarity", "stone_cut", "features", "dimensions",
        ]), 0.15),
    ),
    bonus_weight=0.10,
    image_divisor=10,
    image_cap=0.3,
    description_divisor=1000,
    extra={"main_image_path": 0.2, "end_time": 0.2},
    validate_from=0.7,
)
BLANK = r"(?i)^\s*(?:unknown|n/a|null|none)?\s*$"
MIN_INGEST_SCORE = 0.3


def valuable(df: DataFrame, name: str) -> Column:
    """Whether a field carries information; absent columns never do."""
    if name not in df.columns:
        return F.lit(False)
    kind, col = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.StringType):
        ok = ~col.rlike(BLANK)
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        ok = F.size(col) > 0
    elif isinstance(kind, T.NumericType):
        ok = col > 0
    elif isinstance(kind, T.BooleanType):
        ok = col
    else:
        ok = col.isNotNull()
    return F.coalesce(ok, F.lit(False))


def filled(df: DataFrame, names) -> Column:
    """How many of the fields carry information.

    Text fields share one array test, which keeps the generated code small.
    """
    kinds = dict(df.dtypes)
    texts = [F.col(n) for n in names if kinds.get(n) == "string"]
    others = [n for n in names if n in kinds and kinds[n] != "string"]
    total = sum((valuable(df, n).cast("int") for n in others), F.lit(0))
    if texts:
        total = total + F.size(F.filter(F.array(*texts), lambda x: x.isNotNull() & ~x.rlike(BLANK)))
    return total


def quality_score(df: DataFrame, rule: ScoreRule = SCORE_V2, decimals: int = 3) -> Column:
    """Completeness score in [0, 1], by default with three decimals."""
    total = F.lit(0.0)
    for names, part in rule.groups:
        total = total + filled(df, names) / len(names) * part

    def capped(name: str, above: int, divisor: float, cap: float, length: bool = False) -> Column:
        if name not in df.columns:
            return F.lit(0.0)
        size = F.length(name) if length else F.col(name)
        return F.when(size > above, F.least(size / divisor, F.lit(cap))).otherwise(0.0)

    bonus = capped("image_count", 0, rule.image_divisor, rule.image_cap)
    bonus = bonus + capped(
        "description", 50, rule.description_divisor, rule.description_cap, length=True
    )
    if rule.completeness_fields:
        share = filled(df, df.columns) / rule.completeness_fields
        bonus = bonus + F.least(share, F.lit(rule.completeness_cap))
    for name, value in rule.extra.items():
        bonus = bonus + F.when(valuable(df, name), value).otherwise(0.0)
    total = total + F.least(bonus, F.lit(1.0)) * rule.bonus_weight
    return F.round(F.least(total, F.lit(1.0)), decimals)


def content_hash(df: DataFrame | None = None) -> Column:
    """md5 over title, price (two decimals), seller, category and material."""
    price = F.format_string("%.2f", F.col("price"))
    parts = [F.col("title"), price, F.col("seller_name"), F.col("category"), F.col("material")]
    joined = F.concat_ws("|", *[F.coalesce(p, F.lit("None")) for p in parts])
    return F.md5(joined.cast("binary"))


def auto_validated(score: Column, rule: ScoreRule = SCORE_V2) -> Column:
    return score >= rule.validate_from


def gate_errors(score: str = "quality_score") -> Column:
    """Messages of every failed ingest check, in check order."""

    def missing(name: str) -> Column:
        return F.col(name).isNull() | (F.col(name) == "")

    price = F.col("price")
    checks = [
        (missing("listing_id"), "ID is required"),
        (missing("title"), "Title is required"),
        (~F.coalesce(price > 0, F.lit(False)), "Valid price is required"),
        (missing("seller_name"), "Seller ID is required"),
        (missing("url"), "Listing URL is required"),
        (missing("category"), "Category is required"),
        (missing("material"), "Material is required"),
        (F.col(score) < MIN_INGEST_SCORE, "Data quality score too low"),
        (~missing("url") & ~text.is_url(F.col("url")), "Invalid listing URL format"),
        (
            (F.col("original_price") > 0) & (price > F.col("original_price") * 2),
            "Current price seems unusually high compared to original price",
        ),
    ]
    return F.array_compact(F.array(*[F.when(bad, message) for bad, message in checks]))


def basic_gate_errors() -> Column:
    """The shorter check list of the first score version."""
    labels = {"listing_id": "ID", "title": "Title", "seller_name": "Seller ID",
              "url": "Listing URL"}
    flags = [
        F.when(F.coalesce(F.col(n), F.lit("")) == "", f"{label} is required")
        for n, label in labels.items()
    ]
    price = F.when(~F.coalesce(F.col("price") > 0, F.lit(False)), "Valid price is required")
    return F.array_compact(F.array(*flags[:2], price, *flags[2:]))


def scored(df: DataFrame, rule: ScoreRule = SCORE_V2) -> DataFrame:
    """Add score, class, content hash, gate errors and validation columns.

    The score is computed first, so the gate sees the real value. A score that
    reaches the rule's bar validates the row at once.
    """
    from bazaarlens.functions.bands import quality_class

    if "original_price" not in df.columns:
        df = df.withColumn("original_price", F.lit(None).cast("double"))
    out = df.withColumn("quality_score", quality_score(df, rule))
    out = out.withColumn("gate_errors", gate_errors())
    return out.withColumns(
        {
            "quality_class": quality_class("quality_score"),
            "content_hash": content_hash(),
            "auto_validated": auto_validated(F.col("quality_score"), rule),
            "accepted": F.size("gate_errors") == 0,
            "gate_score": 1.0 - F.size("gate_errors") / 10,
        }
    )


def session_measures(as_of) -> dict[str, Column]:
    """Derived values of a collection session row."""
    now = F.lit(as_of).cast("timestamp")
    end = F.coalesce("completed_at", now)
    seconds = (F.unix_micros(end) - F.unix_micros("started_at")) / 1e6
    done = F.col("progress_percentage") / 100
    return {
        "duration_seconds": seconds,
        "success_rate": F.coalesce(
            F.try_divide(
                F.col("listings_scraped") * F.lit(100.0),
                F.col("listings_scraped") + F.col("listings_failed"),
            ),
            F.lit(0.0),
        ),
        "request_success_rate": F.coalesce(
            F.try_divide(F.col("requests_successful") * F.lit(100.0), F.col("requests_made")),
            F.lit(0.0),
        ),
        "is_active": F.col("status").isin("running", "paused", "retrying"),
        "seconds_remaining": F.when(done > 0, F.try_divide(seconds, done) - seconds),
    }


def summary_columns() -> list[Column]:
    """Display form of a listing."""

    def fixed(value: Column, pattern: str) -> Column:
        """Rounded by the exact value of the double; ``format_string`` rounds its shortest decimal
        form and would make 80.1 of 80.05, which is a little less."""
        text = F.call_function("format_number", value, F.lit(pattern))
        return F.when(F.abs(value) < float("inf"), text).otherwise(value.cast("string"))

    def money(name: str) -> Column:
        text = fixed(F.col(name), "0.00")
        return F.when(text.isNotNull(), F.concat_ws(" ", F.col("currency"), text))

    def percent(value: Column) -> Column:
        return F.concat(fixed(value, "0.0"), F.lit("%"))

    from bazaarlens.functions.bands import quality_class

    title, rating = F.col("title"), F.col("seller_rating")
    return [
        F.col("listing_id"),
        F.when(F.length(title) > 100, F.concat(F.substring(title, 1, 100), F.lit("...")))
        .otherwise(title)
        .alias("title"),
        money("price").alias("price"),
        F.when(F.col("original_price") > 0, money("original_price")).alias("original_price"),
        F.col("category"),
        F.col("material"),
        F.when(F.col("brand") != "", F.col("brand")).otherwise("Unknown").alias("brand"),
        F.col("condition"),
        F.col("seller_name").alias("seller"),
        F.when(rating > 0, percent(rating)).alias("seller_rating"),
        F.col("image_count").alias("images"),
        F.col("watchers"),
        F.col("bids"),
        percent(F.col("data_completeness_score") * 100).alias("quality_score"),
        quality_class().alias("quality_class"),
        F.date_format("scraped_at", "yyyy-MM-dd HH:mm").alias("scraped"),
        F.col("is_validated").alias("validated"),
        F.col("url"),
    ]
