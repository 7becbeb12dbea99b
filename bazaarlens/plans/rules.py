"""Data-quality rules: tables in, one table of findings out.

Checks that look at one row share a single pass over the listings; only
duplicate, outlier and orphan rules need a shuffle of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bazaarlens.functions.text import is_url
from bazaarlens.operators.joins import HOT_PARTS, SALTS, fk_violations
from bazaarlens.operators.latest import duplicate_rows

COLUMNS = [
    "rule_id", "severity", "category", "table", "field", "record_id", "message",
    "current_value", "suggested_value",
]
LEVELS = {"basic": 1, "standard": 2, "strict": 3, "pedantic": 4}
WEIGHTS = {"critical": 1.0, "error": 0.8, "warning": 0.5, "info": 0.2}

# Required fields, price ranges, code lists and pair lists.
REQUIRED = {
    "listing_id": "Listing ID is required",
    "title": "Title is required",
    "price": "Price is required",
    "currency": "Currency is required",
    "condition": "Condition is required",
    "seller_name": "Seller name is required",
    "category": "Category is required",
    "material": "Material is required",
    "url": "Listing URL is required",
}
ESSENTIAL = ["brand", "main_stone", "size", "weight", "description"]
COMMON_CURRENCIES = ["USD", "EUR", "GBP", "CAD", "AUD", "JPY", "CHF", "CNY"]
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PRICE_RANGES = {
    "rings": (1, 50000),
    "necklaces": (5, 30000),
    "earrings": (5, 20000),
    "bracelets": (10, 25000),
    "watches": (20, 100000),
    "brooches": (10, 10000),
}
UNUSUAL_PAIRS = {
    "watches": ["fabric", "wood", "plastic"],
    "rings": ["fabric", "leather"],
    "earrings": ["leather", "fabric"],
    "necklaces": ["plastic"],
}


@dataclass(frozen=True)
class RowCheck:
    """A check of one listing row: severity is NULL where the row passes.

    ``message`` may name row values in braces; ``value`` names the value reported.
    """

    rule_id: str
    category: str
    level: str
    field: str
    severity: Column
    message: str
    value: str
    suggested: str | None = None


def _empty(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name).cast("string") == "")


def _at(level: str, bad: Column) -> Column:
    return F.when(bad, level)


def _decimal(value: Column) -> Column:
    return F.coalesce(value.try_cast("decimal(20,2)").cast("string"), value.cast("string"))


def _price_bound(which: int) -> Column:
    """Lower (0) or upper (1) end of the usual price range of the row's category."""
    pairs = [F.lit(x) for name, ends in PRICE_RANGES.items() for x in (name, ends[which])]
    return F.element_at(F.create_map(*pairs), F.col("category"))


def _title_faults() -> dict[str, Column]:
    """What is wrong with a title, by the words a message says it in."""
    title, size = F.col("_title"), F.length("_title")
    return {
        "too short": size < 10,
        "too long": size > 200,
        "all caps": (size > 20) & (F.upper(title) == title) & (F.lower(title) != title),
        "too few words": ~title.rlike(r"\S\s+\S+\s+\S"),
        "excessive exclamation marks": F.contains(title, F.lit("!!!")),
    }


def _title_issues() -> Column:
    return F.array_compact(F.array(*[F.when(bad, name) for name, bad in _title_faults().items()]))


def _measured(listings: DataFrame) -> DataFrame:
    """Listings with what several checks ask of a row, computed once."""
    return listings.withColumns(
        {
            "_title": F.trim("title"),
            "_length": F.length("description"),
            "_low": _price_bound(0),
            "_high": _price_bound(1),
        }
    ).withColumn(
        "_faults",
        sum((F.coalesce(bad, F.lit(False)).cast("int") for bad in _title_faults().values()), F.lit(0)),
    )


def row_values(columns: list[str]) -> dict[str, Column]:
    """Texts of the row values that findings report or mention."""
    score = F.col("data_completeness_score")
    plain = [*REQUIRED, *[c for c in (*ESSENTIAL, "seller_email") if c in columns]]
    return {c: F.col(c).cast("string") for c in plain if c != "price"} | {
        "price": _decimal(F.col("price")),
        "original_price": _decimal(F.col("original_price")),
        "score": _decimal(score),
        "clamped": _decimal(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))),
        "image_count": F.coalesce("image_count", F.lit(0)).cast("string"),
        "upper": F.upper("currency"),
        "issues": F.array_join(_title_issues(), ", "),
        "low": F.col("_low").cast("string"),
        "high": F.col("_high").cast("string"),
        "length": F.col("_length").cast("string"),
        "zero": F.lit("0"),
    }


def row_checks(columns: list[str]) -> list[RowCheck]:
    """Every single-row check the available columns allow; they read rows of ``_measured``."""
    score, price, currency = F.col("data_completeness_score"), F.col("price"), F.col("currency")
    low, high, size, issues = F.col("_low"), F.col("_high"), F.col("_length"), F.col("_faults")
    # Cheap tests come first: the value lists spare most rows a pattern or a joined text.
    common = currency.isin(COMMON_CURRENCIES)
    odd = F.col("material").isin(sorted({m for found in UNUSUAL_PAIRS.values() for m in found}))
    pairs = [f"{c}/{m}" for c, materials in UNUSUAL_PAIRS.items() for m in materials]
    checks = [
        RowCheck(f"required_listings_{name}", "required_fields", "basic", name,
                 _at("error", price.isNull() if name == "price" else _empty(name)), message, name)
        for name, message in REQUIRED.items()
    ]
    checks += [
        RowCheck("datatype_price_positive", "data_types", "basic", "price",
                 _at("error", price <= 0), "Price must be positive, found: {price}", "price"),
        RowCheck("datatype_quality_score_range", "data_types", "standard",
                 "data_completeness_score", _at("warning", ~score.between(0, 1)),
                 "Quality score should be between 0 and 1, found: {score}", "score", "clamped"),
        RowCheck("datatype_image_count_nonnegative", "data_types", "standard", "image_count",
                 _at("warning", F.col("image_count") < 0), "Image count cannot be negative",
                 "image_count", "zero"),
        RowCheck("format_url_valid", "format_validation", "standard", "url",
                 _at("error", ~_empty("url") & ~is_url(F.col("url"))),
                 "Invalid URL format: {url}", "url"),
        RowCheck("format_currency_iso", "format_validation", "standard", "currency",
                 _at("warning", (currency != "") & ~common & ~currency.rlike("^[A-Z]{3}$")),
                 "Currency should be 3-letter uppercase ISO code, found: {currency}",
                 "currency", "upper"),
        RowCheck("format_currency_iso", "format_validation", "standard", "currency",
                 _at("info", ~common & currency.rlike("^[A-Z]{3}$")),
                 "Uncommon currency code: {currency}", "currency"),
        RowCheck("business_price_reasonable", "business_rules", "standard", "price",
                 F.when(price > high * 2, "warning").when(
                     (price < low) | (price > high), "info"),
                 "Price ${price} may be unusual for {category} (typical range: ${low}-${high})",
                 "price"),
        RowCheck("business_original_price_logic", "business_rules", "standard", "original_price",
                 _at("warning", F.col("original_price") < price),
                 "Original price (${original_price}) is less than current price (${price})",
                 "original_price"),
        RowCheck("business_images_quality_correlation", "business_rules", "strict", "image_count",
                 _at("info", (score > 0.8) & (F.col("image_count") == 0)),
                 "High quality score ({score}) but no images", "score"),
        RowCheck("quality_title_descriptive", "data_quality", "standard", "title",
                 F.when(_empty("title"), None).when(issues > 1, "warning").when(issues == 1, "info"),
                 "Title quality issues: {issues}", "title"),
        RowCheck("quality_description_completeness", "data_quality", "strict", "description",
                 _at("info", (size > 0) & (size < 50)),
                 "Description is very short ({length} characters)", "length"),
        RowCheck("quality_description_completeness", "data_quality", "strict", "description",
                 _at("info", size > 5000), "Description is very long ({length} characters)",
                 "length"),
        RowCheck("consistency_category_material", "consistency", "strict", "material",
                 _at("warning", odd & F.concat_ws("/", "category", "material").isin(pairs)),
                 "Unusual material '{material}' for category '{category}'", "material"),
        RowCheck("completeness_images_available", "completeness", "standard", "image_count",
                 _at("info", F.coalesce("image_count", F.lit(0)) == 0),
                 "Listing has no images", "zero"),
    ]
    checks += [
        RowCheck("completeness_essential_fields", "completeness", "standard", name,
                 _at("warning", _empty(name)), f"Essential field '{name}' is missing", name)
        for name in ESSENTIAL
        if name in columns
    ]
    if "seller_email" in columns:
        checks.append(
            RowCheck("format_email_valid", "format_validation", "strict", "seller_email",
                     _at("warning", ~_empty("seller_email") & ~F.col("seller_email").rlike(EMAIL)),
                     "Invalid email format: {seller_email}", "seller_email")
        )
    return checks


def row_findings(listings: DataFrame, checks: list[RowCheck], table: str = "listings") -> DataFrame:
    """All findings of single-row checks in one pass.

    Severities of all checks become one array; only the failed ones go on to have
    their message filled in from templates, which keeps the generated code small.
    """
    if not checks:
        raise ValueError("no checks to run")
    values = row_values(listings.columns)
    names = list(values)
    spoken = [n for n in names if any(f"{{{n}}}" in c.message for c in checks)]
    used = {c.value for c in checks} | {c.suggested for c in checks} | set(spoken)
    failed = (
        _measured(listings)
        .select(
            "*", F.posexplode(F.array(*[c.severity for c in checks])).alias("_check", "_severity")
        )
        .where("_severity IS NOT NULL")
    )
    texts = F.array(*[values[n] if n in used else F.lit(None).cast("string") for n in names])
    rows = failed.select("listing_id", "_check", "_severity", texts.alias("_texts"))

    def of_check(part: Callable[[RowCheck], object]) -> Column:
        return F.get(F.array(*[F.lit(part(c)) for c in checks]), F.col("_check"))

    def value_at(part: Callable[[RowCheck], str | None]) -> Column:
        position = of_check(lambda c: names.index(part(c)) if part(c) else -1)
        return F.get("_texts", position)

    message = of_check(lambda c: c.message)
    for name in spoken:
        filler = F.coalesce(F.get("_texts", F.lit(names.index(name))), F.lit("None"))
        message = F.replace(message, F.lit(f"{{{name}}}"), filler)
    return rows.select(
        of_check(lambda c: c.rule_id).alias("rule_id"),
        F.col("_severity").alias("severity"),
        of_check(lambda c: c.category).alias("category"),
        F.lit(table).alias("table"),
        of_check(lambda c: c.field).alias("field"),
        F.col("listing_id").alias("record_id"),
        message.alias("message"),
        value_at(lambda c: c.value).alias("current_value"),
        value_at(lambda c: c.suggested).alias("suggested_value"),
    )


def _finding(rows: DataFrame, rule_id, severity, category, table, field, record, message, value):
    return rows.select(
        F.lit(rule_id).alias("rule_id"),
        F.lit(severity).alias("severity"),
        F.lit(category).alias("category"),
        F.lit(table).alias("table"),
        F.lit(field).alias("field"),
        F.col(record).alias("record_id"),
        message.alias("message"),
        value.cast("string").alias("current_value"),
        F.lit(None).cast("string").alias("suggested_value"),
    )


def orphan_images(tables: dict[str, DataFrame]) -> DataFrame:
    rows = fk_violations(tables["images"], tables["listings"], "listing_id")
    return _finding(
        rows, "integrity_orphaned_images", "error", "referential_integrity", "images",
        "listing_id", "image_id",
        F.concat(F.lit("Image references non-existent listing: "), "listing_id"),
        F.col("listing_id"),
    )


def orphan_specifications(tables: dict[str, DataFrame]) -> DataFrame:
    rows = fk_violations(tables["specifications"], tables["listings"], "listing_id")
    return _finding(
        rows, "integrity_orphaned_specs", "error", "referential_integrity", "specifications",
        "listing_id", "spec_id",
        F.concat(F.lit("Specification references non-existent listing: "), "listing_id"),
        F.col("listing_id"),
    )


def duplicate_urls(tables: dict[str, DataFrame]) -> DataFrame:
    return _finding(
        duplicate_rows(tables["listings"]), "quality_duplicate_listings", "warning",
        "data_quality", "listings", "url", "listing_id",
        F.concat(
            F.lit("Potential duplicate listing (same URL as "), "duplicate_of", F.lit(")")
        ),
        F.col("url"),
    )


def price_outliers(tables: dict[str, DataFrame]) -> DataFrame:
    """Prices above mean + 3 population standard deviations of their category."""
    priced = tables["listings"].where("price > 0 AND category IS NOT NULL").select(
        "listing_id", "category", "price"
    )
    stats = priced.groupBy("category").agg(
        F.count("*").alias("_n"),
        (F.avg("price") + 3 * F.stddev_pop("price")).alias("threshold"),
    )
    limits = stats.where("_n >= 10")
    # Few rows go on: those above the limit of their category if it is one of the HOT_PARTS with
    # most rows, above the least limit of all if not.
    least = limits.agg(F.min("threshold").alias("t")).scalar()
    busy = limits.orderBy(F.desc("_n")).limit(HOT_PARTS).select(
        "category", F.col("threshold").alias("_own")
    )
    high = priced.join(F.broadcast(busy), "category", "left").where(
        F.col("price") > F.coalesce("_own", least)
    )
    # The few limits are repeated per salt, so a category of any size is spread over tasks.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    salt = F.pmod(F.xxhash64("listing_id"), F.lit(SALTS)).cast("int")
    rows = high.withColumn("_salt", salt).join(
        limits.select("category", "threshold", salts), ["category", "_salt"]
    )
    return _finding(
        rows.where("price > threshold"), "consistency_price_category", "info", "consistency",
        "listings", "price", "listing_id",
        F.concat(
            F.lit("Price $"), _decimal(F.col("price")), F.lit(" is unusually high for "),
            "category", F.lit(" category"),
        ),
        _decimal(F.col("price")),
    )


@dataclass(frozen=True)
class TableRule:
    """A rule over whole tables; users may register their own."""

    rule_id: str
    level: str
    check: Callable[[dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ("listings",)


TABLE_RULES = [
    TableRule("integrity_orphaned_images", "standard", orphan_images, ("listings", "images")),
    TableRule(
        "integrity_orphaned_specs", "standard", orphan_specifications,
        ("listings", "specifications"),
    ),
    TableRule("quality_duplicate_listings", "standard", duplicate_urls),
    TableRule("consistency_price_category", "strict", price_outliers),
]


def validate(
    tables: dict[str, DataFrame], level: str = "standard", extra: list[TableRule] = ()
) -> DataFrame:
    """Findings of every rule at or below the level."""
    bar = LEVELS[level]
    listings = tables["listings"]
    checks = [c for c in row_checks(listings.columns) if LEVELS[c.level] <= bar]
    parts = [row_findings(listings, checks)]
    for rule in [*TABLE_RULES, *extra]:
        if LEVELS[rule.level] <= bar and all(t in tables for t in rule.needs):
            parts.append(rule.check(tables).select(*COLUMNS))
    return reduce(DataFrame.unionByName, parts)


def rule_findings(listings: DataFrame, rule_id: str) -> DataFrame:
    """Findings of one single-row rule."""
    return row_findings(
        listings, [c for c in row_checks(listings.columns) if c.rule_id == rule_id]
    )


def first_per_field(findings: DataFrame, rows: int = 10) -> DataFrame:
    """Report extract: the first findings of each rule and field by record id."""
    order = Window.partitionBy("rule_id", "field").orderBy("record_id")
    ranked = findings.withColumn("_r", F.row_number().over(order))
    return ranked.where(F.col("_r") <= rows).drop("_r")


def first_without_images(listings: DataFrame, rows: int = 50) -> DataFrame:
    """Report extract: the first listings that have no image."""
    found = rule_findings(listings, "completeness_images_available")
    return found.orderBy("record_id").limit(rows)


# Reports over findings ------------------------------------------------------------

def _weight() -> Column:
    weights = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    return F.coalesce(F.element_at(weights, F.col("severity")), F.lit(0.2))


def count_by(findings: DataFrame, column: str) -> DataFrame:
    return findings.groupBy(column).agg(F.count("*").alias("issues"))


def issue_counts(findings: DataFrame) -> DataFrame:
    """Counts per severity and per category in one table."""
    pairs = F.array(
        F.struct(F.lit("severity").alias("kind"), F.col("severity").alias("name")),
        F.struct(F.lit("category").alias("kind"), F.col("category").alias("name")),
    )
    return (
        findings.select(F.explode(pairs).alias("p"))
        .groupBy("p.kind", "p.name")
        .agg(F.count("*").alias("issues"))
    )


def table_rows(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def table_scores(findings: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Score per table with findings: 1 minus the weight over a tenth of its rows."""
    weights = findings.groupBy("table").agg(F.sum(_weight()).alias("_w"))
    return weights.join(table_rows(tables).where("rows > 0"), "table").select(
        "table", _score(F.col("_w"), F.col("rows")).alias("score")
    )


def _score(weight: Column, rows: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), 1.0 - weight / (rows * 0.1)), 3)


def overall_score(findings: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    weight = findings.agg(
        F.coalesce(F.sum(_weight()), F.lit(0.0)).alias("_w"), F.count("*").alias("issues")
    )
    rows = table_rows(tables).agg(F.sum("rows").alias("r")).scalar()
    return weight.withColumn("records", rows).select(
        "records",
        "issues",
        F.when(F.col("records") > 0, _score(F.col("_w"), F.col("records")))
        .otherwise(0.0)
        .alias("score"),
    )


def recommendations(findings: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Advice texts whose thresholds the findings reach, in fixed order."""
    def count_of(column: str, name: str) -> Column:
        return F.count_if(F.col(column) == name).alias(name)

    rows = table_rows(tables).agg(F.sum("rows").alias("r")).scalar()
    facts = findings.agg(
        *[count_of("severity", s) for s in ("critical", "error", "warning")],
        *[count_of("category", c) for c in ("required_fields", "format_validation", "completeness")],
        F.coalesce(F.sum(_weight()), F.lit(0.0)).alias("_w"),
    ).withColumn("_rows", rows)
    score = _score(F.col("_w"), F.col("_rows"))

    def number(name: str, before: str, after: str) -> Column:
        return F.when(
            F.col(name) > 0, F.concat(F.lit(before), F.col(name).cast("string"), F.lit(after))
        )

    advice = [
        number("critical", "Address ", " critical issues immediately"),
        number("error", "Fix ", " data errors to improve reliability"),
        F.when(
            F.col("warning") > 50,
            "High number of warnings suggests systematic data quality issues",
        ),
        F.when(
            F.col("required_fields") > 10,
            "Improve data collection to ensure required fields are populated",
        ),
        F.when(
            F.col("format_validation") > 20,
            "Implement input validation to prevent format issues",
        ),
        F.when(
            F.col("completeness") > 100,
            "Focus on data completeness - many fields are missing",
        ),
        F.when(
            (score > 0) & (score < 0.7),
            "Overall data quality is below recommended threshold (70%)",
        ),
    ]
    return facts.select(
        F.posexplode(F.array_compact(F.array(*advice))).alias("position", "recommendation")
    )


def integrity_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Counts of orphans, repeated addresses and rows missing a required field."""
    listings = tables["listings"]
    repeated = (
        listings.where("url IS NOT NULL").groupBy("url").agg(F.count("*").alias("_n")).where("_n > 1")
    )
    needed = ("title", "price", "seller_name", "category", "material")
    bad = reduce(lambda a, b: a | b, [_empty(c) for c in needed]) | (F.col("price") <= 0)
    parts = {
        "orphan_images": orphan_images(tables),
        "orphan_specifications": orphan_specifications(tables),
        "duplicate_urls": repeated,
        "missing_required": listings.where(bad),
    }
    counts = [
        df.agg(F.count("*").alias("found")).select(F.lit(name).alias("check"), "found")
        for name, df in parts.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def quality_log(before: DataFrame, after: DataFrame, checked_at) -> DataFrame:
    """Score changes between two scorings of the same listings."""
    old = before.select("listing_id", F.col("quality_score").alias("score_before"))
    new = after.select("listing_id", F.col("quality_score").alias("score_after"))
    return old.join(new, "listing_id").select(
        "listing_id",
        F.lit("quality_score").alias("check_type"),
        "score_before",
        "score_after",
        (F.col("score_after") - F.col("score_before")).alias("score_change"),
        F.lit(checked_at).cast("timestamp").alias("logged_at"),
    )
