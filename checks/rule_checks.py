"""Data-quality rule checks."""

from bazaarlens.plans import rules as U
from bazaarlens.sources.derived import AS_OF as NOW
from checks.catalog import check

SHORT = ["rule_id", "severity", "category", "table", "field", "record_id"]


def short(rule_id, severity, category, field, where, table="listings", record="listing_id",
          source=None) -> str:
    """Findings of one rule over the damaged listings."""
    return f"""SELECT '{rule_id}' AS rule_id, {severity} AS severity, '{category}' AS category,
  '{table}' AS "table", '{field}' AS field, {record} AS record_id
  FROM {source or ('dirty' if table == 'listings' else table)} WHERE {where}"""


TITLE_ISSUES = """((length(trim(title)) < 10 OR length(trim(title)) > 200)::INT
  + (upper(title) = title AND lower(title) <> title AND length(trim(title)) > 20)::INT
  + (len(list_filter(string_split_regex(trim(title), '\\s+'), lambda x: x <> '')) < 3)::INT
  + contains(title, '!!!')::INT)"""
ROW_SQL = {
    **{
        f"required_listings_{c}": short(
            f"required_listings_{c}", "'error'", "required_fields", c,
            f"{c} IS NULL OR {c}::VARCHAR = ''")
        for c in U.REQUIRED
    },
    "datatype_price_positive": short(
        "datatype_price_positive", "'error'", "data_types", "price", "price <= 0"),
    "datatype_quality_score_range": short(
        "datatype_quality_score_range", "'warning'", "data_types", "data_completeness_score",
        "data_completeness_score < 0 OR data_completeness_score > 1"),
    "datatype_image_count_nonnegative": short(
        "datatype_image_count_nonnegative", "'warning'", "data_types", "image_count",
        "image_count < 0"),
    "format_url_valid": short(
        "format_url_valid", "'error'", "format_validation", "url",
        "url <> '' AND NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+')"),
    "format_currency_iso": short(
        "format_currency_iso",
        "CASE WHEN regexp_full_match(currency, '[A-Z]{3}') THEN 'info' ELSE 'warning' END",
        "format_validation", "currency",
        "currency NOT IN ('USD','EUR','GBP','CAD','AUD','JPY','CHF','CNY') AND currency <> ''"),
    "business_price_reasonable": short(
        "business_price_reasonable", "CASE WHEN price > hi * 2 THEN 'warning' ELSE 'info' END",
        "business_rules", "price", "price < lo OR price > hi",
        source="""dirty JOIN (VALUES ('rings', 1, 50000), ('necklaces', 5, 30000),
    ('earrings', 5, 20000), ('bracelets', 10, 25000), ('watches', 20, 100000),
    ('brooches', 10, 10000)) r(category, lo, hi) USING (category)"""),
    "business_original_price_logic": short(
        "business_original_price_logic", "'warning'", "business_rules", "original_price",
        "original_price < price"),
    "business_images_quality_correlation": short(
        "business_images_quality_correlation", "'info'", "business_rules", "image_count",
        "data_completeness_score > 0.8 AND image_count = 0"),
    "quality_title_descriptive": short(
        "quality_title_descriptive",
        f"CASE WHEN {TITLE_ISSUES} > 1 THEN 'warning' ELSE 'info' END",
        "data_quality", "title", f"title <> '' AND {TITLE_ISSUES} > 0"),
    "quality_description_completeness": short(
        "quality_description_completeness", "'info'", "data_quality", "description",
        "description <> '' AND (length(description) < 50 OR length(description) > 5000)"),
    "consistency_category_material": short(
        "consistency_category_material", "'warning'", "consistency", "material",
        """(category, material) IN (('watches','fabric'),('watches','wood'),('watches','plastic'),
  ('rings','fabric'),('rings','leather'),('earrings','leather'),('earrings','fabric'),
  ('necklaces','plastic'))"""),
    "completeness_images_available": short(
        "completeness_images_available", "'info'", "completeness", "image_count",
        "coalesce(image_count, 0) = 0"),
    "completeness_essential_fields": " UNION ALL ".join(
        short("completeness_essential_fields", "'warning'", "completeness", c,
              f"{c} IS NULL OR {c} = ''")
        for c in ("brand", "main_stone", "description")),
    "format_email_valid": short(
        "format_email_valid", "'warning'", "format_validation", "seller_email",
        """seller_email <> ''
  AND NOT regexp_matches(seller_email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$')"""),
}
TABLE_SQL = {
    "integrity_orphaned_images": short(
        "integrity_orphaned_images", "'error'", "referential_integrity", "listing_id",
        "listing_id NOT IN (SELECT listing_id FROM dirty)", "images", "image_id"),
    "integrity_orphaned_specs": short(
        "integrity_orphaned_specs", "'error'", "referential_integrity", "listing_id",
        "listing_id NOT IN (SELECT listing_id FROM dirty)", "specifications", "spec_id"),
    "quality_duplicate_listings": short(
        "quality_duplicate_listings", "'warning'", "data_quality", "url", "listing_id <> first_id",
        source="""(SELECT *, min(listing_id) OVER (PARTITION BY url) AS first_id FROM dirty
      WHERE url <> '')"""),
    "consistency_price_category": short(
        "consistency_price_category", "'info'", "consistency", "price", "price > limit_price",
        source="""dirty JOIN (SELECT category, avg(price) + 3 * stddev_pop(price) AS limit_price
      FROM dirty WHERE price > 0 GROUP BY category HAVING count(*) >= 10) USING (category)"""),
}
for rule_id, text in ROW_SQL.items():
    check(f"rule_{rule_id}",
          lambda t, rule_id=rule_id: U.rule_findings(t.dirty, rule_id).select(*SHORT),
          text, "dirty")
for rule in U.TABLE_RULES:
    check(f"rule_{rule.rule_id}",
          lambda t, rule=rule: rule.check(t.dirty_store).select(*SHORT),
          TABLE_SQL[rule.rule_id], "dirty", "images", "specifications")
BASIC = [r for r in ROW_SQL if r.startswith("required")] + ["datatype_price_positive"]
STRICT_ONLY = [
    "format_email_valid",
    "business_images_quality_correlation", "quality_description_completeness",
    "consistency_category_material", "consistency_price_category",
]
EVERYTHING = {**ROW_SQL, **TABLE_SQL}


def union(names) -> str:
    return " UNION ALL ".join(EVERYTHING[n] for n in names)


ALL_TABLES = ("dirty", "images", "specifications", "sessions")
check("validate_basic", lambda t: U.validate(t.dirty_store, "basic").select(*SHORT), union(BASIC),
      "dirty")
check("validate_standard", lambda t: U.validate(t.dirty_store, "standard").select(*SHORT),
      union([n for n in EVERYTHING if n not in STRICT_ONLY]), *ALL_TABLES)
check("validate_strict", lambda t: U.validate(t.dirty_store, "strict").select(*SHORT),
      union(EVERYTHING), *ALL_TABLES)
FINDINGS = f"WITH found AS ({union(EVERYTHING)}), "
WEIGHT = """sum(CASE severity WHEN 'critical' THEN 1.0 WHEN 'error' THEN 0.8 WHEN 'warning' THEN 0.5
  ELSE 0.2 END)::DOUBLE"""
SIZES = """sizes AS (SELECT 'listings' AS "table", count(*) AS rows FROM dirty
  UNION ALL SELECT 'images', count(*) FROM images
  UNION ALL SELECT 'specifications', count(*) FROM specifications
  UNION ALL SELECT 'sessions', count(*) FROM sessions)"""
check("findings_by_severity_category",
      lambda t: U.issue_counts(U.validate(t.dirty_store, "strict")),
      FINDINGS[:-2] + """ SELECT 'severity' AS kind, severity AS name, count(*) AS issues FROM found
  GROUP BY ALL UNION ALL SELECT 'category', category, count(*) FROM found GROUP BY ALL""",
      *ALL_TABLES)
check("quality_score_by_table",
      lambda t: U.table_scores(U.validate(t.dirty_store, "strict"), t.dirty_store),
      FINDINGS + SIZES + f""" SELECT "table", round(greatest(0, 1 - {WEIGHT} /
    (any_value(rows) * 0.1::DOUBLE)), 3) AS score
  FROM found JOIN sizes USING ("table") GROUP BY ALL""", *ALL_TABLES)
check("quality_score_overall",
      lambda t: U.overall_score(U.validate(t.dirty_store, "strict"), t.dirty_store),
      FINDINGS + SIZES + f""" SELECT (SELECT sum(rows)::BIGINT FROM sizes) AS records,
  count(*) AS issues, round(greatest(0, 1 - {WEIGHT} /
    ((SELECT sum(rows)::BIGINT FROM sizes) * 0.1::DOUBLE)), 3) AS score FROM found""", *ALL_TABLES)
check("quality_score_images_only",
      lambda t: U.overall_score(
          U.orphan_images(t.dirty_store),
          {"images": t.images, "listings": t.dirty}),
      f"""SELECT (SELECT count(*) FROM images) + (SELECT count(*) FROM dirty) AS records,
  count(*) AS issues, round(greatest(0, 1 - count(*) * 0.8::DOUBLE / (((SELECT count(*) FROM images)
    + (SELECT count(*) FROM dirty)) * 0.1::DOUBLE)), 3) AS score
  FROM images WHERE listing_id NOT IN (SELECT listing_id FROM dirty)""", "dirty", "images")
check("recommendations",
      lambda t: U.recommendations(U.validate(t.dirty_store, "strict"), t.dirty_store),
      FINDINGS + """facts AS (SELECT count(*) FILTER (severity = 'error') AS e,
    count(*) FILTER (severity = 'warning') AS w,
    count(*) FILTER (category = 'required_fields') AS r,
    count(*) FILTER (category = 'format_validation') AS f,
    count(*) FILTER (category = 'completeness') AS c FROM found),
texts AS (SELECT list_filter([
    CASE WHEN e > 0 THEN 'Fix ' || e || ' data errors to improve reliability' END,
    CASE WHEN w > 50 THEN 'High number of warnings suggests systematic data quality issues' END,
    CASE WHEN r > 10 THEN 'Improve data collection to ensure required fields are populated' END,
    CASE WHEN f > 20 THEN 'Implement input validation to prevent format issues' END,
    CASE WHEN c > 100 THEN 'Focus on data completeness - many fields are missing' END],
    lambda x: x IS NOT NULL) AS l FROM facts)
SELECT i::INT AS position, l[i + 1] AS recommendation
FROM texts, (SELECT unnest(range(0, 10)) AS i) WHERE i < len(l)""", *ALL_TABLES)
check("integrity_summary",
      lambda t: U.integrity_summary(t.dirty_store),
      """SELECT 'orphan_images' AS "check", count(*) AS found FROM images
  WHERE listing_id NOT IN (SELECT listing_id FROM dirty) UNION ALL
  SELECT 'orphan_specifications', count(*) FROM specifications
  WHERE listing_id NOT IN (SELECT listing_id FROM dirty) UNION ALL
  SELECT 'duplicate_urls', count(*) FROM (SELECT url FROM dirty WHERE url IS NOT NULL GROUP BY url
    HAVING count(*) > 1)
  UNION ALL SELECT 'missing_required', count(*) FROM dirty WHERE coalesce(title, '') = ''
    OR coalesce(seller_name, '') = '' OR coalesce(category, '') = ''
    OR coalesce(material, '') = '' OR coalesce(price, 0) <= 0""",
      "dirty", "images", "specifications")
check("missing_essentials_first10",
      lambda t: U.first_per_field(
          U.rule_findings(t.dirty, "completeness_essential_fields").select(*SHORT), 10),
      f"""SELECT * FROM ({ROW_SQL['completeness_essential_fields']})
  QUALIFY row_number() OVER (PARTITION BY field ORDER BY record_id) <= 10""", "dirty")
check("no_image_first50",
      lambda t: U.first_without_images(t.dirty, 50).select(*SHORT),
      f"""SELECT * FROM ({ROW_SQL['completeness_images_available']})
  ORDER BY record_id LIMIT 50""", "dirty")
check("price_outlier_messages",
      lambda t: U.price_outliers(t.dirty_store).select("record_id", "message", "current_value"),
      """SELECT listing_id AS record_id, 'Price $' || format('{:.2f}', price)
    || ' is unusually high for ' || category || ' category' AS message,
  format('{:.2f}', price) AS current_value
  FROM dirty JOIN (SELECT category, avg(price) + 3 * stddev_pop(price) AS limit_price
    FROM dirty WHERE price > 0 GROUP BY category HAVING count(*) >= 10) USING (category)
  WHERE price > limit_price""", "dirty")


def _log(t):
    scores = t.listings.select("listing_id", "data_completeness_score", "image_count")
    before = scores.selectExpr("listing_id", "data_completeness_score AS quality_score")
    after = scores.selectExpr(
        "listing_id", "least(1.0D, data_completeness_score + image_count / 10) AS quality_score")
    return U.quality_log(before, after, NOW)


check("quality_log", _log,
      """SELECT listing_id, 'quality_score' AS check_type, round(b, 4) AS score_before,
  round(a, 4) AS score_after, round(a - b, 4) AS score_change,
  TIMESTAMP '2001-11-04' AS logged_at
  FROM (SELECT listing_id, data_completeness_score AS b,
    least(1.0::DOUBLE, data_completeness_score + image_count / 10) AS a FROM listings)""",
      "listings")
