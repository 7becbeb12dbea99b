"""Field extraction, enrichment, scoring, page and image-metadata checks."""

from pyspark.sql import functions as F

from bazaarlens.functions import images as img
from bazaarlens.functions import scoring as S
from bazaarlens.functions import text as T
from bazaarlens.plans import ingest as I
from bazaarlens.plans import pages as P
from bazaarlens.sources.derived import AS_OF as NOW
from bazaarlens.sources.derived import SITE
from checks.catalog import check
from checks.tables import AS_OF

SITE_SQL = "https://shop.example.com"


def docs(name: str, column, expression: str) -> None:
    """One expression over the whole text of every document."""
    check(
        name,
        lambda t: t.read("documents").select("doc_id", column(F.col("text")).alias("found")),
        f"SELECT doc_id, {expression} AS found FROM documents",
    )


def rx(pattern: str, group: int = 0, source: str = "text") -> str:
    return f"nullif(regexp_extract({source}, '(?i){pattern}', {group}), '')"


def dq(patterns, group: int = 0, source: str = "text") -> str:
    return "coalesce(" + ", ".join(rx(p, group, source) for p in patterns) + ")"


def contains_any(words, source: str = "lower(text)") -> str:
    return "(" + " OR ".join(f"contains({source}, '{w}')" for w in words) + ")"


def first_label(vocabulary, default: str, source: str = "lower(text)") -> str:
    cases = " ".join(f"WHEN {contains_any(ws, source)} THEN '{c}'" for c, ws in vocabulary)
    return f"CASE {cases} ELSE '{default}' END"


SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
docs("clean_title", lambda c: T.clean_title(c),
     r"""CASE WHEN length(x) > 500 THEN left(x, 497) || '...' ELSE x END AS found FROM
  (SELECT doc_id, regexp_replace(trim(regexp_replace(text, '[\s\p{Z}\x{85}]+', ' ', 'g')),
    '[^\p{L}\p{N}_\s\-.,:;!?()&''"]+', '', 'g') AS x FROM documents) --""")
docs("price_from_text", lambda c: T.price_value(c),
     "coalesce(" + ", ".join(
         rf"""(SELECT try_cast(CASE WHEN NOT contains(d, '.') AND regexp_full_match(d, '[^,]*,[^,]{{0,2}}')
    THEN replace(d, ',', '.') ELSE replace(d, ',', '') END AS DOUBLE)
    FROM (SELECT regexp_replace({rx(p)}, '[^\d.,]', '', 'g') AS d))"""
         for p in T.PRICE_PATTERNS) + ", 0.0)")
docs("currency_from_text", lambda c: T.currency(c),
     r"""CASE WHEN regexp_matches(text, '(?i)\$|USD') THEN 'USD'
  WHEN regexp_matches(text, '(?i)€|EUR') THEN 'EUR' WHEN regexp_matches(text, '(?i)£|GBP') THEN 'GBP'
  WHEN regexp_matches(text, '(?i)CAD') THEN 'CAD' WHEN regexp_matches(text, '(?i)AUD') THEN 'AUD'
  ELSE 'USD' END""")
docs("category_from_text", lambda c: T.category(c), first_label(T.CATEGORY_WORDS, "other"))
docs("category_by_score", lambda c: T.scored_category(c),
     "coalesce((SELECT arg_max(label, (hits, -rank)) FROM (VALUES "
     + ", ".join(
         f"({i}, '{label}', " + " + ".join(f"contains(lower(text), '{w}')::INT" for w in words) + ")"
         for i, (label, words) in enumerate(T.SCORED_CATEGORY_WORDS))
     + ") v(rank, label, hits) WHERE hits > 0), 'other')")
docs("gemstone_from_text", lambda c: T.primary_gemstone(c), f"lower({dq(T.GEMSTONE_PATTERNS)})")
docs("materials_from_text", lambda c: F.array_join(T.all_materials(c), ","),
     "concat_ws(',', " + ", ".join(
         f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{m}' END" for m, p in T.MATERIAL_PATTERNS)
     + ")")
docs("material_from_text", lambda c: T.primary_material(c),
     "CASE " + " ".join(
         f"WHEN regexp_matches(text, '(?i){p}') THEN '{m}'" for m, p in T.MATERIAL_PATTERNS)
     + " ELSE 'unknown' END")
docs("first_number", lambda c: T.first_number(c),
     r"try_cast(nullif(regexp_extract(replace(text, ',', ''), '\d+'), '') AS BIGINT)")
docs("percentage", lambda c: T.percentage(c),
     r"try_cast(nullif(regexp_extract(text, '(\d+(?:\.\d+)?)%', 1), '') AS DOUBLE)")
docs("weight_from_text", lambda c: T.weight(c), dq(T.WEIGHTS))
docs("dimensions_from_text", lambda c: T.dimensions(c), dq(T.DIMENSIONS))
docs("item_number", lambda c: T.item_number(c), dq(T.ITEM_NUMBERS, 1))
docs("listing_type", lambda c: T.listing_type(c), first_label(T.LISTING_TYPES, "Unknown"))
docs("listing_status", lambda c: T.listing_status(c), first_label(T.STATUS_WORDS, "unknown"))
check(
    "stone_attributes",
    lambda t: t.read("documents").select(
        "doc_id",
        T.stone_color(F.col("text")).alias("color"),
        T.stone_clarity(F.col("text")).alias("clarity"),
        T.stone_cut(F.col("text")).alias("cut"),
        T.stone_carat(F.col("text")).alias("carat"),
    ),
    f"""SELECT doc_id, lower({rx(T.STONE_COLOR, 1)}) AS color, upper({rx(T.STONE_CLARITY, 1)})
    AS clarity, lower({rx(T.STONE_CUT, 1)}) AS cut, {rx(T.STONE_CARAT, 1)} AS carat
  FROM documents""",
)

# Listing texts built from several columns, so that the patterns have something to find.
_DETAIL = ("concat(title, ' size ', watchers, ' ', image_count, '.5 ct ', views, ' cm ', "
           "watchers, ' grams ', coalesce(main_stone, ''), "
           "' round cut VS', coalesce(bids, 0), ' gold')")
check(
    "sizes_by_category",
    lambda t: t.listings.select("listing_id", "category", F.expr(_DETAIL).alias("detail")).select(
        "listing_id", T.size_for(F.col("detail"), F.col("category")).alias("found")),
    f"""SELECT listing_id, CASE WHEN category = 'rings' THEN {dq(T.RING_SIZES, 1, 'd')}
    WHEN category IN ('necklaces', 'bracelets', 'chains') THEN {dq(T.LENGTH_SIZES, 1, 'd')} END
    AS found FROM (SELECT *, {_DETAIL} AS d FROM listings)""",
    "listings",
)
check(
    "enriched_listings",
    lambda t: I.enrich_listings(
        t.listings.select("listing_id", "title", "condition",
                          F.expr(_DETAIL).alias("description"))
    ).select("listing_id", "condition", "category", "material", "main_stone", "stone_clarity",
             "stone_cut", "stone_carat", "weight", "size", "description_length"),
    f"""SELECT listing_id, CASE condition WHEN 'new' THEN 'New' WHEN 'used' THEN 'Used'
    ELSE 'Seller refurbished' END AS condition, c AS category, 'gold' AS material,
  lower({dq(T.GEMSTONE_PATTERNS, 0, 'b')}) AS main_stone, upper({rx(T.STONE_CLARITY, 1, 'b')})
    AS stone_clarity, lower({rx(T.STONE_CUT, 1, 'b')}) AS stone_cut,
  {rx(T.STONE_CARAT, 1, 'b')} AS stone_carat, {dq(T.WEIGHTS, 0, 'b')} AS weight,
  CASE WHEN c = 'rings' THEN {dq(T.RING_SIZES, 1, 'b')} END AS size,
  length(d)::INT AS description_length
  FROM (SELECT *, title || ' ' || d AS b,
      CASE WHEN contains(title, 'ring') THEN 'rings' ELSE 'other' END AS c
    FROM (SELECT *, {_DETAIL} AS d FROM listings))""",
    "listings",
)
check("url_parts",
      lambda t: t.pages.select(
          "page_id", T.listing_id(F.col("url")).alias("listing_id"),
          T.page_listing_id(F.col("url")).alias("page_listing_id"),
          T.is_url(F.col("url")).alias("is_url")),
      r"""SELECT page_id, coalesce(nullif(regexp_extract(url, '/itm/.*?/(\d+)', 1), ''),
    nullif(regexp_extract(url, '/itm/(\d+)', 1), ''), nullif(regexp_extract(url, 'item=(\d+)', 1), ''),
    nullif(regexp_extract(url, '#(\d+)', 1), ''), left(md5(url), 12)) AS listing_id,
  coalesce(nullif(regexp_extract(url, '/itm/([^/?]+)', 1), ''), left(md5(url), 12))
    AS page_listing_id,
  regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\s]+') AS is_url FROM pages""")
check("listing_ids_from_urls",
      lambda t: t.listings.select("url", T.page_listing_id(F.col("url")).alias("item")).distinct(),
      "SELECT DISTINCT url, replace(url, 'https://shop.example.com/itm/', '') AS item FROM listings",
      "listings")

# Listing phrases with what each extractor must find in them, written by hand. ----------------

PHRASES = [
    "Buy it now: white gold ring with 1.5 ct round diamond VS1, 3.5 grams, $1,200.50",
    "Auction lot, sterling silver .925 pendant 10 x 20 mm, 2 oz, EUR 30, item number: 123456",
    "Platinum band £450 size 7, 5 dwt, eye clean emerald, best offer, no longer available",
    "Stainless steel watch, CAD 99.90, 15% off, sold",
    "Titanium bracelet AUD 75, 6.5 L x 2 W, pink opal, 2.25 carats, heart, flawless",
    "Plain text without any of it",
    "#123456789012 active auction, 18k gold and platinum, cz, yellow, 0.5 ct, 2.5% fee, 12 x 8 x 3 cm",
    "Princess cut ruby, VVS2, colorless, 20 lbs of bin items ended",
]
EXPECTED = {
    "gemstone": (T.primary_gemstone, ["diamond", None, "emerald", None, "opal", None, "cz", "ruby"]),
    "weight": (T.weight, ["3.5 grams", "2 oz", "5 dwt", None, None, None, None, "20 lbs"]),
    "dimensions": (T.dimensions, [None, "10 x 20 mm", None, None, "6.5 L x 2 W", None,
                                  "12 x 8 x 3 cm", None]),
    "item_number": (T.item_number, [None, "123456", None, None, None, None, "123456789012", None]),
    "type": (T.listing_type, ["Buy It Now", "Auction", "Best Offer", "Unknown", "Unknown",
                              "Unknown", "Auction", "Buy It Now"]),
    "status": (T.listing_status, ["active", "unknown", "sold", "sold", "unknown", "unknown",
                                  "active", "sold"]),
    "currency": (T.currency, ["USD", "EUR", "GBP", "CAD", "AUD", "USD", "USD", "USD"]),
    "material": (T.primary_material, ["gold", "silver", "platinum", "stainless_steel", "titanium",
                                      "unknown", "gold", "unknown"]),
    "materials": (lambda c: F.array_join(T.all_materials(c), ","),
                  ["gold", "silver", "platinum", "stainless_steel", "titanium", "",
                   "gold,platinum", ""]),
    "color": (T.stone_color, ["white", None, None, None, "pink", None, "yellow", "colorless"]),
    "clarity": (T.stone_clarity, ["VS1", None, "EYE CLEAN", None, "FLAWLESS", None, None, "VVS2"]),
    "cut": (T.stone_cut, ["round", None, "emerald", None, "heart", None, None, "princess"]),
    "carat": (T.stone_carat, ["1.5", None, None, None, "2.25", None, "0.5", None]),
    "percentage": (lambda c: T.percentage(c).cast("string"),
                   [None, None, None, "15.0", None, None, "2.5", None]),
}


def _phrase():
    """A listing's phrase, chosen by its watchers."""
    place = (F.col("watchers") % len(PHRASES) + 1).cast("int")
    return F.concat_ws(" ", F.element_at(F.array(*map(F.lit, PHRASES)), place), F.lit("|"))


for _name, (_read, _values) in EXPECTED.items():
    _list = ", ".join("NULL" if v is None else f"'{v}'" for v in _values)
    check(
        f"phrase_{_name}",
        lambda t, read=_read: t.listings.select("listing_id", read(_phrase()).alias("found")),
        f"SELECT listing_id, ([{_list}])[watchers % {len(PHRASES)} + 1] AS found FROM listings",
        "listings",
    )
check(
    "auto_validated",
    lambda t: t.listings.select(
        "listing_id", S.auto_validated(F.col("data_completeness_score")).alias("now"),
        S.auto_validated(F.col("data_completeness_score"), S.SCORE_V1).alias("before")),
    f"""SELECT listing_id, data_completeness_score >= {S.SCORE_V2.validate_from} AS now,
  data_completeness_score >= {S.SCORE_V1.validate_from} AS before FROM listings""",
    "listings",
)

# Pages -----------------------------------------------------------------------------------

HREFS = "regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)"
VISIBLE = r"""trim(regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'),
    '(?s)<[^>]*>', ' ', 'g'), '[\s\p{Z}\x{85}]+', ' ', 'g'))"""


def _unescape(expression: str) -> str:
    # the references that the pages hold; the ampersand comes last, so none is decoded twice
    for name, sign in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
                       ("&nbsp;", "\u00a0"), ("&amp;", "&")]:
        expression = f"replace({expression}, '{name}', '{sign}')"
    return expression


def _inner(tag: str) -> str:
    return rf"nullif(regexp_extract(html, '(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>', 1), '')"


def _plain(expression: str) -> str:
    bare = _unescape(rf"regexp_replace({expression}, '(?s)<[^>]*>', '', 'g')")
    return rf"trim(regexp_replace({bare}, '[\s\p{{Z}}\x{{85}}]+', ' ', 'g'))"


check(
    "page_fields",
    lambda t: P.page_fields(t.pages),
    rf"""SELECT page_id, url,
  nullif(regexp_extract(html, '(?i)<html\b[^>]*\blang\s*=\s*["'']([^"'']*)["'']', 1), '') AS lang,
  trim(regexp_replace({_unescape(_inner('title'))}, '[\s\p{{Z}}\x{{85}}]+', ' ', 'g')) AS title,
  nullif({_plain(_inner('h1'))}, '') AS heading, length({VISIBLE})::INT AS text_length,
  length(html)::INT AS html_length, len({HREFS})::INT AS links FROM pages""",
)
check(
    "page_links",
    lambda t: P.page_links(t.pages, SITE, marker="/", item=r"\.com/([^/?]+)"),
    rf"""SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1)::INT AS position,
  item_id, link FROM (
    SELECT page_id, item_id, min(pos) AS pos, arg_min(link, pos) AS link FROM (
      SELECT page_id, pos, link, nullif(regexp_extract(link, '\.com/([^/?]+)', 1), '') AS item_id
      FROM (SELECT page_id, generate_subscripts(h, 1) AS pos,
              CASE WHEN starts_with(unnest(h), 'http') THEN unnest(h)
                   WHEN starts_with(unnest(h), '/') THEN '{SITE_SQL}' || unnest(h) END AS link
            FROM (SELECT page_id, {HREFS} AS h FROM pages)))
    WHERE item_id IS NOT NULL AND contains(link, '/') GROUP BY page_id, item_id)""",
)
check(
    "page_features",
    lambda t: P.page_features(t.pages).select("page_id", "feature"),
    rf"""SELECT DISTINCT page_id, feature FROM (
    SELECT page_id, trim(regexp_replace({_plain('item')}, '(?i)\bSee original listing\b', '', 'g'))
      AS feature FROM (SELECT page_id,
      unnest(regexp_extract_all(html, '(?is)<li\b[^>]*>(.*?)</li\s*>', 1)) AS item FROM pages)
    UNION ALL SELECT page_id, trim(unnest(regexp_extract_all({VISIBLE}, '[•*-]\s*([^•*\-\n]+)', 1)))
      FROM pages) WHERE length(feature) > 10""",
)
check(
    "listings_from_pages",
    lambda t: P.extract_listings(t.listing_pages).select(
        "page_id", "listing_id", "title", "price", "condition", "seller_name", "image_count",
        "category", "material", "currency", "main_image_path"),
    """SELECT listing_id AS page_id, regexp_extract(url, '/itm/(.+)$', 1) AS listing_id,
  array_to_string(list_transform(string_split(title, ' '), lambda w: upper(w[1]) || w[2:]), ' ')
    || ' & ' || coalesce(brand, 'plain') || ' é$B' AS title, price,
  CASE condition WHEN 'new' THEN 'New' WHEN 'used' THEN 'Used' ELSE 'Seller refurbished' END
    AS condition, CASE WHEN watchers = 9 THEN 'unknown' ELSE seller_name END AS seller_name,
  image_count + 3 AS image_count,
  CASE WHEN contains(title, 'ring') THEN 'rings' ELSE 'other' END AS category,
  'unknown' AS material, 'USD' AS currency,
  'https://img.example.com/main/s-l1600.jpg' AS main_image_path
  FROM listings WHERE watchers NOT IN (7, 13)""",
    "listings",
)
check(
    "images_from_pages",
    lambda t: P.page_images(t.listing_pages, SITE, "img.example.com"),
    """SELECT listing_id AS page_id, (generate_subscripts(urls, 1) - 1)::INT AS position,
  unnest(urls) AS image_url FROM (SELECT listing_id,
    ['https://img.example.com/main/s-l1600.jpg']
    || list_transform(range(image_count + 1),
         lambda i: 'https://img.example.com/' || i || '/s-l1600.jpg')
    || ['https://img.example.com/big/s-l1600.jpg'] AS urls FROM listings)""",
    "listings",
)
check(
    "cards_from_result_pages",
    lambda t: P.result_cards(t.result_pages, SITE),
    f"""SELECT listing_id AS page_id, url AS source_page, 0 AS position, 'New ' || title AS title,
  price, '{SITE_SQL}/itm/' || listing_id || '?a=1' AS url, 'Pre-Owned lot' AS condition,
  'https://img.example.com/c.jpg' AS image_url,
  CASE WHEN contains(title, 'ring') THEN 'rings' ELSE 'other' END AS category,
  'unknown' AS material FROM listings
UNION ALL SELECT listing_id, url, 1, material || ' <set>', 0.0,
  'https://other.example.com/' || watchers, 'Unknown', NULL, 'other', 'unknown' FROM listings""",
    "listings",
)
check(
    "specifications_from_pages",
    lambda t: P.specification_rows(t.listing_pages).groupBy(
        "listing_id", "attribute_name", "attribute_value", "confidence_score").count(),
    """SELECT regexp_extract(url, '/itm/(.+)$', 1) AS listing_id, name AS attribute_name,
  val AS attribute_value, 0.9 AS confidence_score, count(*) AS count
  FROM (SELECT url, 'Material' AS name, material AS val FROM listings UNION ALL
        SELECT url, 'Stone', main_stone FROM listings) WHERE val <> '' GROUP BY ALL""",
    "listings",
)
check(
    "ingest_gate",
    lambda t: I.ingest(t.listing_pages, keep_incomplete=True).groupBy(
        "accepted", "quality_class", "gate_score").count(),
    """SELECT gone = 0 AS accepted, CASE WHEN s >= 0.5 THEN 'fair' WHEN s >= 0.3 THEN 'poor'
    ELSE 'invalid' END AS quality_class, 1.0::DOUBLE - gone / 10 AS gate_score, count(*) AS count
  FROM (SELECT gone, round((8.0::DOUBLE - gone) / 9 * 0.30 + 1.0::DOUBLE / 8 * 0.25
    + (least((image_count + 3) / 15, 0.4) + least((14.0::DOUBLE - gone) / 50, 0.3)) * 0.15, 3)
    AS s FROM (SELECT *, (watchers IN (7, 13))::INT AS gone FROM listings)) GROUP BY ALL""",
    "listings",
)
_FILL = "(({0})::INT)"
_CORE = " + ".join(
    _FILL.format(x) for x in [
        "listing_id <> ''", "title <> ''", "price > 0", "currency <> ''", "condition <> ''",
        "seller_name <> ''", "url <> ''", "category <> ''", "material <> ''"])
_MORE = " + ".join(
    f"coalesce({_FILL.format(x)}, 0)"
    for x in ["brand <> ''", "main_stone <> ''", "description <> ''"])
_TALK = " + ".join(f"coalesce({_FILL.format(x)}, 0)" for x in ["watchers > 0", "views > 0", "bids > 0"])
_REST = " + ".join(
    f"coalesce({_FILL.format(x)}, 0)"
    for x in ["original_price > 0", "seller_rating > 0", "image_count > 0",
              "data_completeness_score > 0", "is_validated", "scraped_at IS NOT NULL"])
check(
    "quality_score_current",
    lambda t: t.listings.select("listing_id", S.quality_score(t.listings, decimals=10).alias("score")),
    f"""SELECT listing_id, round(({_CORE})::DOUBLE / 9 * 0.30
  + ({_MORE} + coalesce((seller_rating > 0)::INT, 0))::DOUBLE / 8 * 0.25
  + ({_TALK})::DOUBLE / 4 * 0.10
  + (CASE WHEN image_count > 0 THEN least(image_count / 15, 0.4) ELSE 0 END
     + CASE WHEN length(description) > 50 THEN least(length(description) / 2000, 0.3) ELSE 0 END
     + least(({_CORE} + {_MORE} + {_TALK} + {_REST})::DOUBLE / 50, 0.3)) * 0.15, 10) AS score
  FROM listings""",
    "listings", digits=10,
)
check(
    "quality_score_first",
    lambda t: t.listings.select("listing_id", S.quality_score(t.listings, S.SCORE_V1, 10).alias("score")),
    f"""SELECT listing_id, round(({_CORE})::DOUBLE / 9 * 0.40 + ({_MORE})::DOUBLE / 7 * 0.35
  + CASE WHEN image_count > 0 THEN least(image_count / 10, 0.3) ELSE 0 END * 0.1, 10) AS score
  FROM listings""",
    "listings", digits=10,
)
check(
    "gate_errors",
    lambda t: t.dirty.withColumn("quality_score", F.col("data_completeness_score")).select(
        "url", "listing_id", "watchers", F.array_join(S.gate_errors(), "; ").alias("errors")),
    r"""SELECT url, listing_id, watchers, concat_ws('; ',
  CASE WHEN coalesce(listing_id, '') = '' THEN 'ID is required' END,
  CASE WHEN coalesce(title, '') = '' THEN 'Title is required' END,
  CASE WHEN NOT coalesce(price > 0, false) THEN 'Valid price is required' END,
  CASE WHEN coalesce(seller_name, '') = '' THEN 'Seller ID is required' END,
  CASE WHEN coalesce(url, '') = '' THEN 'Listing URL is required' END,
  CASE WHEN coalesce(category, '') = '' THEN 'Category is required' END,
  CASE WHEN coalesce(material, '') = '' THEN 'Material is required' END,
  CASE WHEN data_completeness_score < 0.3 THEN 'Data quality score too low' END,
  CASE WHEN url <> '' AND NOT regexp_matches(url, '^[a-z]+://[^/]+') THEN
    'Invalid listing URL format' END,
  CASE WHEN price > original_price * 2 AND original_price > 0 THEN
    'Current price seems unusually high compared to original price' END) AS errors FROM dirty""",
    "dirty",
)
check(
    "gate_errors_first",
    lambda t: t.dirty.select("listing_id", "watchers", F.array_join(S.basic_gate_errors(), "; ")
                             .alias("errors")),
    """SELECT listing_id, watchers, concat_ws('; ',
  CASE WHEN coalesce(listing_id, '') = '' THEN 'ID is required' END,
  CASE WHEN coalesce(title, '') = '' THEN 'Title is required' END,
  CASE WHEN NOT coalesce(price > 0, false) THEN 'Valid price is required' END,
  CASE WHEN coalesce(seller_name, '') = '' THEN 'Seller ID is required' END,
  CASE WHEN coalesce(url, '') = '' THEN 'Listing URL is required' END) AS errors FROM dirty""",
    "dirty",
)
check("content_hash",
      lambda t: t.listings.select("listing_id", S.content_hash().alias("content_hash")),
      """SELECT listing_id, md5(title || '|' || format('{:.2f}', price) || '|' || seller_name || '|'
  || category || '|' || material) AS content_hash FROM listings""", "listings")
check("session_measures",
      lambda t: t.sessions.select("session_id", *[c.alias(n) for n, c in S.session_measures(NOW).items()]),
      f"""SELECT session_id, d AS duration_seconds,
  round(coalesce(listings_scraped * 100.0::DOUBLE / nullif(listings_scraped + listings_failed, 0), 0), 4)
    AS success_rate,
  round(requests_successful * 100.0::DOUBLE / requests_made, 4) AS request_success_rate,
  status = 'running' AS is_active,
  round(CASE WHEN progress_percentage > 0 THEN d / (progress_percentage / 100) - d END, 4)
    AS seconds_remaining
  FROM (SELECT *, epoch(coalesce(completed_at, {AS_OF}) - started_at) AS d FROM sessions)""",
      "sessions")

# Image metadata ------------------------------------------------------------------------

check(
    "image_scores",
    lambda t: t.images.select(
        "image_id", img.resolution_score().alias("resolution"), img.contrast_score().alias("contrast"),
        img.brightness_score().alias("brightness"), img.composition_score().alias("composition"),
        img.overall_score().alias("overall"), img.simple_score().alias("simple"),
        img.mean_of_positive(F.col("quality_score"), img.contrast_score()).alias("mean_positive"),
    ),
    """SELECT image_id, round(r, 10) AS resolution, round(c, 10) AS contrast,
  round(b, 10) AS brightness, k AS composition,
  round(r * 0.25 + 0.125 + c * 0.15 + b * 0.15 + 0.05 + k * 0.1, 10) AS overall,
  round(greatest(0, least(1, r * 0.6 + greatest(0, least(1, 1 - abs(width / height - 1) * 0.3)) * 0.4
    - CASE WHEN width < 200 OR height < 200 THEN 0.3 ELSE 0 END)), 10) AS simple,
  round(coalesce(((quality_score > 0)::INT * quality_score + (c > 0)::INT * c)
    / nullif((quality_score > 0)::INT + (c > 0)::INT, 0), 0), 10) AS mean_positive
  FROM (SELECT *, least(1.0::DOUBLE, width * height / 1000000) AS r,
    least(1.0::DOUBLE, gray_stddev / 64) AS c, 1.0::DOUBLE - abs(gray_mean / 255 - 0.5) * 2 AS b,
    (CASE WHEN width / height BETWEEN 0.8 AND 1.2 THEN 1.0
          WHEN width / height BETWEEN 0.6 AND 1.6 THEN 0.8 ELSE 0.6 END)::DOUBLE AS k FROM images)""",
    "images", digits=10,
)
check(
    "image_row_errors",
    lambda t: t.images.groupBy(img.row_error().alias("error")).count(),
    """SELECT CASE WHEN file_size < 1024 THEN 'File too small (minimum 1KB)'
    WHEN width < 50 OR height < 50 THEN 'Image too small (minimum 50x50 pixels)'
    WHEN format = 'SVG' THEN 'Unsupported format: SVG'
    WHEN color_mode = 'CMYK' THEN 'Unsupported color mode: CMYK' END AS error, count(*) AS count
  FROM images GROUP BY 1""",
    "images",
)
ADDRESSES = """array(original_url, 'no address', 'https://x.example.com/file.txt', '/local/a.jpg',
  concat('https://x.example.com/IMAGE/', image_id), 'https://x.example.com/pic.WEBP', 'ftp:a.png')"""
check(
    "image_url_lists",
    lambda t: t.images.select(
        "image_id", F.array_join(T.image_urls(F.expr(ADDRESSES)), " ").alias("usable"),
        T.normal_image_url(F.col("original_url"), SITE).alias("main")),
    """SELECT image_id, concat_ws(' ', original_url, 'https://x.example.com/IMAGE/' || image_id,
    'https://x.example.com/pic.WEBP') AS usable, original_url AS main FROM images""",
    "images",
)
check(
    "cleaned_texts",
    lambda t: t.listings.select("listing_id", T.clean_text(F.concat(
        F.lit(" \t See original listing "), "title", F.lit("\n\n see ORIGINAL  listing, ask.  "))).alias("text")),
    r"""SELECT listing_id, trim(regexp_replace(trim(regexp_replace(
    '  See original listing ' || title || ' see ORIGINAL listing, ask. ', '\s+', ' ', 'g')),
    '(?i)\bSee original listing\b', '', 'g')) AS text FROM listings""",
    "listings",
)
