"""Join, duplicate, history and near-duplicate checks."""

from pyspark.sql import functions as F

from bazaarlens.operators import joins
from bazaarlens.operators.latest import duplicate_rows, fresh_only, latest_per_key, upsert
from bazaarlens.operators.neighbours import keep_first, near_duplicates
from bazaarlens.operators.quantiles import exact_quantiles
from bazaarlens.operators.trailing import price_history
from bazaarlens.plans.query import ListingQuery
from bazaarlens.sources.derived import AS_OF as NOW
from bazaarlens.sources.derived import datetime
from checks.catalog import check
from checks.tables import AS_OF

for how, word in [("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"),
                  ("full", "FULL JOIN")]:
    check(
        f"join_images_{how}",
        lambda t, how=how: ListingQuery(t.listings.select("listing_id", "price"))
        .join_images(t.images.select("listing_id", "image_id", "quality_score"), how).build(),
        f"""SELECT listing_id, price, image_id, quality_score
  FROM (SELECT listing_id, price FROM listings)
  {word} (SELECT listing_id, image_id, quality_score FROM images) USING (listing_id)""",
        "listings", "images",
    )
    check(
        f"join_sessions_{how}",
        lambda t, how=how: joins.session_join(
            t.listings.select("listing_id", "scraped_at"), t.sessions, NOW, how,
            session_columns=["session_id", "status"],
        ),
        f"""SELECT listing_id, scraped_at, session_id, status FROM listings {word} sessions
  ON scraped_at BETWEEN started_at AND coalesce(completed_at, {AS_OF})""",
        "listings", "sessions",
    )
check(
    "join_specifications",
    lambda t: ListingQuery(t.listings.select("listing_id", "title"))
    .join_specifications(t.specifications, "inner").build(),
    """SELECT listing_id, title, spec_id, attribute_name, attribute_value
  FROM listings JOIN specifications USING (listing_id)""",
    "listings", "specifications",
)
check("orphan_images_anti_join",
      lambda t: joins.fk_violations(t.images, t.listings, "listing_id").select("image_id", "listing_id"),
      """SELECT image_id, listing_id FROM images
  WHERE listing_id NOT IN (SELECT listing_id FROM listings)""", "listings", "images")
check("orders_without_lines",
      lambda t: joins.fk_violations(
          t.read("orders"), t.read("lineitem"), "o_orderkey", "l_orderkey").select("o_orderkey"),
      "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
check("semi_join_images",
      lambda t: joins.present_in(t.images, t.listings.where("NOT is_validated"), "listing_id")
      .select("image_id"),
      """SELECT image_id FROM images
  WHERE listing_id IN (SELECT listing_id FROM listings WHERE NOT is_validated)""",
      "listings", "images")

LATEST = """SELECT * FROM (SELECT listing_id, url, price, scraped_at,
  row_number() OVER (PARTITION BY url ORDER BY scraped_at DESC, listing_id DESC) AS r
  FROM listings) WHERE r = 1"""
check("latest_per_url",
      lambda t: latest_per_key(
          t.listings.select("listing_id", "url", "price", "scraped_at"), ["url"],
          ["scraped_at", "listing_id"]),
      f"SELECT * EXCLUDE (r) FROM ({LATEST})", "listings")
check("duplicate_urls",
      lambda t: duplicate_rows(t.listings),
      """SELECT url, listing_id, duplicate_of, group_size FROM (SELECT url, listing_id,
    min(listing_id) OVER (PARTITION BY url) AS duplicate_of,
    count(*) OVER (PARTITION BY url) AS group_size FROM listings)
  WHERE group_size > 1 AND listing_id <> duplicate_of""", "listings")
check("fresh_only",
      lambda t: fresh_only(t.listings, t.listings.where("is_validated")).select("listing_id", "url"),
      """SELECT listing_id, url FROM listings
  WHERE url NOT IN (SELECT url FROM base)""", "base")


def _upserted(t):
    """Old rows, then new sightings of some listings at a later time and price."""
    old = t.listings.where("NOT is_validated").select("listing_id", "url", "price", "scraped_at")
    new = t.listings.where("bids = 2").select(
        "listing_id", "url", (F.col("price") + 1).alias("price"),
        (F.col("scraped_at") + F.expr("interval 1 day")).alias("scraped_at"),
    )
    return upsert(old, new)


check("upsert_listings", _upserted,
      """WITH rows AS (SELECT listing_id, url, price, scraped_at, 0 AS fresh FROM listings
    WHERE NOT is_validated UNION ALL
  SELECT listing_id, url, price + 1, scraped_at + INTERVAL 1 DAY, 1 FROM listings WHERE bids = 2),
by_id AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY listing_id
    ORDER BY scraped_at DESC, fresh DESC) = 1)
SELECT listing_id, url, price, scraped_at FROM by_id QUALIFY row_number() OVER (PARTITION BY url
    ORDER BY scraped_at DESC, fresh DESC, listing_id DESC) = 1""", "listings", digits=2)
check("price_history",
      lambda t: price_history(t.listings).select(
          "listing_id", "url", "price", "prev_price", "price_change", "price_drop",
          "discount_percentage"),
      """SELECT listing_id, url, price, prev_price, round(price - prev_price, 4) AS price_change,
  round(original_price - price, 4) AS price_drop,
  round((original_price - price) * 100.0::DOUBLE / original_price, 4) AS discount_percentage
  FROM (SELECT *, lag(price) OVER (PARTITION BY url ORDER BY scraped_at, listing_id) AS prev_price
        FROM listings)""", "listings")
check("seller_price_quantiles",
      lambda t: exact_quantiles(t.listings, ["seller_name"], "price",
                                {"p10": 0.1, "p50": 0.5, "p99": 0.99}),
      """SELECT seller_name, round(quantile_cont(price, 0.1), 4) AS p10,
  round(quantile_cont(price, 0.5), 4) AS p50, round(quantile_cont(price, 0.99), 4) AS p99
  FROM listings GROUP BY seller_name""", "listings")
check("overall_price_quantiles",
      lambda t: exact_quantiles(t.listings, ["currency"], "price", {"p25": 0.25, "p75": 0.75}),
      """SELECT currency, round(quantile_cont(price, 0.25), 4) AS p25,
  round(quantile_cont(price, 0.75), 4) AS p75 FROM listings GROUP BY currency""", "listings")
check(
    "near_duplicate_images",
    lambda t: near_duplicates(t.hashes).select("image_id", "duplicate_of", "distance"),
    """SELECT a.image_id, min(b.image_id) AS duplicate_of,
  arg_min(bit_count(xor(a.code, b.code)), b.image_id)::INT AS distance
  FROM codes a LEFT JOIN codes b ON b.image_id < a.image_id
    AND bit_count(xor(a.code, b.code)) <= 5 GROUP BY a.image_id""",
    "codes",
)
check(
    "keep_first_images",
    lambda t: keep_first(t.hashes).select("image_id", "duplicate_of", "distance"),
    """WITH RECURSIVE placed AS (
  SELECT image_id, code, row_number() OVER (ORDER BY image_id) AS n FROM codes),
walk AS (
  SELECT 0::BIGINT AS n, []::STRUCT(i BIGINT, c UBIGINT)[] AS kept, NULL::BIGINT AS image_id,
    NULL::STRUCT(i BIGINT, c UBIGINT) AS near, NULL::UBIGINT AS code
  UNION ALL
  SELECT n, CASE WHEN hit IS NULL THEN list_append(kept, {'i': image_id, 'c': code}) ELSE kept END,
    image_id, hit, code
  FROM (SELECT placed.*, kept,
      list_filter(kept, lambda k: bit_count(xor(k.c, placed.code)) <= 5)[1] AS hit
    FROM walk JOIN placed ON placed.n = walk.n + 1))
SELECT image_id, near.i AS duplicate_of, bit_count(xor(near.c, code))::INT AS distance
FROM walk WHERE n > 0""",
    "codes",
)
check(
    "average_hashes",
    lambda t: t.hashes.select("image_id", F.bit_count("hash").alias("bits"),
                              F.shiftrightunsigned("hash", 1).alias("upper_bits")),
    """SELECT image_id, bit_count(code)::INT AS bits, (code >> 1)::BIGINT AS upper_bits FROM codes""",
    "codes",
)
