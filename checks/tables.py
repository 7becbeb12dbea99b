"""Test tables as Spark DataFrames and as the equal SQL table expressions."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.functions import errors as err
from bazaarlens.plans import logs
from bazaarlens.plans.reports import ReportRequest, base
from bazaarlens.sources import derived


class Tables:
    """Lazy access to the derived tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return derived.read(self.spark, self.dir, name)

    @cached_property
    def listings(self) -> DataFrame:
        return derived.listings(self.spark, self.dir)

    @cached_property
    def full(self) -> DataFrame:
        """Listings with status and creation time."""
        return derived.listings(self.spark, self.dir, with_orders=True)

    @cached_property
    def base(self) -> DataFrame:
        return base(self.listings, self.request())

    @cached_property
    def dirty(self) -> DataFrame:
        """Listings with every kind of damage the rules look for, by watcher count."""
        return self.listings.withColumns(
            {
                column: F.expr(
                    "CASE watchers "
                    + " ".join(f"WHEN {w} THEN {value}" for w, value in damage.items())
                    + f" ELSE {'NULL' if column == 'seller_email' else column} END"
                )
                for column, damage in DAMAGE.items()
            }
        )

    @cached_property
    def dirty_store(self) -> dict[str, DataFrame]:
        return {**self.store, "listings": self.dirty}

    @cached_property
    def images(self) -> DataFrame:
        return derived.images(self.spark, self.dir)

    @cached_property
    def specifications(self) -> DataFrame:
        return derived.specifications(self.spark, self.dir)

    @cached_property
    def sessions(self) -> DataFrame:
        return derived.sessions(self.spark, self.dir)

    @cached_property
    def requests(self) -> DataFrame:
        return derived.requests(self.spark, self.dir)

    @cached_property
    def errors(self) -> DataFrame:
        return logs.classified(self.requests)

    @cached_property
    def risky(self) -> DataFrame:
        risk = F.when(F.col("success"), 0.0).otherwise(
            err.request_risk(F.col("error_message"), F.col("status_code"))
        )
        return self.requests.withColumn("risk", risk)

    @cached_property
    def hashes(self) -> DataFrame:
        return derived.hashes(self.spark, self.dir)

    @cached_property
    def pages(self) -> DataFrame:
        return derived.pages(self.spark, self.dir)

    @cached_property
    def listing_pages(self) -> DataFrame:
        return derived.listing_pages(self.spark, self.dir)

    @cached_property
    def result_pages(self) -> DataFrame:
        return derived.result_pages(self.spark, self.dir)

    @cached_property
    def store(self) -> dict[str, DataFrame]:
        return {
            "listings": self.listings,
            "images": self.images,
            "specifications": self.specifications,
            "sessions": self.sessions,
        }

    def request(self, **changes) -> ReportRequest:
        return ReportRequest(as_of=derived.AS_OF, **changes)


def tidy(df: DataFrame, digits: int = 4) -> DataFrame:
    """Comparable output: rounded doubles, zone-less times."""
    cols = []
    for name, kind in df.dtypes:
        if kind == "double":
            cols.append(F.round(name, digits).alias(name))
        elif kind == "timestamp":
            cols.append(F.col(name).cast("timestamp_ntz").alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


# Damaged values per column and watcher count, valid in both SQL dialects.
DAMAGE = {
    "title": {
        1: "NULL", 2: "''", 3: "upper(concat(title, ' ', title, ' extra'))",
        4: "concat(title, ' big sale!!! now')", 5: "repeat(concat(title, ' '), 25)",
        33: "concat('  ', title, ' of gold ')",
    },
    "price": {6: "CAST(0 AS DOUBLE)", 7: "-price", 8: "price * 40", 9: "NULL"},
    "currency": {10: "'usd'", 11: "'SEK'", 12: "NULL", 13: "'USDX'"},
    "condition": {14: "NULL"},
    "seller_name": {15: "''"},
    "category": {16: "NULL"},
    "material": {17: "'plastic'", 18: "'leather'", 19: "NULL"},
    "url": {20: "'shop.example.com/itm/1'", 21: "NULL", 22: "'https://'"},
    "data_completeness_score": {23: "CAST(-0.25 AS DOUBLE)", 24: "CAST(1.25 AS DOUBLE)"},
    "image_count": {25: "CAST(-1 AS BIGINT)", 26: "NULL"},
    "description": {27: "repeat(description, 500)", 28: "''", 34: "repeat(description, 9)"},
    "seller_email": {29: "'a@b.co'", 30: "'a@b'", 31: "'bad'", 35: "''"},
    "listing_id": {32: "''"},
}
AS_OF = "TIMESTAMP '2001-11-04 00:00:00'"

_CTES = {
    "listings": """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS listing_id,
  'https://shop.example.com/itm/' || concat_ws('-', l_orderkey, l_linenumber) AS url,
  p_name AS title, p_name || ' ' || lower(p_type) AS description,
  floor(l_extendedprice * 5 * f) / 100 AS price,
  floor(l_extendedprice * 5 * f * (0.98::DOUBLE + l_tax)) / 100 AS original_price,
  'USD' AS currency,
  CASE l_returnflag WHEN 'A' THEN 'used' WHEN 'N' THEN 'new' WHEN 'R' THEN 'seller refurbished' END
    AS condition,
  s_name AS seller_name,
  CASE WHEN s_acctbal >= 0 THEN 80 + s_acctbal / 500 END AS seller_rating,
  CASE split_part(p_name, ' ', -1) WHEN 'ring' THEN 'rings' WHEN 'rod' THEN 'necklaces'
    WHEN 'bolt' THEN 'earrings' WHEN 'gizmo' THEN 'bracelets' WHEN 'gear' THEN 'watches'
    WHEN 'plate' THEN 'brooches' WHEN 'widget' THEN 'pendants' WHEN 'anvil' THEN 'other' END
    AS category,
  lower(p_type) AS material,
  CASE WHEN p_size % 7 <> 0 THEN p_brand END AS brand,
  CASE l_partkey % 5 WHEN 0 THEN 'diamond' WHEN 1 THEN 'ruby' WHEN 2 THEN '' WHEN 3 THEN 'pearl'
    END AS main_stone,
  floor(l_quantity)::BIGINT AS watchers, p_size::BIGINT * 10 AS views,
  CASE WHEN l_linenumber <= 5 THEN l_linenumber::BIGINT END AS bids,
  (p_size % 8)::BIGINT AS image_count,
  l_discount * 10 AS data_completeness_score,
  l_linestatus = 'F' AS is_validated,
  l_shipdate AS scraped_at,
  CASE o_orderstatus WHEN 'F' THEN 'sold' WHEN 'O' THEN 'active' WHEN 'P' THEN 'ended' END
    AS listing_status,
  o_orderdate AS created_at
FROM (SELECT *, CASE WHEN l_partkey % 499 = 0 THEN 20.0::DOUBLE ELSE 1.0::DOUBLE END AS f
      FROM lineitem) l
LEFT JOIN part ON l_partkey = p_partkey
LEFT JOIN supplier ON l_suppkey = s_suppkey
LEFT JOIN orders ON l_orderkey = o_orderkey""",
    "base": "SELECT * FROM listings WHERE is_validated",
    "images": """
SELECT listing_id || '#' || i AS image_id,
  CASE WHEN bids = 5 AND i = 1 THEN listing_id || '-gone' ELSE listing_id END AS listing_id,
  'https://shop.example.com/img/' || listing_id || '/' || i || '.jpg' AS original_url,
  i::BIGINT AS sequence_order, i = 1 AS is_primary,
  ((watchers * 7 + views + i * 13) % 101) / 100 AS quality_score,
  watchers * 1000 + i * 37 AS file_size,
  100 + (watchers * 37 + i * 101) % 1500 AS width,
  40 + (views * 13 + i * 57) % 1500 AS height,
  (watchers * 1000 + i * 37) % 256 AS gray_mean,
  (watchers * 1000 + i * 37) % 97 AS gray_stddev,
  ['JPEG', 'PNG', 'WEBP', 'SVG'][i % 4 + 1] AS format,
  ['RGB', 'L', 'CMYK'][i % 3 + 1] AS color_mode,
  i % 3 = 0 AS is_processed, i % 7 = 0 AS is_duplicate, i % 5 = 0 AS contains_text,
  created_at
FROM (SELECT *, unnest(range(1, image_count + 1)) AS i FROM listings)""",
    "specifications": """
SELECT listing_id || '#' || name AS spec_id, listing_id, name AS attribute_name,
  val AS attribute_value
FROM (SELECT listing_id, 'brand' AS name, brand AS val FROM listings
      UNION ALL SELECT listing_id, 'material', material FROM listings
      UNION ALL SELECT listing_id, 'main_stone', main_stone FROM listings)
WHERE val <> ''""",
    "sessions": """
SELECT strftime(m, '%Y-%m') AS session_id,
  CASE WHEN m >= TIMESTAMP '2001-07-01' THEN 'running' ELSE 'completed' END AS status,
  m AS started_at,
  CASE WHEN m < TIMESTAMP '2001-07-01' THEN m + INTERVAL 20 DAY END AS completed_at,
  found AS listings_found, scraped AS listings_scraped, failed AS listings_failed,
  found * 3 AS images_downloaded, failed AS images_failed,
  found + 10 AS requests_made, scraped AS requests_successful,
  scraped * 100.0::DOUBLE / found AS progress_percentage,
  scraped::DOUBLE / found AS average_quality_score
FROM (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS m, count(*) AS found,
        count(*) FILTER (o_orderstatus = 'F') AS scraped,
        count(*) FILTER (o_orderstatus = 'P') AS failed
      FROM orders GROUP BY 1)""",
    "requests": """
SELECT event_id AS request_id, 's' || user_id AS session_id, event_type AS operation,
  'https://shop.example.com/p/' || k AS url, ts AS timestamp, value AS response_time,
  event_type <> 'error' AS success,
  CASE WHEN event_type = 'error' THEN
    ['TimeoutError', 'ValueError', 'OSError', 'HTTPError'][k % 4 + 1] END AS error_type,
  CASE WHEN event_type = 'error' THEN
    ['connection reset by peer', '429 too many requests', 'captcha page shown',
     'malformed json body', 'missing required value', 'login token expired',
     'memory limit reached', 'unhandled'][k % 8 + 1] END AS error_message,
  CASE WHEN event_type = 'error' THEN [403, 404, 429, 500, 200][k % 5 + 1] ELSE 200 END
    AS status_code,
  k % 6 AS retry_count
FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events)""",
    "errors": """
SELECT *, CASE category WHEN 'resource' THEN 'high' WHEN 'authentication' THEN 'high'
    WHEN 'bot_detection' THEN 'medium' WHEN 'rate_limit' THEN 'medium'
    WHEN 'network' THEN CASE WHEN retry_count > 3 THEN 'medium' ELSE 'low' END
    ELSE 'low' END AS severity
FROM (SELECT *, CASE WHEN error_type = 'TimeoutError' THEN 'network'
      ELSE CASE error_message WHEN 'connection reset by peer' THEN 'network'
      WHEN '429 too many requests' THEN 'rate_limit' WHEN 'captcha page shown' THEN 'bot_detection'
      WHEN 'malformed json body' THEN 'parsing' WHEN 'missing required value' THEN 'validation'
      WHEN 'login token expired' THEN 'authentication' WHEN 'memory limit reached' THEN 'resource'
      ELSE CASE WHEN error_type = 'OSError' THEN 'system' ELSE 'unknown' END END END AS category
      FROM requests WHERE NOT success)""",
    "risky": """
SELECT *, CASE WHEN success THEN 0.0::DOUBLE
    WHEN error_message = 'captcha page shown' THEN 0.8 WHEN contains(error_message, '429') THEN 0.4
    WHEN status_code IN (403, 429) THEN 0.3 ELSE 0.0 END AS risk
FROM requests""",
    "codes": """
SELECT image_id, CASE WHEN image_id >= 1000000 THEN
    xor(code, ((1::UBIGINT << (image_id % 1000000 % 8)::INT) - 1)::UBIGINT) ELSE code END AS code
FROM (SELECT unnest([vec_id, vec_id + 1000000]) AS image_id, code
      FROM (SELECT vec_id, list_reduce(list_transform(embedding,
              lambda x: CASE WHEN x::DOUBLE > m THEN 1::UBIGINT ELSE 0::UBIGINT END),
              lambda a, b: (a << 1) | b) AS code
            FROM (SELECT *, list_reduce(list_transform(embedding, lambda x: x::DOUBLE), lambda a, b: a + b)
                    / 64 AS m FROM embeddings)))""",
}
_CTES["dirty"] = (
    "SELECT * EXCLUDE ("
    + ", ".join(c for c in DAMAGE if c != "seller_email")
    + "), "
    + ", ".join(
        "CASE watchers "
        + " ".join(f"WHEN {w} THEN {value}" for w, value in damage.items())
        + f" ELSE {'NULL' if column == 'seller_email' else column} END AS {column}"
        for column, damage in DAMAGE.items()
    )
    + " FROM listings"
)
_NEEDS = {
    "dirty": ["listings"],
    "listings": [],
    "base": ["listings"],
    "images": ["listings"],
    "specifications": ["listings"],
    "sessions": [],
    "requests": [],
    "errors": ["requests"],
    "risky": ["requests"],
    "codes": [],
}


def sql(body: str, *tables: str) -> str:
    """A query text with the table expressions it names put in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS[name]:
            add(need)
        if name not in order:
            order.append(name)

    for name in tables:
        add(name)
    if not order:
        return body.strip()
    head = ",\n".join(f"{n} AS ({_CTES[n].strip()})" for n in order)
    text = body.strip()
    if text.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{text[15:]}"
    if text.upper().startswith("WITH "):
        return f"WITH {head},\n{text[5:]}"
    return f"WITH {head}\n{text}"
