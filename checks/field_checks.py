"""Filter fields over columns that the derived listings lack, and a rule of a user's own."""

from pyspark.sql import functions as F

from bazaarlens.operators.filters import ListingFilter, apply_filter
from bazaarlens.plans import rules as U
from bazaarlens.sources.derived import datetime
from checks.catalog import check

# Columns made of the derived ones; the conditions below say what each filter must keep.
_WIDE = {
    "listing_id": "concat('w', watchers)",
    "validation_score": "watchers / 50",
    "price_drop": "original_price - price",
    "updated_at": "scraped_at + interval 5 days",
    "listing_date": "scraped_at - interval 5 days",
    "watchers": "nullif(watchers % 4, 0)",
    "seller_feedback_count": "views",
    "seller_level": "CASE watchers % 3 WHEN 0 THEN 'top' WHEN 1 THEN 'power' END",
    "main_image_path": "CASE watchers % 3 WHEN 0 THEN 'a.jpg' WHEN 1 THEN '' END",
    "features": "CASE watchers % 3 WHEN 0 THEN array('x') WHEN 1 THEN array() END",
    "specifications": "CASE watchers % 3 WHEN 0 THEN map('a', 'b') END",
    "stone_color": "CASE watchers % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'blue' END",
    "stone_clarity": "CASE watchers % 3 WHEN 0 THEN 'VS1' WHEN 1 THEN 'IF' END",
    "stone_cut": "CASE watchers % 3 WHEN 0 THEN 'round' WHEN 1 THEN 'oval' END",
    "size": "CASE watchers % 3 WHEN 0 THEN '7' WHEN 1 THEN '8' END",
    "era": "CASE watchers % 3 WHEN 0 THEN 'art deco' WHEN 1 THEN 'modern' END",
    "designer": "CASE watchers % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' END",
    "collection": "CASE watchers % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' END",
    "ships_from": "CASE watchers % 3 WHEN 0 THEN 'DE' WHEN 1 THEN 'FR' END",
    "international_shipping": "CASE watchers % 3 WHEN 0 THEN true WHEN 1 THEN false END",
    "expedited_shipping": "CASE watchers % 3 WHEN 0 THEN true WHEN 1 THEN false END",
    "best_offer": "CASE watchers % 3 WHEN 0 THEN true WHEN 1 THEN false END",
    "has_video": "CASE watchers % 3 WHEN 0 THEN true WHEN 1 THEN false END",
    "shipping_cost": "CASE watchers % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 5.0 END",
    "listing_type": "CASE watchers % 3 WHEN 0 THEN 'Auction' WHEN 1 THEN 'Buy It Now' END",
}
_ZERO, _ONE, _NOT_ZERO = "watchers % 3 = 0", "watchers % 3 = 1", "watchers % 3 <> 0"
_FIELDS = [
    ("listing_ids", ["w3", "w5"], "watchers IN (3, 5)"),
    ("min_validation_score", 0.5, "watchers >= 25"),
    ("price_drop_min", 10.0, "original_price - price >= 10"),
    ("updated_after", datetime(2000, 1, 1), "scraped_at >= TIMESTAMP '1999-12-27'"),
    ("updated_before", datetime(2000, 1, 1), "scraped_at <= TIMESTAMP '1999-12-27'"),
    ("listing_date_after", datetime(2000, 1, 1), "scraped_at >= TIMESTAMP '2000-01-06'"),
    ("listing_date_before", datetime(2000, 1, 1), "scraped_at <= TIMESTAMP '2000-01-06'"),
    ("has_watchers", True, "watchers % 4 <> 0"),
    ("min_feedback_count", 300, "views >= 300"),
    ("seller_level", ["top"], _ZERO),
    ("has_main_image", True, _ZERO),
    ("has_features", False, _NOT_ZERO),
    ("has_specifications", True, _ZERO),
    ("stone_color", ["red", "green"], _ZERO),
    ("stone_clarity", "IF", _ONE),
    ("stone_cut", "oval", _ONE),
    ("size", "7", _ZERO),
    ("era", ["modern", "art deco"], "watchers % 3 < 2"),
    ("designer", "y", _ONE),
    ("collection", "x", _ZERO),
    ("ships_from", ["FR"], _ONE),
    ("international_shipping", True, _ZERO),
    ("expedited_shipping", False, _NOT_ZERO),
    ("best_offer_available", True, _ZERO),
    ("has_video", False, _NOT_ZERO),
    ("free_shipping", True, _ZERO),
    ("auction_format", True, _ZERO),
    ("buy_it_now_format", True, _ONE),
]


def _wide(t):
    rows = t.listings.withColumn("_key", F.col("listing_id"))
    return rows.select("*", *[F.expr(e).alias(f"_{n}") for n, e in _WIDE.items()]).select(
        "_key", *[c for c in t.listings.columns if c not in _WIDE],
        *[F.col(f"_{n}").alias(n) for n in _WIDE],
    )


for _name, _value, _condition in _FIELDS:
    check(
        f"field_{_name}",
        lambda t, kept={_name: _value}: apply_filter(_wide(t), ListingFilter(**kept)).select(
            F.col("_key").alias("listing_id"), "views"),
        f"SELECT listing_id, views FROM listings WHERE {_condition}",
        "listings",
    )


def _own_rule(t):
    cheap = U.TableRule(
        "cheap", "basic",
        lambda tables: U._finding(
            tables["listings"].where("price < 100"), "cheap", "info", "custom", "listings", "price",
            "listing_id", F.lit("cheap"), F.col("price")))
    return U.validate({"listings": t.listings}, "basic", [cheap]).where("rule_id = 'cheap'").select(
        "record_id", "severity", "message")


check("user_rule", _own_rule,
      """SELECT listing_id AS record_id, 'info' AS severity, 'cheap' AS message FROM listings
  WHERE price < 100""", "listings")
