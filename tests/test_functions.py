"""Column functions on literal edge rows."""

import pytest
from pyspark.sql import functions as F

from bazaarlens.functions import errors as err
from bazaarlens.functions import images as img
from bazaarlens.functions import scoring as S
from bazaarlens.functions import text as T
from bazaarlens.functions.bands import price_band, quality_band, quality_class


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", column(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_prices(spark):
    rows = ["$1,234.50", "USD 99", "1.234,5", "12,50", "1,234", "", None, "free", "C $45.00", "$,"]
    assert values(spark, T.price_value, rows) == [
        1234.5, 99.0, 1.234, 12.5, 1234.0, 0.0, 0.0, 0.0, 45.0, 0.0
    ]


def test_currency(spark):
    rows = ["C $45", "12 €", "£3", "cad 5", "AUD 7", "9", None]
    assert values(spark, T.currency, rows) == ["USD", "EUR", "GBP", "CAD", "AUD", "USD", "USD"]


def test_titles(spark):
    long = "a" * 501
    out = values(spark, T.clean_title, ["  Gold \t ring ★ (new)", long, "é ß ok"])
    assert out[0] == "Gold ring  (new)"
    assert out[1] == "a" * 497 + "..." and len(out[1]) == 500
    assert out[2] == "é ß ok"


def test_category_modes(spark):
    rows = ["Gold earring", "silver chain", "plain box", "Wedding band"]
    assert values(spark, T.category, rows) == ["rings", "necklaces", "other", "rings"]
    word = values(spark, lambda c: T.category(c, "word"), rows)
    assert word == ["earrings", "necklaces", "other", "rings"]


def test_scored_category_ties(spark):
    rows = ["charm", "vintage tennis cuff bracelet", "nothing", None]
    assert values(spark, T.scored_category, rows) == ["bracelets", "bracelets", "other", "other"]


def test_stones_and_sizes(spark):
    text = ["1.5 ct VVS1 round cut blue diamond, size: 7.5, 18 inches, 5.2g"]
    assert values(spark, T.stone_carat, text) == ["1.5"]
    assert values(spark, T.stone_clarity, text) == ["VVS1"]
    assert values(spark, T.stone_cut, text) == ["round"]
    assert values(spark, T.stone_color, text) == ["blue"]
    assert values(spark, T.primary_gemstone, text) == ["diamond"]
    assert values(spark, T.weight, text) == ["5.2g"]
    assert values(spark, lambda c: T.size_for(c, F.lit("rings")), text) == ["7.5"]
    assert values(spark, lambda c: T.size_for(c, F.lit("necklaces")), text) == ["18"]
    assert values(spark, lambda c: T.size_for(c, F.lit("other")), text) == [None]


def test_conditions_and_cleaning(spark):
    rows = [" For Parts ", "USED", "Odd state", None]
    assert values(spark, T.standard_condition, rows) == [
        "For parts or not working", "Used", "Odd state", None
    ]
    assert values(spark, T.clean_text, ["  Gold   ring See original listing "]) == ["Gold ring"]


def test_urls(spark):
    rows = ["https://a.b/itm/x/123", "https://a.b/itm/77?x", "http://a?item=9", "http://a#5"]
    assert values(spark, T.listing_id, rows) == ["123", "77", "9", "5"]
    assert len(values(spark, T.listing_id, ["http://a/b"])[0]) == 12
    assert values(spark, T.is_url, ["invalid url", "ftp://x", "https://", None, ""]) == [
        False, True, False, False, False
    ]


def test_image_urls(spark):
    rows = [["http://a/b.jpg", "bad.jpg", "http://a/image/1", "http://a/b.txt"]]
    assert values(spark, T.image_urls, rows, "array<string>") == [
        ["http://a/b.jpg", "http://a/image/1"]
    ]
    rows = ["//i.x/s-l64.jpg", "/p/$_12.JPG", "http://o/s-l300.png"]
    assert values(spark, lambda c: T.normal_image_url(c, "https://s"), rows) == [
        "https://i.x/s-l1600.jpg", "https://s/p/$_57.JPG", "http://o/s-l1600.png"
    ]
    html = ['{"originalImg":"http:\\/\\/i\\/s-l64.jpg","mainImgUrl":"http://i/s-l1600.jpg"}']
    assert values(spark, lambda c: T.embedded_image_urls(c, "https://s"), html) == [
        ["http://i/s-l1600.jpg"]
    ]


def test_image_addresses_meet_patterns_last(spark):
    """Only an address with an image's name or size token in it is put to a pattern."""
    rows = [["HTTP://A/B.PNG", "image", "http://image", "://a.gif", None, "", "http:///.jpg", "x://a b.jpg"], None]
    assert values(spark, T.image_urls, rows, "array<string>") == [
        ["HTTP://A/B.PNG", "http://image", "x://a b.jpg"], None]
    rows = ["http://o/s-l5/$_1.JPG", "http://o/$_.JPG", "/s-l", None, ""]
    assert values(spark, lambda c: T.normal_image_url(c, "https://s"), rows) == [
        "http://o/s-l1600/$_57.JPG", "http://o/$_.JPG", "https://s/s-l", None, ""]
    table = spark.createDataFrame([(["a"],)], "u array<string>").select(T.image_urls(F.col("u")))
    plan = table._jdf.queryExecution().analyzed().toString()
    assert "jpg|" not in plan and "|.png" not in plan and plan.index("Contains") < plan.index("RLIKE")


def test_listing_words(spark):
    assert values(spark, T.listing_type, ["Place bid", "buy it now", "best offer", "x"]) == [
        "Auction", "Buy It Now", "Best Offer", "Unknown"
    ]
    assert values(spark, T.listing_status, ["has ended", "Available", "?"]) == [
        "sold", "active", "unknown"
    ]
    assert values(spark, T.item_number, ["Marketplace item number: 42", "#123456789012", "#12"]) == [
        "42", "123456789012", None
    ]


def test_bands(spark):
    prices = [99.99, 100.0, 500.0, 1000.0, 5000.0, None]
    assert values(spark, lambda c: price_band("v"), prices, "double") == [
        "Under $100", "$100-$500", "$500-$1,000", "$1,000-$5,000", "Over $5,000", "Over $5,000"
    ]
    scores = [0.9, 0.7, 0.5, 0.3, 0.29, None]
    assert values(spark, lambda c: quality_class("v"), scores, "double") == [
        "excellent", "good", "fair", "poor", "invalid", "invalid"
    ]
    assert values(spark, lambda c: quality_band("v"), [1.0], "double") == ["Excellent (90-100%)"]


FIELDS = (
    "listing_id string, title string, price double, currency string, condition string, "
    "seller_name string, url string, category string, material string, brand string, "
    "main_stone string, size string, weight string, description string, seller_rating double, "
    "features array<string>, watchers long, image_count long, original_price double"
)


def test_quality_orders_listings_and_gate(spark):
    full = ("1", "Diamond ring", 900.0, "USD", "New", "s", "https://a/itm/1", "rings", "gold", "b",
            "diamond", "7", "5g", "d" * 300, 99.0, ["a", "b"], 3, 5, 1000.0)
    poor = ("2", "Ring", 10.0, "USD", "Unknown", "s", "nowhere", "other", "unknown", None, None,
            None, None, None, None, None, None, 0, 4.0)
    df = spark.createDataFrame([full, poor], FIELDS)
    high, low = S.scored(df).orderBy("listing_id").collect()
    assert high["quality_score"] > 0.6 > low["quality_score"]
    assert high["accepted"] and high["auto_validated"] and not low["accepted"]
    assert low["gate_errors"] == [
        "Data quality score too low",
        "Invalid listing URL format",
        "Current price seems unusually high compared to original price",
    ] or "Invalid listing URL format" in low["gate_errors"]
    assert low["gate_score"] == pytest.approx(1 - len(low["gate_errors"]) / 10)


def test_valuable_values(spark):
    df = spark.createDataFrame(
        [("x", 1.0, ["a"], True), (" N/A ", 0.0, [], False), (None, None, None, None)],
        "t string, n double, l array<string>, b boolean",
    )
    out = df.select(*[S.valuable(df, c).alias(c) for c in ("t", "n", "l", "b", "absent")]).collect()
    assert [tuple(r) for r in out] == [
        (True, True, True, True, False), (False,) * 5, (False,) * 5
    ]
    assert [r[0] for r in df.select(S.filled(df, ["t", "n", "l", "b"])).collect()] == [4, 0, 0]


def test_errors(spark):
    df = spark.createDataFrame(
        [("ConnectionError", "SSL certificate", None), ("X", "page crashed", 200),
         ("MemoryError", "no memory", None), ("X", "ok", 429), ("X", "quiet", None)],
        "k string, m string, s int",
    )
    out = [tuple(r[0]) for r in df.select(err.request_error(F.col("k"), F.col("m"), F.col("s"))).collect()]
    assert out == [("network", "high"), ("browser", "high"), ("system", "critical"),
                   ("rate_limiting", "high"), ("unknown", "medium")]


def test_average_hash(spark):
    cells = [float(i) for i in range(64)]
    got = values(spark, img.average_hash, [cells], "array<double>")[0]
    assert got & ((1 << 64) - 1) == (1 << 32) - 1
