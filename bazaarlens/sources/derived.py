"""Listing tables derived from the star-schema test tables (see FIXTURES.md)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = datetime(2001, 11, 4)
EVENTS_AS_OF = datetime(2024, 1, 31)
SITE = "https://shop.example.com"

_CATEGORY_OF_NOUN = {
    "ring": "rings",
    "rod": "necklaces",
    "bolt": "earrings",
    "gizmo": "bracelets",
    "gear": "watches",
    "plate": "brooches",
    "widget": "pendants",
    "anvil": "other",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan a test table; zone-less times become session-zone timestamps."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    times = {n: F.col(n).cast("timestamp") for n, t in df.dtypes if t == "timestamp_ntz"}
    return df.withColumns(times) if times else df


def _lookup(column, mapping: dict[str, str]):
    result = None
    for key, value in mapping.items():
        result = (
            F.when(column == key, value) if result is None else result.when(column == key, value)
        )
    return result


def listings(spark: SparkSession, sf_dir: str, with_orders: bool = False) -> DataFrame:
    """One listing per order line.

    The keys of part, supplier and orders are unique, so left joins keep every
    line exactly once; the orders join (status, creation time) is added on request.
    """
    line = read(spark, sf_dir, "lineitem")
    part = read(spark, sf_dir, "part").drop("p_retailprice")
    supplier = read(spark, sf_dir, "supplier").drop("s_nationkey")
    joined = line.join(part, line.l_partkey == part.p_partkey, "left").join(
        supplier, line.l_suppkey == supplier.s_suppkey, "left"
    )
    cols = {
        "listing_id": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        "url": F.concat(F.lit(f"{SITE}/itm/"), F.concat_ws("-", "l_orderkey", "l_linenumber")),
        "title": F.col("p_name"),
        "description": F.concat_ws(" ", F.col("p_name"), F.lower("p_type")),
    }
    outlier = F.when(F.col("l_partkey") % 499 == 0, 20.0).otherwise(1.0)
    cents5 = F.col("l_extendedprice") * 5 * outlier
    cols |= {
        "price": F.floor(cents5).cast("double") / 100,
        "original_price": F.floor(cents5 * (F.lit(0.98) + F.col("l_tax"))).cast("double") / 100,
        "currency": F.lit("USD"),
        "condition": _lookup(
            F.col("l_returnflag"), {"A": "used", "N": "new", "R": "seller refurbished"}
        ),
        "seller_name": F.col("s_name"),
        "seller_rating": F.when(F.col("s_acctbal") >= 0, 80 + F.col("s_acctbal") / 500),
        "category": F.element_at(
            F.create_map(*[F.lit(x) for pair in _CATEGORY_OF_NOUN.items() for x in pair]),
            F.substring_index("p_name", " ", -1),
        ),
        "material": F.lower("p_type"),
        "brand": F.when(F.col("p_size") % 7 != 0, F.col("p_brand")),
        "main_stone": _lookup(
            (F.col("l_partkey") % 5).cast("string"),
            {"0": "diamond", "1": "ruby", "2": "", "3": "pearl"},
        ),
        "watchers": F.col("l_quantity").cast("long"),
        "views": F.col("p_size").cast("long") * 10,
        "bids": F.when(F.col("l_linenumber") <= 5, F.col("l_linenumber")).cast("long"),
        "image_count": (F.col("p_size") % 8).cast("long"),
        "data_completeness_score": F.col("l_discount") * 10,
        "is_validated": F.col("l_linestatus") == "F",
        "scraped_at": F.col("l_shipdate"),
    }
    if with_orders:
        orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
        joined = joined.join(orders, joined.l_orderkey == orders.o_orderkey, "left")
        cols |= {
            "listing_status": _lookup(
                F.col("o_orderstatus"), {"F": "sold", "O": "active", "P": "ended"}
            ),
            "created_at": F.col("o_orderdate"),
        }
    return joined.select(*[c.alias(n) for n, c in cols.items()])


def images(spark: SparkSession, sf_dir: str, with_orders: bool = False) -> DataFrame:
    """``image_count`` image rows per listing; some point at a missing listing."""
    base = listings(spark, sf_dir, with_orders).where("image_count > 0")
    extra = ["created_at"] if with_orders else []
    rows = base.select(
        "listing_id",
        "watchers",
        "views",
        "bids",
        *extra,
        F.explode(F.sequence(F.lit(1), F.col("image_count").cast("int"))).alias("i"),
    )
    i = F.col("i")
    size = F.col("watchers") * 1000 + i * 37
    return rows.select(
        F.concat_ws("#", "listing_id", "i").alias("image_id"),
        F.when(
            (F.col("bids") == 5) & (i == 1), F.concat(F.col("listing_id"), F.lit("-gone"))
        )
        .otherwise(F.col("listing_id"))
        .alias("listing_id"),
        F.concat(
            F.lit(f"{SITE}/img/"), F.col("listing_id"), F.lit("/"), i.cast("string"), F.lit(".jpg")
        ).alias("original_url"),
        i.cast("long").alias("sequence_order"),
        (i == 1).alias("is_primary"),
        (((F.col("watchers") * 7 + F.col("views") + i * 13) % 101) / 100).alias("quality_score"),
        size.alias("file_size"),
        (100 + (F.col("watchers") * 37 + i * 101) % 1500).alias("width"),
        (40 + (F.col("views") * 13 + i * 57) % 1500).alias("height"),
        (size % 256).alias("gray_mean"),
        (size % 97).alias("gray_stddev"),
        F.element_at(F.array(*map(F.lit, ["JPEG", "PNG", "WEBP", "SVG"])), (i % 4 + 1).cast("int"))
        .alias("format"),
        F.element_at(F.array(*map(F.lit, ["RGB", "L", "CMYK"])), (i % 3 + 1).cast("int"))
        .alias("color_mode"),
        (i % 3 == 0).alias("is_processed"),
        (i % 7 == 0).alias("is_duplicate"),
        (i % 5 == 0).alias("contains_text"),
        *extra,
    )


def specifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form attributes of each listing; empty values leave no row."""
    names = ["brand", "material", "main_stone"]
    return (
        listings(spark, sf_dir)
        .select("listing_id", *names)
        .unpivot("listing_id", names, "attribute_name", "attribute_value")
        .where("attribute_value <> ''")
        .select(
            F.concat_ws("#", "listing_id", "attribute_name").alias("spec_id"),
            "listing_id",
            "attribute_name",
            "attribute_value",
        )
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One collection session per calendar month of order dates."""
    month = F.date_trunc("month", "o_orderdate")
    found, scraped = F.col("listings_found"), F.col("listings_scraped")
    grouped = (
        read(spark, sf_dir, "orders")
        .groupBy(month.alias("started_at"))
        .agg(
            F.count("*").alias("listings_found"),
            F.count_if(F.col("o_orderstatus") == "F").alias("listings_scraped"),
            F.count_if(F.col("o_orderstatus") == "P").alias("listings_failed"),
        )
    )
    still_open = F.col("started_at") >= F.lit("2001-07-01").cast("timestamp")
    return grouped.select(
        F.date_format("started_at", "yyyy-MM").alias("session_id"),
        F.when(still_open, "running").otherwise("completed").alias("status"),
        "started_at",
        F.when(~still_open, F.col("started_at") + F.expr("interval 20 days")).alias("completed_at"),
        found,
        scraped,
        F.col("listings_failed"),
        (found * 3).alias("images_downloaded"),
        F.col("listings_failed").alias("images_failed"),
        (found + 10).alias("requests_made"),
        scraped.alias("requests_successful"),
        F.try_divide(scraped * F.lit(100.0), found).alias("progress_percentage"),
        (scraped / found).alias("average_quality_score"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request log: one row per event, errors marked by the event type."""
    return read(spark, sf_dir, "events").select(*request_columns())


def request_columns():
    """Projection from the events table (batch or stream) to the request log."""
    error = F.col("event_type") == "error"
    key = F.get_json_object("props", "$.k").cast("long")
    return [
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
        F.col("event_type").alias("operation"),
        F.concat(F.lit(f"{SITE}/p/"), key.cast("string")).alias("url"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("value").alias("response_time"),
        (~error).alias("success"),
        F.when(
            error,
            F.element_at(
                F.array(*map(F.lit, ["TimeoutError", "ValueError", "OSError", "HTTPError"])),
                (key % 4 + 1).cast("int"),
            ),
        ).alias("error_type"),
        F.when(
            error,
            F.element_at(
                F.array(*map(F.lit, ERROR_MESSAGES)),
                (key % len(ERROR_MESSAGES) + 1).cast("int"),
            ),
        ).alias("error_message"),
        F.when(error, F.element_at(F.array(*map(F.lit, [403, 404, 429, 500, 200])),
                                   (key % 5 + 1).cast("int")))
        .otherwise(F.lit(200)).cast("long").alias("status_code"),
        (key % 6).alias("retry_count"),
    ]


# Messages that spread the derived error rows over every error class.
ERROR_MESSAGES = [
    "connection reset by peer",
    "429 too many requests",
    "captcha page shown",
    "malformed json body",
    "missing required value",
    "login token expired",
    "memory limit reached",
    "unhandled",
]


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average hashes of the test vectors plus a slightly flipped copy of each."""
    from bazaarlens.functions.images import average_hash

    base = read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"), average_hash(F.col("embedding")).alias("hash")
    )
    flips = F.expr("shiftleft(1L, CAST(image_id % 8 AS INT)) - 1")
    copies = base.select(
        (F.col("image_id") + 1_000_000).alias("image_id"),
        F.col("hash").bitwiseXOR(flips).alias("hash"),
    )
    return base.unionByName(copies)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages")


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings rendered as marketplace pages, the input of the ingest job.

    Fields hold nested elements and character references. Pages of 7 watchers have no price,
    those of 13 no title, those of 9 no seller.
    """
    # landed pages come in many files; the small test tables would give one or two partitions
    # (by value, since dealing rows out in turn sorts them first)
    base = listings(spark, sf_dir).repartition(4 * spark.sparkContext.defaultParallelism, "url", "title", "price")
    noise = F.coalesce("brand", F.lit("plain"))
    title = F.concat(
        F.lit('<h1 id="it-ttl">\n  '), F.initcap("title"), F.lit(" <b>&amp;</b> "), noise,
        F.lit(" <i>&eacute;&#36;&#x42;</i></h1>"),
    )
    price = F.concat(
        F.lit('<span class="amt notranslate"><span class="cur">US</span> <b>$'),
        F.format_number("price", 2), F.lit("</b></span>"),
    )
    html = F.concat(
        F.lit('<html><head><title>Shop</title><script>if (a < b) { x = {"originalImg":'
              '"https:\\/\\/img.example.com\\/big\\/s-l64.jpg"}; }</script></head><body>\n'),
        F.when(F.col("watchers") == 13, "").otherwise(title),
        F.lit('<div class="box">'),
        F.when(F.col("watchers") == 7, '<span class="amt notranslate">see cart</span>')
        .otherwise(price),
        F.lit('<div data-class="condText"></div><div class="u-flL condText"><div> '),
        F.initcap("condition"),
        F.lit("</div>\n</div></div>"),
        F.when(F.col("watchers") == 9, "").otherwise(
            F.concat(F.lit('<span class="mbg-nw"><span>'), "seller_name", F.lit("</span></span>"))
        ),
        F.lit('<img id="icImg" data-src="/no" src="https://img.example.com/main/s-l500.jpg">'),
        F.array_join(
            F.transform(
                F.sequence(F.lit(0), F.col("image_count").cast("int")),
                lambda i: F.concat(
                    F.when(i % 2 == 0, '<img class="tdThumb" src="https://img.example.com/')
                    .otherwise('<img data-src="https://img.example.com/'),
                    i.cast("string"),
                    F.when(i % 2 == 0, '/s-l64.jpg">').otherwise('/s-l64.jpg" class="x tdThumb">'),
                ),
            ),
            "",
        ),
        F.lit('<div class="itemAttr"><table><tr><td>Material</td><td>'),
        "material",
        F.lit("</td></tr><tr><td>Stone</td><td>"),
        F.coalesce("main_stone", F.lit("")),
        F.lit("</td></tr></table></div></body></html>"),
    )
    return base.select(F.col("listing_id").alias("page_id"), "url", html.alias("html"))


def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result page per listing with three cards: priced, without a price, without a title."""
    card = '<li class="s-item s-item--big"><div class="s-item__wrap"><div>'
    html = F.concat(
        F.lit(f'<ul><li class="nav">x</li>{card}<img data-src="https://img.example.com/c.jpg"></div>'
              '<h3 class="s-item__title"><a href="/itm/'),
        "listing_id",
        F.lit('?a=1"><span>New</span> '), "title",
        F.lit('</a></h3><span class="s-item__price"><span>$</span>'),
        F.format_number("price", 2),
        F.lit('</span><div class="s-item__subtitle"><div>Pre-<b>Owned</b></div> lot</div></div></li>'
              f'{card}</div><a href="https://other.example.com/'),
        F.col("watchers").cast("string"),
        F.lit('"><div class="s-item__title">'), "material",
        F.lit(f' &lt;set&gt;</div></a></div></li>{card}<a href="/itm/none">no title</a></div></div></li></ul>'),
    )
    rows = listings(spark, sf_dir).repartition(4 * spark.sparkContext.defaultParallelism)
    return rows.select(F.col("listing_id").alias("page_id"), "url", html.alias("html"))
