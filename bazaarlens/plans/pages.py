"""Listing fields, images, links, cards and specification rows out of landed pages.

Each page is cut into tags and text once (``functions.html``); fallback rules are tried in order
until one yields a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions import html as H
from bazaarlens.functions import text
from bazaarlens.functions.html import Element
from bazaarlens.functions.reader import read_cards, read_cells, read_fields, read_images

# Page elements of each field, tried in order.
TITLE = [
    Element(("h1",), "id", "it-ttl"),
    Element(("h1",), "class", "x-item-title-label"),
    Element((), "class", "x-item-title-label"),
    Element(("h1",), "class", "notranslate"),
]
PRICE = [
    Element((), "class", "notranslate"),
    Element((), "id", "mm-saleDscPrc"),
    Element((), "class", "cc-ts-BOLD"),
]
CONDITION = [Element((), "class", "condText")]
SELLER = [Element((), "class", "mbg-nw"), Element((), "class", "seller-name")]
CARD = Element(("div", "li"), "class", "s-item")
CARD_TITLE = [Element((), "class", "s-item__title"), Element((), "class", "it-ttl")]
CARD_PRICE = [Element((), "class", "s-item__price"), Element((), "class", "notranslate")]
CARD_CONDITION = [
    Element((), "class", "SECONDARY_INFO"),
    Element((), "class", "s-item__condition"),
    Element((), "class", "s-item__subtitle"),
]
THUMBNAIL = Element(("img",), "class", "tdThumb")
MAIN_IMAGE = [Element(("img",), "id", "icImg"), Element(("img",), "class", "zoom_trigger")]
SPECIFICS = Element((), "class", "itemAttr")
LIST_ITEM, FEATURE = Element(("li",)), Element(("div",), "class", "feature")
HREF = r"(?is)<a\b[^>]*?(?<![\w-])href\s*=\s*[\"']([^\"']*)[\"']"


def first_price(own: Column, elements: list[Element]) -> Column:
    """Price of the first element whose text holds a number."""
    def price(element: Element) -> Column:
        read = text.plain_price(H.first_text(own, [element]))
        return F.get(F.filter(F.array(read), lambda p: p > 0), F.lit(0))

    return F.coalesce(*map(price, elements), F.lit(0.0))


def computed_once(df: DataFrame, keep: list[str], columns: list[Column]) -> DataFrame:
    """Add columns behind a generator, so that later filters do not recompute them."""
    return df.select(*keep, F.inline(F.array(F.struct(*columns))))


def parsed(pages: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the tokens ``own`` of every page."""
    return computed_once(pages, keep, [H.tokens(F.col("html")).alias("own")])


def page_fields(pages: DataFrame) -> DataFrame:
    """Language, titles, heading, text length and link count of any page."""
    own, raw = F.col("own"), F.col("html")
    return parsed(pages, ["page_id", "url", "html"]).select(
        "page_id",
        "url",
        H.attribute(F.get(H.all_tags(own, Element(("html",))), F.lit(0)), "lang").alias("lang"),
        H.first_text(own, [Element(("title",))]).alias("title"),
        H.first_text(own, [Element(("h1",))]).alias("heading"),
        F.length(text.visible_text(raw)).alias("text_length"),
        F.length(raw).alias("html_length"),
        F.regexp_count(raw, F.lit(HREF)).alias("links"),
    )


def image_address(tag: Column) -> Column:
    return F.coalesce(H.attribute(tag, "src"), H.attribute(tag, "data-src"))


def image_list(own: Column, html: Column, site: str, host: str = "") -> Column:
    """Main image, then thumbnails, then addresses in embedded page data, each once."""
    tags = F.concat(
        *[F.slice(H.all_tags(own, e), 1, 1) for e in MAIN_IMAGE], H.all_tags(own, THUMBNAIL)
    )
    shown = F.array_compact(F.transform(tags, image_address))
    large = F.transform(shown, lambda u: text.normal_image_url(u, site, host))
    return F.array_distinct(F.concat(large, text.embedded_image_urls(html, site, host)))


def page_images(pages: DataFrame, site: str, host: str = "") -> DataFrame:
    """One row per image of a listing page, in order."""
    return read_images(pages, ["page_id"], MAIN_IMAGE, THUMBNAIL, site, host)


def page_features(pages: DataFrame) -> DataFrame:
    """One row per feature of a page: list items, feature blocks and bullets of its text, each
    text of more than 10 characters once, in this order."""
    own = F.col("own")
    blocks = F.concat(H.all_texts(own, LIST_ITEM), H.all_texts(own, FEATURE))
    found = text.features(blocks, text.visible_text(F.col("html")))
    return parsed(pages, ["page_id", "html"]).select(
        "page_id", F.posexplode(found).alias("position", "feature")
    )


def extract_listings(
    pages: DataFrame, keep_incomplete: bool = False, site: str = "", host: str = ""
) -> DataFrame:
    """One listing per page; pages without title or price are dropped unless kept.

    The time ``seen_at`` of a page, where it has one, goes with its listing.
    """
    seen = [c for c in pages.columns if c == "seen_at"]
    read = read_fields(
        pages, ["page_id", "url", *seen], TITLE, PRICE, CONDITION, SELLER, MAIN_IMAGE, THUMBNAIL, site, host
    ).withColumn("seller_name", F.coalesce("seller_name", F.lit("unknown")))
    if not keep_incomplete:
        read = read.where("title IS NOT NULL AND price > 0")
    return read.select(
        text.page_listing_id(F.col("url")).alias("listing_id"),
        "page_id",
        "url",
        "title",
        "price",
        F.coalesce(text.standard_condition(F.col("condition")), F.lit("Unknown")).alias("condition"),
        "seller_name",
        "image_urls",
        "html_length",
        F.lit("USD").alias("currency"),
        F.coalesce(text.page_category(F.col("title")), F.lit("other")).alias("category"),
        F.coalesce(text.page_material(F.col("title")), F.lit("unknown")).alias("material"),
        F.size("image_urls").cast("long").alias("image_count"),
        F.get("image_urls", F.lit(0)).alias("main_image_path"),
        *seen,
    )


def page_links(
    pages: DataFrame, site: str, marker: str = "itm", item: str = r"/itm/([^/?]+)"
) -> DataFrame:
    """Absolute item links of each result page, first sighting per item, in order.

    Work stays inside the page row: links are sorted by item to find repeats,
    then put back in page order.
    """
    hrefs = F.regexp_extract_all("html", F.lit(HREF), F.lit(1))
    absolute = F.transform(
        hrefs,
        lambda h: F.when(F.startswith(h, F.lit("http")), h).when(
            F.startswith(h, F.lit("/")), F.concat(F.lit(site), h)
        ),
    )
    numbered = F.transform(
        absolute,
        lambda u, i: F.struct(
            F.nullif(F.regexp_extract(u, item, 1), F.lit("")).alias("item_id"),
            i.alias("pos"),
            u.alias("link"),
        ),
    )
    wanted = F.filter(
        numbered, lambda s: F.contains(s["link"], F.lit(marker)) & s["item_id"].isNotNull()
    )
    by_item = pages.select("page_id", F.array_sort(wanted).alias("_sorted"))
    firsts = by_item.select(
        "page_id",
        F.filter(
            "_sorted",
            lambda s, i: (i == 0)
            | (s["item_id"] != F.get(F.col("_sorted"), i - 1)["item_id"]),
        ).alias("_firsts"),
    )
    ordered = F.array_sort(
        F.transform("_firsts", lambda s: F.struct(s["pos"].alias("pos"), s["item_id"], s["link"]))
    )
    return firsts.select("page_id", F.posexplode(ordered).alias("position", "_l")).select(
        "page_id", "position", F.col("_l.item_id").alias("item_id"), F.col("_l.link").alias("link")
    )


def result_cards(pages: DataFrame, site: str) -> DataFrame:
    """One listing per card of a result page; cards without a title are dropped."""
    keep = ["page_id", "source_page", "position"]
    read = read_cards(
        pages.withColumn("source_page", F.col("url")), keep[:2], CARD, CARD_TITLE, CARD_PRICE, CARD_CONDITION
    )
    return read.select(
        *keep,
        "title",
        "price",
        F.when(F.startswith("href", F.lit("http")), F.col("href"))
        .otherwise(F.concat(F.lit(site), "href"))
        .alias("url"),
        F.coalesce("condition", F.lit("Unknown")).alias("condition"),
        "image_url",
        text.category(F.col("title")).alias("category"),
        text.page_material(F.col("title")).alias("material"),
    )


def specification_rows(pages: DataFrame, confidence: float = 0.9) -> DataFrame:
    """Name and value of every two-cell row in the specifics section."""
    return (
        read_cells(pages, ["url"], SPECIFICS)
        .select(
            text.page_listing_id(F.col("url")).alias("listing_id"),
            "position",
            text.clean_text(F.col("name")).alias("attribute_name"),
            text.clean_text(F.col("value")).alias("attribute_value"),
        )
        .where("attribute_name <> '' AND attribute_value <> ''")
        .select(
            F.concat_ws("#", "listing_id", "position").alias("spec_id"),
            "listing_id",
            "attribute_name",
            "attribute_value",
            F.lit(confidence).alias("confidence_score"),
        )
    )
