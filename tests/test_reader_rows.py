"""Images, cards and cells of the one-pass reader agree with the column expressions they stand for."""

import random

from pyspark.sql import functions as F

from bazaarlens.functions import html as H
from bazaarlens.functions import text
from bazaarlens.functions.html import Element
from bazaarlens.plans import pages as P
from bazaarlens.sources import derived
from tests.test_reader import PARTS, rows

MORE = [
    '<li class="s-item">', '<div class="x s-item s-item">', "</li>", '<h3 class="s-item__title">', "</h3>",
    '<span class="s-item__price">', '<div class="SECONDARY_INFO">', '<a href="/itm/1">', '<a HREF=\'http://o/2\' >',
    '<a>', '<img data-src="/c.jpg">', '<table class="itemAttr">', "</table>", "<tr><td>Name&amp;<b>x</b></td> <th>v\n1</th></tr>",
    "<TR ><td></td><td>See original listing</td></TR>", "<tr><td>a</td>", "<td>&lt;b&gt;\xa0</td></tr>", "<i/>",
]


def cards(pages, site):
    """``result_cards`` as column expressions."""
    own, keep = F.col("own"), ["page_id", "source_page", "position"]
    found = P.parsed(pages, ["page_id", "url"]).select(
        "page_id", F.col("url").alias("source_page"),
        F.posexplode(H.places(own, P.CARD)).alias("position", "_at"), "own")
    found = P.computed_once(found, keep, [H.content(own, F.col("_at")).alias("card")])
    card = F.col("card")
    link, image = (F.get(H.all_tags(card, Element((t,))), F.lit(0)) for t in ("a", "img"))
    read = P.computed_once(found, keep, [
        H.first_text(card, P.CARD_TITLE).alias("title"), P.first_price(card, P.CARD_PRICE).alias("price"),
        H.attribute(link, "href").alias("href"),
        F.coalesce(H.first_text(card, P.CARD_CONDITION), F.lit("Unknown")).alias("condition"),
        P.image_address(image).alias("image_url")]).where("title IS NOT NULL")
    url = F.when(F.startswith("href", F.lit("http")), F.col("href")).otherwise(F.concat(F.lit(site), "href"))
    return read.select(*keep, "title", "price", url.alias("url"), "condition", "image_url",
                       text.category(F.col("title")).alias("category"),
                       text.page_material(F.col("title")).alias("material"))


def cells(pages):
    """``specification_rows`` as column expressions."""
    section = F.array_join(F.transform(H.first_content(F.col("own"), P.SPECIFICS), lambda t: t["raw"]), "")
    pattern = F.lit(r"(?is)<tr\b[^>]*>\s*<t[dh]\b[^>]*>(.*?)</t[dh]>\s*<t[dh]\b[^>]*>(.*?)</t[dh]>")
    both = [F.regexp_extract_all(section, pattern, F.lit(i)).alias(n) for i, n in ((1, "n"), (2, "v"))]
    found = P.parsed(pages, ["url"]).select(
        text.page_listing_id(F.col("url")).alias("listing_id"), F.posexplode(F.arrays_zip(*both)).alias("position", "_r"))
    name, value = (text.clean_text(H.unescape(text.strip_tags(F.col(f"_r.{c}")))) for c in "nv")
    return found.select("listing_id", "position", name.alias("n"), value.alias("v")).where("n <> '' AND v <> ''").select(
        F.concat_ws("#", "listing_id", "position"), "listing_id", "n", "v", F.lit(0.9))


def pictures(pages, site, host):
    found = P.image_list(F.col("own"), F.col("html"), site, host)
    return P.parsed(pages, ["page_id", "html"]).select("page_id", F.posexplode(found))


def same(pages):
    assert rows(P.result_cards(pages, "https://s")) == rows(cards(pages, "https://s"))
    mine = P.specification_rows(pages)
    assert rows(mine) == rows(cells(pages).toDF(*mine.columns))
    mine = P.page_images(pages, "https://s", "i")
    assert rows(mine) == rows(pictures(pages, "https://s", "i").toDF(*mine.columns))


def test_rows_of_odd_pages(spark):
    pick = random.Random(3)
    texts = ["".join(pick.choices(PARTS + MORE * 3, k=pick.randrange(40))) for _ in range(600)]
    table = [(i, f"https://s/itm/{i}", t) for i, t in enumerate(texts)] + [(-1, "u", None), (-2, None, "")]
    same(spark.createDataFrame(table, "page_id long, url string, html string").coalesce(1))


def test_rows_of_landed_pages(spark):
    small = "/root/testdata/sf0.001"
    for pages in (derived.listing_pages(spark, small), derived.result_pages(spark, small)):
        same(pages.where(F.xxhash64("url") % 10 == 0))


def test_reads_need_no_token_arrays(spark):
    """The arrays of tokens and their elements made these jobs fail by time at 36 million pages."""
    pages = spark.createDataFrame([(1, "u", "<p>")], "page_id long, url string, html string")
    for read in (P.result_cards(pages, ""), P.specification_rows(pages), P.page_images(pages, "")):
        assert "regexp_extract_all" not in read._jdf.queryExecution().analyzed().toString()
