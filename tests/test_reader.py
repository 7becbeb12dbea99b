"""The one-pass page reader agrees with the column expressions it stands for."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bazaarlens.functions import html as H
from bazaarlens.functions import reader
from bazaarlens.plans import pages as P
from bazaarlens.sources import derived

PARTS = [
    '<h1 id="it-ttl">', "<h1 class='x-item-title-label notranslate'>", '<span class="notranslate">', "</h1>",
    "</span>", '<div class="condText u">', "</div>", "<div>", "<h1>", "<br/>", "<br>", "<!-- x > y -->", "<!doctype>",
    '<div id="mm-saleDscPrc">', '<b class="\tcc-ts-BOLD\n">', "</b>", "$1,234.50", "0", "12.", " a &amp; b ", "&#36;", "&#x42;",
    "&#0;", "&#xD800;", "&eacute;", "&nosuch;", "&", " \xa0", "<", ">", "plain", "é", '<span class="mbg-nw">',
    '<a class="seller-name" data-id="x" >', "</a>", '<img id="icImg" src="//i/s-l64.jpg">',
    '<img class="tdThumb x" data-src="/b/$_12.JPG">', '<img class="tdThumb" src="http://i/s-l64.jpg" />',
    '<script>var a = "<h1>"; "originalImg":"https:\\/\\/e\\/s-l9.jpg"</script>', "<IMG CLASS='tdThumb' SRC=' http://u '>",
    '"imageUrl":"http://q/1.jpg"', '<span class="">', "<span class= notranslate>", "</SPAN>", "<H1 id=\"it-ttl\">", "</h1",
]


def native(pages):
    own, html = F.col("own"), F.col("html")
    return P.parsed(pages, ["page_id", "html"]).select(
        "page_id", H.first_text(own, P.TITLE).alias("title"), P.first_price(own, P.PRICE).alias("price"),
        H.first_text(own, P.CONDITION).alias("condition"), H.first_text(own, P.SELLER).alias("seller_name"),
        F.filter(P.image_list(own, html, "http://site"), lambda u: F.startswith(u, F.lit("http"))).alias("image_urls"),
        F.length(html).alias("html_length"),
    )


def in_one_pass(pages):
    return reader.read_fields(
        pages, ["page_id"], P.TITLE, P.PRICE, P.CONDITION, P.SELLER, P.MAIN_IMAGE, P.THUMBNAIL, "http://site")


def rows(df):
    return sorted(map(str, df.collect()))


@settings(max_examples=3, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=25).map("".join), min_size=200, max_size=200))
def test_odd_pages(spark, texts):
    pages = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").coalesce(1)
    assert rows(in_one_pass(pages)) == rows(native(pages))


def test_landed_pages(spark):
    pages = derived.listing_pages(spark, "/root/testdata/sf0.001").select("page_id", "html")
    assert in_one_pass(pages).exceptAll(native(pages)).count() == 0
    other = derived.pages(spark, "/root/testdata/sf0.001").select("page_id", "html")
    assert rows(in_one_pass(other)) == rows(native(other))


def test_pages_without_text(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<"), (4, "text only")], "page_id long, html string")
    out = {r["page_id"]: r for r in in_one_pass(pages).collect()}
    assert (out[1]["title"], out[1]["price"], out[1]["image_urls"], out[1]["html_length"]) == (None, 0.0, None, None)
    assert [(r["image_urls"], r["html_length"]) for i, r in sorted(out.items()) if i > 1] == [([], 0), ([], 1), ([], 9)]
    assert in_one_pass(pages.limit(0)).count() == 0
