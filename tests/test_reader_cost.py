"""What the page jobs need not do: read the tokens before a section, sort rows to deal them out."""

import random

import pytest

from bazaarlens.functions import reader
from bazaarlens.plans import pages as P
from bazaarlens.sources import derived
from tests.test_reader import PARTS
from tests.test_reader_rows import MORE

ODD = [
    '<table class="itemAttr">', '<div class="x itemAttr">', '<div class="itemAttr"/>', "itemAttr", '<script class="itemAttr">',
    "</script >", "<style>", "</STYLE>", '<!-- <table class="itemAttr">', "-->", '<a <span class="itemAttr">', " < b",
    "<SCRIPT>", '<script-x class="itemAttr">', "İ", '<!x "itemAttr">', "<!-->", "<>", "</", '<img class="itemAttr">',
]


def test_section_found_by_searching_is_that_of_all_tokens():
    pick = random.Random(11)
    for _ in range(20_000):
        html = "".join(pick.choices(PARTS + MORE + ODD * 3, k=pick.randrange(1, 20)))
        assert reader.content(html, P.SPECIFICS) == reader.Page(html).content(P.SPECIFICS), html


def test_tokens_before_a_section_are_not_read(monkeypatch):
    def fail(html):
        raise AssertionError("all tokens are read")

    monkeypatch.setattr(reader, "Page", fail)
    html = '<script>if (a < b) {}</script><!-- x --><p>' * 50 + '<div class="itemAttr"><b>x</b></div> itemAttr'
    assert reader.content(html, P.SPECIFICS) == "<b>x</b>"
    assert reader.content("<p>" * 50, P.SPECIFICS) == ""


@pytest.mark.parametrize("text", ["a \x1c\t b\x1f", " a \x85 b ", "\x1d", ""])
def test_blanks_are_those_of_the_expressions(text):
    assert reader.squeezed(text) == reader._BLANKS.sub(" ", text).strip(" ")


@pytest.mark.parametrize("raw", [
    '<img data-src="a" src="b">', '<img data-src="a">', '<img SRC="x" src="y">', "<img src = 'w'>", '<img data-src="a"src="b">',
    '<img alt=" src=" src="b">', '<img data-src=\'a src="b" \'>', '<img src="">', '<img src=" b ">', '<img src="b>', '<img xsrc="a" src="b">',
])
def test_attributes_are_those_of_the_pattern(raw):
    for name in ("src", "data-src"):
        found = reader._ATTRIBUTES[name].search(raw)
        assert reader.attribute(raw, name) == ((found[2].strip(" ") or None) if found else None)


def test_pages_are_not_sorted_to_deal_them_out(spark):
    plan = derived.listing_pages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" not in plan
