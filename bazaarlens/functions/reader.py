"""Listing fields, images, cards and specification rows of landed pages, read in one pass per page.

The rules are those of ``functions.html``: the same tokens, elements, texts and references. There
every field is an expression over the page's token array; for jobs that want many fields of every
page, one walk that indexes the opening tags by id and class costs a fraction. Tags that many pages
share are taken apart once per task process.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import DataFrame

from bazaarlens.functions.html import VOID, Element
from bazaarlens.functions.text import EMBEDDED_IMAGES

# The tokens of ``html.TOKEN`` other than text, the frequent ones first: tags that begin no script or
# style. What lies between two of them is text, a sign that begins none included.
_MARK = re.compile(
    r"(?s)(<(?!(?i:script|style)\b)/?[a-zA-Z][\w-]*[^>]*>|<!--.*?-->"
    r"|<(?i:script|style)\b.*?</(?i:script|style)\s*>|</?[a-zA-Z][\w-]*[^>]*>|<![^>]*>)", re.ASCII
)
_CLOSED = re.compile(r"</(?:script|style)\s*>", re.ASCII)
_NAME = re.compile(r"</?([a-z][\w-]*)", re.ASCII | re.IGNORECASE)
_BLOCK = re.compile(r"(?is)<(?:script|style)\b.*?</(?:script|style)\s*>", re.ASCII)
_KEPT_TAGS, _LONGEST_TAG = 20_000, 200
_VOID = frozenset(VOID)
# ASCII white space, the next line and the separators of Unicode
_SEPARATORS = map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
_BLANKS = re.compile(f"[\\t-\\r {''.join(_SEPARATORS)}]+")
# what ``str.split`` takes for blanks beyond those
_CONTROLS = re.compile("[\x1c-\x1f]")
_REFERENCE = re.compile(r"&(?:#([0-9]{1,7})|#[xX]([0-9a-fA-F]{1,6})|([A-Za-z][A-Za-z0-9]*));")
_NUMBER = re.compile(r"\d+\.?\d*", re.ASCII)
_SIZE, _LARGE = re.compile(r"s-l\d+", re.ASCII), re.compile(r"\$_\d+\.JPG", re.ASCII)
_EMBEDDED = [(re.search(r"\w+", p)[0], re.compile(p, re.ASCII)) for p in EMBEDDED_IMAGES]
_MARKUP = re.compile(r"<[^>]*>")
_TWO_CELLS = re.compile(
    r"(?is)<tr\b[^>]*>\s*<t[dh]\b[^>]*>(.*?)</t[dh]>\s*<t[dh]\b[^>]*>(.*?)</t[dh]>", re.ASCII
)
_ROWS_PER_BATCH = 10_000
_TEXTS_AT_ONCE = 64
_SEVERAL = re.compile("[\t\n\r\f ]")
_SPACES = str.maketrans("\t\n\r\f", "    ")


def _attribute_pattern(name: str) -> re.Pattern:
    return re.compile(rf"""(?is)(?<![\w-]){name}\s*=\s*(["'])(.*?)\1""", re.ASCII)


_ATTRIBUTES = {name: _attribute_pattern(name) for name in ("id", "class", "src", "data-src", "href")}


_USUAL = {name: f' {name}="' for name in _ATTRIBUTES}


def _held(text: str, name: str) -> bool:
    """Whether the name may be that of an attribute there, which it is not inside ``data-src``."""
    low = text.lower()
    return name in low and (name != "src" or low.count("src") > low.count("data-src"))


@lru_cache(4096)
def attribute(raw: str, name: str) -> str | None:
    usual = _USUAL[name]
    at = raw.find(usual)
    if at >= 0 and not _held(raw[:at], name) and (stop := raw.find('"', at + len(usual))) >= 0:
        return raw[at + len(usual):stop].strip(" ") or None
    if not _held(raw, name):
        return None
    found = _ATTRIBUTES[name].search(raw)
    return (found[2].strip(" ") or None) if found else None


@lru_cache(4096)
def _decoded(reference: str) -> str:
    digits, hexadecimal, name = _REFERENCE.fullmatch(reference).groups()
    if name:
        return chr(name2codepoint[name]) if name in name2codepoint else reference
    code = int(digits) if digits else int(hexadecimal, 16)
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code <= 0xDFFF else "\ufffd"


def unescape(text: str) -> str:
    return _REFERENCE.sub(lambda found: _decoded(found[0]), text) if "&" in text else text


def squeezed(text: str) -> str:
    """Text with single spaces for its blanks, none at its ends."""
    if _CONTROLS.search(text):
        return _BLANKS.sub(" ", text).strip(" ")
    return " ".join(text.split())


_TAGS: dict[str, tuple[str, int, list[tuple[str, str]]]] = {}


def _tag(raw: str) -> tuple[str, int, list[tuple[str, str]]]:
    """Name, step and the (id or class, token) pairs of a tag; the name of other markup is ``!``."""
    found = _NAME.match(raw)
    if found is None:
        return "!", 0, []
    name, step, keys = found[1].lower(), -1, []
    if name in ("script", "style") and _BLOCK.match(raw):
        return "!", 0, []
    if raw[1] != "/":
        step = 0 if name in _VOID or raw.endswith("/>") else 1
        for kind in ("id", "class"):
            if kind in raw and (value := attribute(raw, kind)):
                if _SEVERAL.search(value):
                    keys += dict.fromkeys((kind, token) for token in value.translate(_SPACES).split(" "))
                else:
                    keys.append((kind, value))
    if len(raw) <= _LONGEST_TAG:
        if len(_TAGS) >= _KEPT_TAGS:
            _TAGS.clear()
        _TAGS[raw] = name, step, keys
    return name, step, keys


class Page:
    """Markup of a page with the texts between, and the places of its opening tags by id and by class.

    A place is the number of a tag (or other markup); ``parts`` are text and markup in turn.
    """

    def __init__(self, html: str):
        known = _TAGS.get
        self.parts: list[str] = _MARK.split(html)
        # name, step and keys of every tag
        self.tokens = [known(raw) or _tag(raw) for raw in self.parts[1::2]]
        self.places: dict[tuple[str, str], list[int]] = {}
        places = self.places
        for at, token in enumerate(self.tokens):
            if token[2]:
                for key in token[2]:
                    if key in places:
                        places[key].append(at)
                    else:
                        places[key] = [at]

    def tag(self, at: int) -> str:
        return self.parts[2 * at + 1]

    def content(self, element: Element) -> str:
        """All that lies inside the first such element, markup included."""
        if (start := self.first(element)) is None:
            return ""
        inside = self.inside(start)
        return "".join(self.parts[2 * inside.start:2 * inside.stop + 1])

    def all(self, element: Element, within: range | None = None) -> Iterator[int]:
        """Places of such elements, in page order; ``within`` a range of places or anywhere."""
        if within is None:
            within = range(len(self.tokens))
        if element.attr:
            found = self.places.get((element.attr, element.token), [])
            held = range(bisect_left(found, within.start), bisect_left(found, within.stop))
            return (found[i] for i in held if not element.tags or self.tokens[found[i]][0] in element.tags)
        return (
            at for at in within for name, step, _ in [self.tokens[at]]
            if step >= 0 and (name in element.tags if element.tags else name not in ("", "!"))
        )

    def first(self, element: Element, within: range | None = None) -> int | None:
        """The first place of ``all``."""
        if within is None and element.attr:
            for at in self.places.get((element.attr, element.token), ()):
                if not element.tags or self.tokens[at][0] in element.tags:
                    return at
            return None
        return next(self.all(element, within), None)

    def inside(self, start: int, within: range | None = None) -> range:
        """Places inside the element at ``start``: up to its closing tag or the end of ``within``."""
        stop = len(self.tokens) if within is None else within.stop
        tokens = self.tokens
        (name, step, _), depth = tokens[start], 1
        if step != 1:
            return range(start + 1, start)  # not even the text behind it
        for at in range(start + 1, stop):
            if (token := tokens[at])[0] == name:
                depth += token[1]
                if not depth:
                    return range(start + 1, at)
        return range(start + 1, stop)

    def text(self, element: Element, within: range | None = None) -> str | None:
        """Whole text of the first such element, NULL without one or without text."""
        start = self.first(element, within)
        if start is None:
            return None
        inside = self.inside(start, within)
        return squeezed(unescape("".join(self.parts[2 * inside.start:2 * inside.stop + 1:2]))) or None

    def first_text(self, elements: list[Element], within: range | None = None) -> str | None:
        return next((t for e in elements if (t := self.text(e, within)) is not None), None)

    def first_price(self, elements: list[Element], within: range | None = None) -> float:
        """Price of the first element whose text holds a number, 0 without one."""
        for element in elements:
            found = _NUMBER.search((self.text(element, within) or "").replace(",", ""))
            if found and (price := float(found[0])) > 0:
                return price
        return 0.0


def content(html: str, element: Element) -> str:
    """``Page.content`` of an element with an id or class, found by searching for it: tokens are read
    from its tag on only.

    A sign begins a tag there, and is no part of another token, if the tag, comment, script and style
    that may hold it are closed before. Where they are not, all tokens of the page are read.
    """
    key, low, at = (element.attr, element.token), html.lower(), html.find(element.token)
    while at >= 0:
        start = html.rfind("<", 0, at)
        stop = html.find(">", start) + 1 if start >= 0 else 0
        raw = html[start:stop] if stop > at else "<"
        name, step, keys = _TAGS.get(raw) or _tag(raw)
        if name == "!":  # text
            at = html.find(element.token, at + 1)
            continue
        before = html.rfind("<", 0, start)
        if before >= 0 and html.find(">", before, start) < 0:
            return Page(html).content(element)
        if key in keys and (not element.tags or name in element.tags):
            if (
                len(low) != len(html)  # places differ
                or name.startswith(("script", "style"))
                or (at := low.rfind("<!--", 0, start)) >= 0 and low.find("-->", at + 4, start) < 0
                or any((at := low.rfind(n, 0, start)) >= 0 and not _CLOSED.search(low, at, start)
                       for n in ("<script", "<style"))
            ):
                return Page(html).content(element)
            return html[stop:_end(html, name, stop)] if step == 1 else ""
        at = html.find(element.token, stop)
    return ""


def _end(html: str, name: str, start: int) -> int:
    """Where an element of that name ends whose inside begins at ``start``."""
    depth, known = 1, _TAGS.get
    for mark in _MARK.finditer(html, start):
        token = known(raw := mark[0]) or _tag(raw)
        if token[0] == name:
            depth += token[1]
            if not depth:
                return mark.start()
    return len(html)


def _large(url: str, site: str, host: str) -> str:
    """Absolute address in the large rendition."""
    if url.startswith("/"):
        url = f"https:{url}" if url.startswith("//") else site + url
    if host in url:
        url = _SIZE.sub("s-l1600", url) if "s-l" in url else url
        url = _LARGE.sub("$_57.JPG", url) if "$_" in url else url
    return url


def images(page: Page, html: str, main: list[Element], thumbnail: Element, site: str, host: str) -> list[str]:
    """Main image, then thumbnails, then addresses in embedded page data, each once."""
    tags = [at for e in main if (at := page.first(e)) is not None]
    shown = [
        attribute(raw, "src") or attribute(raw, "data-src")
        for raw in map(page.tag, [*tags, *page.all(thumbnail)])
    ]
    embedded = [
        found[1].replace("\\/", "/")
        for word, pattern in _EMBEDDED if word in html
        for found in pattern.finditer(html) if host in (found[1] or "")
    ]
    return list(dict.fromkeys(_large(url, site, host) for url in [*filter(None, shown), *embedded]))


def _texts(column: pa.Array) -> Iterator[str | None]:
    """The texts of a column, few in memory at a time."""
    for start in range(0, len(column), _TEXTS_AT_ONCE):
        yield from column.slice(start, _TEXTS_AT_ONCE).to_pylist()


def read_fields(
    pages: DataFrame, keep: list[str], title: list[Element], price: list[Element],
    condition: list[Element], seller: list[Element], main_image: list[Element], thumbnail: Element,
    site: str = "", host: str = "",
) -> DataFrame:
    """``keep`` of every page, and ``title, price, condition, seller_name, image_urls,
    html_length`` of its column ``html``; a null page has a price of 0 and no other field."""
    fields = ["title", "price", "condition", "seller_name", "image_urls", "html_length"]
    types = [pa.string(), pa.float64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32()]

    def read(html: str | None) -> tuple:
        if html is None:
            return None, 0.0, None, None, None, None
        page = Page(html)
        urls = images(page, html, main_image, thumbnail, site, host)
        return (
            page.first_text(title), page.first_price(price), page.first_text(condition),
            page.first_text(seller), [u for u in urls if u.startswith("http")], len(html),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = zip(*map(read, _texts(batch.column(len(keep)))), strict=True)
            columns = [pa.array(values, t) for values, t in zip(rows, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=[*keep, *fields])

    kinds = dict(pages.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + (
        ", title string, price double, condition string, seller_name string,"
        " image_urls array<string>, html_length int"
    )
    return pages.select(*keep, "html").mapInArrow(run, schema)


def _rows_of(
    pages: DataFrame, keep: list[str], fields: dict[str, str], types: list[pa.DataType],
    read: Callable[[str], Iterator[tuple]],
) -> DataFrame:
    """``keep`` of a page with every row that ``read`` makes of its column ``html``; none of NULL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pending: list[tuple] = []
            for at, page in enumerate(_texts(batch.column(len(keep)))):
                if page is not None:
                    pending.extend((at, *row) for row in read(page))
                if pending and (len(pending) >= _ROWS_PER_BATCH or at + 1 == batch.num_rows):
                    places, *rows = zip(*pending, strict=True)
                    own = batch.take(pa.array(places)).columns[: len(keep)]
                    columns = [pa.array(values, t) for values, t in zip(rows, types, strict=True)]
                    yield pa.RecordBatch.from_arrays([*own, *columns], names=[*keep, *fields])
                    pending = []

    kinds = dict(pages.dtypes)
    schema = ", ".join(f"`{c}` {t}" for c, t in [*((c, kinds[c]) for c in keep), *fields.items()])
    return pages.select(*keep, "html").mapInArrow(run, schema)


def read_images(
    pages: DataFrame, keep: list[str], main_image: list[Element], thumbnail: Element, site: str, host: str
) -> DataFrame:
    """``keep, position, image_url`` of every image of a page."""
    def read(html: str) -> Iterator[tuple]:
        return enumerate(images(Page(html), html, main_image, thumbnail, site, host))

    return _rows_of(pages, keep, {"position": "int", "image_url": "string"}, [pa.int32(), pa.string()], read)


def read_cards(
    pages: DataFrame, keep: list[str], card: Element, title: list[Element], price: list[Element],
    condition: list[Element],
) -> DataFrame:
    """``keep, position, title, price, href, condition, image_url`` of every card with a title."""
    link, image = Element(("a",)), Element(("img",))

    def read(html: str) -> Iterator[tuple]:
        page = Page(html)
        for position, start in enumerate(page.all(card)):
            inside = page.inside(start)
            if (name := page.first_text(title, inside)) is None:
                continue
            a, img = page.first(link, inside), page.first(image, inside)
            shown = None if img is None else page.tag(img)
            yield (
                position, name, page.first_price(price, inside), a if a is None else attribute(page.tag(a), "href"),
                page.first_text(condition, inside),
                shown and (attribute(shown, "src") or attribute(shown, "data-src")),
            )

    fields = {"position": "int", "title": "string", "price": "double", "href": "string",
              "condition": "string", "image_url": "string"}
    text = pa.string()
    return _rows_of(pages, keep, fields, [pa.int32(), text, pa.float64(), text, text, text], read)


def read_cells(pages: DataFrame, keep: list[str], section: Element) -> DataFrame:
    """``keep, position, name, value`` of every two-cell row in the first such section: the cells'
    texts without tags, references decoded."""
    def read(html: str) -> Iterator[tuple]:
        rows = _TWO_CELLS.findall(content(html, section))
        for position, cells in enumerate(rows):
            yield position, *(unescape(_MARKUP.sub("", cell)) for cell in cells)

    fields = {"position": "int", "name": "string", "value": "string"}
    return _rows_of(pages, keep, fields, [pa.int32(), pa.string(), pa.string()], read)
