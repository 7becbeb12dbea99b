"""Elements of landed pages as column expressions.

A page is cut once into tags and text. Elements are then found by tag, id and class among the
tags, and an element's text is that of everything up to its own closing tag, whatever is nested in
it. An element that is never closed reaches to the end of its page.
"""

from __future__ import annotations

from dataclasses import dataclass
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements without content.
VOID = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track",
    "wbr",
]
TOKEN = (
    r"(?is)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>|</?([a-z][\w-]*)[^>]*>"
    r"|<![^>]*>|[^<]+|<"
)


def tokens(html: Column) -> Column:
    """The page as an array of (raw, name, step, id, class): step 1 opens, -1 closes, 0 is neither;
    text has an empty name, and a comment, script or style is one token named ``!``. Ids and class
    lists stand between blanks, so that a token of them is found as text.

    Names come from a second pass of the same pattern, not from a match per token.
    """
    def listed(raw: Column, name: str) -> Column:
        value = F.translate(attribute(raw, name), "\t\n\r\f", "    ")
        return F.when(
            F.contains(raw, F.lit(name)), F.concat(F.lit(" "), value, F.lit(" "))
        ).alias(name)

    def parsed(raw: Column, found: Column) -> Column:
        blank = F.lit(None).cast("string")
        other = F.when(F.startswith(raw, F.lit("<")) & (raw != "<"), "!").otherwise("")
        plain = F.struct(
            raw.alias("raw"), other.alias("name"), F.lit(0).alias("step"), blank.alias("id"),
            blank.alias("class"),
        )
        closing = F.struct(
            raw.alias("raw"), F.lower(found).alias("name"), F.lit(-1).alias("step"),
            blank.alias("id"), blank.alias("class"),
        )
        alone = F.lower(found).isin(VOID) | F.endswith(raw, F.lit("/>"))
        opening = F.struct(
            raw.alias("raw"), F.lower(found).alias("name"),
            F.when(alone, 0).otherwise(1).alias("step"), listed(raw, "id"), listed(raw, "class"),
        )
        return F.when(found == "", plain).when(F.startswith(raw, F.lit("</")), closing).otherwise(
            opening
        )

    return F.zip_with(
        F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0)),
        F.regexp_extract_all(html, F.lit(TOKEN), F.lit(1)),
        parsed,
    )


def attribute(raw: Column, name: str) -> Column:
    """Value of an attribute in a tag, NULL when missing or empty."""
    pattern = rf"""(?is)(?<![\w-]){name}\s*=\s*(["'])(.*?)\1"""
    return _let(F.trim(F.regexp_extract(raw, pattern, 2)), lambda v: F.nullif(v, F.lit("")))


@dataclass(frozen=True)
class Element:
    """An element by tag and by one token of its id or class."""

    tags: tuple[str, ...] = ()  # none: any tag
    attr: str | None = None  # id or class
    token: str = ""

    def is_opened(self, token: Column) -> Column:
        hit = (token["step"] >= 0) & ~token["name"].isin("", "!")
        if self.tags:
            hit = hit & token["name"].isin(*self.tags)
        if self.attr:
            held = F.contains(token[self.attr], F.lit(f" {self.token} "))
            hit = hit & F.coalesce(held, F.lit(False))
        return hit


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def content(own: Column, start: Column) -> Column:
    """Tokens inside the element whose tag is at ``start`` (from 1): up to its closing tag."""
    def inside(first: Column, rest: Column) -> Column:
        state = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))

        def step(s: Column, t: Column) -> Column:
            depth = s["depth"] + F.when(t["name"] == first["name"], t["step"]).otherwise(0)
            return F.when(
                s["depth"] > 0,
                F.struct(depth.alias("depth"), (s["n"] + (depth > 0).cast("int")).alias("n")),
            ).otherwise(s)

        length = F.aggregate(rest, state, step, lambda s: s["n"])
        return F.slice(rest, 1, F.when(first["step"] == 1, length).otherwise(0))

    return _let(
        F.slice(own, start, F.size(own)),
        lambda tail: _let(
            F.slice(tail, 2, F.size(tail)), lambda rest: inside(F.get(tail, F.lit(0)), rest)
        ),
    )


def token_text(own: Column) -> Column:
    """Text of tokens, entities decoded, blanks squeezed, NULL when nothing is left."""
    parts = F.transform(F.filter(own, lambda t: t["name"] == ""), lambda t: t["raw"])

    def tidy(whole: Column) -> Column:
        squeezed = F.trim(F.regexp_replace(unescape(whole), r"[\s\p{Z}\x{85}]+", " "))
        return _let(squeezed, lambda t: F.nullif(t, F.lit("")))

    return _let(F.array_join(parts, ""), tidy)


def first_content(own: Column, element: Element) -> Column:
    """Tokens inside the first such element, NULL without one."""
    place = F.array_position(F.transform(own, element.is_opened), F.lit(True)).cast("int")
    return _let(place, lambda p: F.when(p > 0, content(own, p)))


def first_text(own: Column, elements: list[Element]) -> Column:
    """Whole text of the first element found, rules in order."""
    return F.coalesce(*[token_text(first_content(own, e)) for e in elements])


def places(own: Column, element: Element) -> Column:
    """Positions (from 1) of all such elements."""
    hits = F.transform(own, lambda t, i: F.when(element.is_opened(t), i + 1))
    return F.array_compact(hits)


def all_texts(own: Column, element: Element) -> Column:
    """Whole texts of all such elements, in page order."""
    return F.transform(places(own, element), lambda p: token_text(content(own, p)))


def all_tags(own: Column, element: Element) -> Column:
    return F.transform(F.filter(own, element.is_opened), lambda t: t["raw"])


def unescape(value: Column) -> Column:
    """Numeric and named character references decoded, each once; unknown names stay."""
    parts = F.regexp_extract_all(
        value, F.lit(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);|[^&]+|&"), F.lit(0)
    )
    names = F.create_map(*[F.lit(x) for n, p in name2codepoint.items() for x in (n, chr(p))])

    def sign(number: Column) -> Column:
        valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        code = F.unhex(F.lpad(F.hex(F.when(valid, number).otherwise(0xFFFD)), 8, "0"))
        return F.decode(code, "UTF-32")

    def decoded(part: Column) -> Column:
        digits = F.regexp_extract(part, r"^&#([0-9]+);$", 1)
        hexadecimal = F.regexp_extract(part, r"^&#[xX]([0-9a-fA-F]+);$", 1)
        name = F.regexp_extract(part, r"^&([A-Za-z][A-Za-z0-9]*);$", 1)
        return (
            F.when(~F.startswith(part, F.lit("&")), part)
            .when(digits != "", sign(digits.try_cast("bigint")))
            .when(hexadecimal != "", sign(F.conv(hexadecimal, 16, 10).try_cast("bigint")))
            .otherwise(F.coalesce(F.try_element_at(names, name), part))
        )

    whole = F.array_join(F.transform(parts, decoded), "")
    return F.when(F.contains(value, F.lit("&")), whole).otherwise(value)
