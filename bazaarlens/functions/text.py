"""Column expressions that read listing fields out of free text.

Every function takes and returns a ``Column``; nothing leaves the JVM.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Condition names, price and currency patterns, vocabularies.
CONDITIONS = {
    "new": "New",
    "new with tags": "New with tags",
    "new without tags": "New without tags",
    "new with defects": "New with defects",
    "manufacturer refurbished": "Manufacturer refurbished",
    "seller refurbished": "Seller refurbished",
    "used": "Used",
    "very good": "Very Good",
    "good": "Good",
    "acceptable": "Acceptable",
    "for parts": "For parts or not working",
    "for parts or not working": "For parts or not working",
}
PRICE_PATTERNS = [
    r"\$[\d,]+\.?\d*",
    r"USD\s*[\d,]+\.?\d*",
    r"[\d,]+\.?\d*\s*USD",
    r"[\d,]+\.?\d*",
]
CURRENCY_PATTERNS = [
    ("USD", r"\$|USD"),
    ("EUR", r"€|EUR"),
    ("GBP", r"£|GBP"),
    ("CAD", r"CAD|C\$"),
    ("AUD", r"AUD|A\$"),
]
CATEGORY_WORDS = [
    ("rings", ["ring", "wedding", "engagement", "band"]),
    ("necklaces", ["necklace", "chain", "pendant"]),
    ("earrings", ["earring", "stud", "hoop", "drop"]),
    ("bracelets", ["bracelet", "bangle", "cuff"]),
    ("watches", ["watch", "timepiece"]),
    ("brooches", ["brooch", "pin"]),
    ("chains", ["chain"]),
    ("pendants", ["pendant"]),
]
PAGE_CATEGORY_WORDS = [
    ("rings", ["ring", "band", "engagement", "wedding"]),
    ("necklaces", ["necklace", "chain", "pendant", "choker"]),
    ("earrings", ["earring", "stud", "hoop", "drop"]),
    ("bracelets", ["bracelet", "bangle", "cuff"]),
    ("watches", ["watch", "timepiece"]),
]
SCORED_CATEGORY_WORDS = [
    ("rings", ["ring", "band", "engagement", "wedding", "signet", "solitaire"]),
    ("necklaces", ["necklace", "chain", "choker", "collar", "lariat", "riviere"]),
    ("earrings", ["earring", "stud", "hoop", "drop", "chandelier", "huggie"]),
    ("bracelets", ["bracelet", "bangle", "cuff", "tennis", "charm"]),
    ("watches", ["watch", "timepiece", "rolex", "omega", "cartier", "chronograph"]),
    ("pendants", ["pendant", "charm", "medallion", "locket"]),
    ("chains", ["chain", "rope", "figaro", "curb", "snake"]),
    ("brooches", ["brooch", "pin", "clip"]),
    ("gemstones", ["diamond", "ruby", "emerald", "sapphire", "gemstone", "precious"]),
    ("pearls", ["pearl", "cultured", "freshwater", "tahitian"]),
    ("vintage", ["vintage", "antique", "estate", "art deco", "victorian"]),
    ("luxury", ["luxury", "designer", "tiffany", "bulgari", "gucci"]),
]
MATERIAL_PATTERNS = [
    ("gold", r"\b(?:gold|14k|18k|10k|24k)\b"),
    ("silver", r"\b(?:silver|sterling|\.925)\b"),
    ("platinum", r"\b(?:platinum|plat|pt950|pt900)\b"),
    ("titanium", r"\btitanium\b"),
    ("stainless_steel", r"\bsteel\b"),
]
PAGE_MATERIAL_WORDS = [
    ("gold", ["gold", "14k", "18k", "10k"]),
    ("silver", ["silver", "sterling", "925"]),
    ("platinum", ["platinum"]),
    ("titanium", ["titanium"]),
    ("stainless_steel", ["steel", "stainless"]),
]
GEMSTONE_PATTERNS = [
    r"\b(?:diamond|diamonds|brilliant|solitaire)\b",
    r"\b(?:ruby|rubies|sapphire|emerald|topaz|amethyst|garnet|pearl|pearls)\b",
    r"\b(?:cubic\s+zirconia|cz|moissanite|opal|turquoise|jade)\b",
]
RING_SIZES = [
    r"\bsize\s*[:=]?\s*(\d+(?:\.\d+)?)\b",
    r"\b(\d+(?:\.\d+)?)\s*(?:size|sz)\b",
    r"\bUS\s*(\d+(?:\.\d+)?)\b",
]
LENGTH_SIZES = [
    r"\b(\d+(?:\.\d+)?)\s*(?:inch|inches|in|\")\b",
    r"\b(\d+(?:\.\d+)?)\s*(?:cm|centimeter|centimeters)\b",
]
STONE_COLOR = r"\b(white|yellow|blue|red|green|pink|black|clear|colorless)\s*(?:color|colored)?\b"
STONE_CLARITY = r"\b(FL|IF|VVS1|VVS2|VS1|VS2|SI1|SI2|I1|I2|I3|flawless|eye\s*clean)\b"
STONE_CUT = (
    r"\b(round|princess|emerald|oval|marquise|pear|cushion|heart|radiant|brilliant)\s*(?:cut)?\b"
)
STONE_CARAT = r"\b(\d+(?:\.\d+)?)\s*(?:ct|carat|carats)\b"
DIMENSIONS = [
    r"\b(\d+(?:\.\d+)?)\s*(?:x|×)\s*(\d+(?:\.\d+)?)\s*(?:x|×)?\s*(\d+(?:\.\d+)?)?\s*"
    r"(?:inches?|in|cm|mm)\b",
    r"\b(\d+(?:\.\d+)?)\s*(?:L|length)\s*(?:x|×)\s*(\d+(?:\.\d+)?)\s*(?:W|width)\b",
]
WEIGHTS = [
    r"\b(\d+(?:\.\d+)?)\s*(?:grams?|g|oz|ounces?|lbs?|pounds?)\b",
    r"\b(\d+(?:\.\d+)?)\s*(?:dwt|pennyweight)\b",
]
URL_ID_PATTERNS = [r"/itm/.*?/(\d+)", r"/itm/(\d+)", r"item=(\d+)", r"#(\d+)"]
ITEM_NUMBERS = [r"item number[:\s]*(\d+)", r"#(\d{12,})"]
LISTING_TYPES = [
    ("Buy It Now", ["buy it now", "bin"]),
    ("Auction", ["auction", "bid"]),
    ("Best Offer", ["best offer"]),
]
STATUS_WORDS = [
    ("sold", ["sold", "ended", "no longer available"]),
    ("active", ["active", "available", "buy it now"]),
]
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".webp", ".gif"]
# Fixed value: what field texts of a page may carry besides their content.
BOILERPLATE = [r"\bSee original listing\b"]
EMBEDDED_IMAGES = [
    r'"originalImg":"([^"]+)"',
    r'"imageUrls":\[([^\]]+)\]',
    r'"mainImgUrl":"([^"]+)"',
    r'imgURL:\s*"([^"]+)"',
]


def non_empty(value: Column) -> Column:
    """The text, NULL when it is empty; the (costly) value is computed once."""
    return F.get(F.filter(F.array(value), lambda v: v != ""), F.lit(0))


def found(text: Column, pattern: str, group: int = 0, ignore_case: bool = True) -> Column:
    """The first match of a pattern, NULL when there is none."""
    flag = "(?i)" if ignore_case else ""
    return non_empty(F.regexp_extract(text, flag + pattern, group))


def first_found(text: Column, patterns, group: int = 0, ignore_case: bool = True) -> Column:
    return F.coalesce(*[found(text, p, group, ignore_case) for p in patterns])


def any_word(text: Column, words) -> Column:
    """Whether any of the words occurs anywhere in the (lower-case) text."""
    return text.rlike("|".join(re.escape(w) for w in words))


def first_label(text: Column, vocabulary, default: str | None, whole_words: bool = False) -> Column:
    """Label of the first vocabulary entry with a word in the text."""
    lower, out = F.lower(text), None
    for label, words in vocabulary:
        if whole_words:
            hit = lower.rlike(r"\b(?:" + "|".join(words) + r")s?\b")
        else:
            hit = any_word(lower, words)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def squeeze(text: Column) -> Column:
    """Trim and turn every run of white space into one blank."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_title(text: Column) -> Column:
    cleaned = F.regexp_replace(squeeze(text), r"""[^\p{L}\p{N}_\s\-.,:;!?()&'"]+""", "")
    return F.when(
        F.length(cleaned) > 500, F.concat(F.substring(cleaned, 1, 497), F.lit("..."))
    ).otherwise(cleaned)


def clean_text(text: Column, boilerplate: list[str] | None = None) -> Column:
    """Squeeze blanks and drop the words a marketplace adds to its fields.

    ``boilerplate`` holds regular expressions of a site's own additions; nothing else is removed.
    """
    out = squeeze(text)
    for pattern in BOILERPLATE if boilerplate is None else boilerplate:
        out = F.regexp_replace(out, f"(?i){pattern}", "")
    return F.trim(out)


def standard_condition(text: Column) -> Column:
    trimmed = F.trim(text)
    names = F.create_map(*[F.lit(x) for pair in CONDITIONS.items() for x in pair])
    return F.coalesce(F.element_at(names, F.lower(trimmed)), trimmed)


def price_value(text: Column) -> Column:
    """First readable price in the text, 0.0 when there is none."""

    def parse(match: Column) -> Column:
        digits = F.regexp_replace(match, r"[^\d.,]", "")
        decimal_comma = ~F.contains(digits, F.lit(".")) & digits.rlike(r"^[^,]*,[^,]{0,2}$")
        plain = F.when(decimal_comma, F.replace(digits, F.lit(","), F.lit("."))).otherwise(
            F.replace(digits, F.lit(","), F.lit(""))
        )
        return plain.try_cast("double")

    return F.coalesce(*[parse(found(text, p)) for p in PRICE_PATTERNS], F.lit(0.0))


def plain_price(text: Column) -> Column:
    """Price as read from a page element: all commas are thousands separators."""
    digits = found(F.replace(text, F.lit(","), F.lit("")), r"\d+\.?\d*")
    return F.coalesce(digits.try_cast("double"), F.lit(0.0))


def currency(text: Column) -> Column:
    out = None
    for code, pattern in CURRENCY_PATTERNS:
        hit = text.rlike(f"(?i){pattern}")
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.otherwise("USD")


def category(text: Column, mode: str = "substring") -> Column:
    """Category of a title. ``substring`` finds "ring" in "earring"; ``word`` does not."""
    return first_label(text, CATEGORY_WORDS, "other", whole_words=mode == "word")


def page_category(text: Column) -> Column:
    return first_label(text, PAGE_CATEGORY_WORDS, "other")


def page_material(text: Column) -> Column:
    return first_label(text, PAGE_MATERIAL_WORDS, "unknown")


def scored_category(text: Column) -> Column:
    """Category with most keyword hits; the earlier class wins a tie."""
    lower = F.lower(text)
    scores = []
    for rank, (label, words) in enumerate(SCORED_CATEGORY_WORDS):
        hits = sum((F.contains(lower, F.lit(w)).cast("int") for w in words), F.lit(0))
        scores.append(
            F.struct(hits.alias("hits"), F.lit(-rank).alias("order"), F.lit(label).alias("label"))
        )
    best = F.array_max(F.array(*scores))
    return F.when(best["hits"] > 0, best["label"]).otherwise("other")


def primary_material(text: Column) -> Column:
    out = None
    for label, pattern in MATERIAL_PATTERNS:
        hit = text.rlike(f"(?i){pattern}")
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("unknown")


def all_materials(text: Column) -> Column:
    return F.array_compact(
        F.array(*[F.when(text.rlike(f"(?i){p}"), label) for label, p in MATERIAL_PATTERNS])
    )


def primary_gemstone(text: Column) -> Column:
    return F.lower(first_found(text, GEMSTONE_PATTERNS))


def size_for(text: Column, category_col: Column) -> Column:
    length = first_found(text, LENGTH_SIZES, 1)
    return F.when(category_col == "rings", first_found(text, RING_SIZES, 1)).when(
        category_col.isin("necklaces", "bracelets", "chains"), length
    )


def stone_color(text: Column) -> Column:
    return F.lower(found(text, STONE_COLOR, 1))


def stone_clarity(text: Column) -> Column:
    return F.upper(found(text, STONE_CLARITY, 1))


def stone_cut(text: Column) -> Column:
    return F.lower(found(text, STONE_CUT, 1))


def stone_carat(text: Column) -> Column:
    return found(text, STONE_CARAT, 1)


def dimensions(text: Column) -> Column:
    return first_found(text, DIMENSIONS)


def weight(text: Column) -> Column:
    return first_found(text, WEIGHTS)


def first_number(text: Column) -> Column:
    return found(F.replace(text, F.lit(","), F.lit("")), r"(\d+)", 1).try_cast("long")


def percentage(text: Column) -> Column:
    return found(text, r"(\d+(?:\.\d+)?)%", 1).try_cast("double")


def listing_id(url: Column) -> Column:
    """Numeric id from the address, else 12 hex digits of its md5."""
    return F.coalesce(
        first_found(url, URL_ID_PATTERNS, 1, ignore_case=False),
        F.substring(F.md5(url.cast("binary")), 1, 12),
    )


def page_listing_id(url: Column) -> Column:
    return F.coalesce(
        found(url, r"/itm/([^/?]+)", 1, ignore_case=False),
        F.substring(F.md5(url.cast("binary")), 1, 12),
    )


def is_url(url: Column) -> Column:
    """Scheme and host are both present (never NULL)."""
    return F.coalesce(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\s]+"), F.lit(False))


def item_number(text: Column) -> Column:
    return first_found(text, ITEM_NUMBERS, 1)


def listing_type(text: Column) -> Column:
    return first_label(text, LISTING_TYPES, "Unknown")


def listing_status(text: Column) -> Column:
    return first_label(text, STATUS_WORDS, "unknown")


def image_urls(urls: Column) -> Column:
    """Addresses that are valid and look like images."""

    def looks_like_image(url: Column) -> Column:
        # plain searches come first: a filter of an array is not compiled, and patterns cost most there
        lower = F.lower(url)
        named = reduce(or_, [F.contains(lower, F.lit(w)) for w in [*IMAGE_SUFFIXES, "image"]])
        return named & F.contains(url, F.lit("://")) & is_url(url)

    return F.filter(urls, looks_like_image)


def normal_image_url(url: Column, site: str, host: str = "") -> Column:
    """Absolute address with the size token raised to the large rendition.

    ``host`` limits the size rule to addresses of one image host.
    """
    absolute = F.when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url)).when(
        F.startswith(url, F.lit("/")), F.concat(F.lit(site), url)
    )
    absolute = absolute.otherwise(url)

    def sized(text: Column, mark: str, pattern: str, size: str) -> Column:
        # the plain search spares most addresses the pattern
        return F.when(F.contains(absolute, F.lit(mark)), F.regexp_replace(text, pattern, size)).otherwise(text)

    large = sized(absolute, "s-l", r"s-l\d+", "s-l1600")
    large = sized(large, "$_", r"\$_\d+\.JPG", r"\$_57.JPG")
    return F.when(F.contains(absolute, F.lit(host)), large).otherwise(absolute)


def embedded_image_urls(html: Column, site: str, host: str = "") -> Column:
    """Image addresses in embedded page data, in order, without repeats."""
    # a plain search for the first word of each pattern is far cheaper than the pattern
    hits = F.flatten(
        F.array(
            *[
                F.when(
                    F.contains(html, F.lit(re.search(r"\w+", p)[0])),
                    F.regexp_extract_all(html, F.lit(p), F.lit(1)),
                ).otherwise(F.array().cast("array<string>"))
                for p in EMBEDDED_IMAGES
            ]
        )
    )
    kept = F.filter(hits, lambda u: F.contains(u, F.lit(host)))
    return F.array_distinct(
        F.transform(
            kept, lambda u: normal_image_url(F.replace(u, F.lit("\\/"), F.lit("/")), site, host)
        )
    )


def features(blocks: Column, description: Column) -> Column:
    """Texts longer than 10 characters, each once: page blocks first, then description bullets."""
    bullets = F.transform(
        F.regexp_extract_all(description, F.lit(r"[•*-]\s*([^•*\-\n]+)"), F.lit(1)),
        lambda t: F.trim(t),
    )
    empty = F.array().cast("array<string>")
    cleaned = F.transform(F.coalesce(blocks, empty), lambda t: clean_text(t))
    both = F.concat(cleaned, F.coalesce(bullets, empty))
    return F.array_distinct(F.filter(both, lambda t: F.length(t) > 10))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<[^>]*>", "")


def visible_text(html: Column) -> Column:
    """Page text without scripts, styles, comments and tags, blanks squeezed."""
    out = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    return squeeze(F.regexp_replace(out, r"(?s)<[^>]*>", " "))
