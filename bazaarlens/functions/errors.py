"""Classification of error rows by type, message and status code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bazaarlens.functions.text import any_word

# Message words of each error class, first match wins.
CLASS_WORDS = [
    ("network", ["connection", "timeout", "dns", "socket", "network", "unreachable", "refused",
                 "reset", "broken pipe"]),
    ("rate_limit", ["rate limit", "throttl", "429", "too many requests", "slow down",
                    "quota exceeded"]),
    ("bot_detection", ["captcha", "robot", "automated", "suspicious", "blocked", "access denied",
                       "forbidden", "403"]),
    ("parsing", ["parse", "parsing", "json", "xml", "html", "decode", "invalid format",
                 "malformed"]),
    ("validation", ["validation", "invalid", "required", "constraint", "format", "range",
                    "missing"]),
    ("authentication", ["auth", "unauthorized", "401", "login", "credential", "token",
                        "expired"]),
    ("permission", ["permission", "forbidden", "403", "access denied", "not allowed",
                    "insufficient"]),
    ("resource", ["memory", "disk", "space", "limit", "quota", "resource", "capacity"]),
    ("system", ["system", "os", "file", "process", "thread", "deadlock", "corruption"]),
]
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
NETWORK_WORDS = ["connection", "timeout", "unreachable", "network", "dns", "socket", "ssl",
                 "certificate", "handshake"]
BROWSER_WORDS = ["browser", "chromium", "firefox", "webkit", "playwright", "selenium", "page",
                 "element", "screenshot"]
PARSING_WORDS = ["parse", "json", "xml", "html", "beautifulsoup", "lxml", "selector", "xpath",
                 "css"]
DETECTION_WORDS = ["blocked", "captcha", "robot", "automation", "suspicious", "security",
                   "verification", "human"]
SYSTEM_WORDS = ["memory", "disk", "permission", "file", "directory", "resource", "system"]
CAPTCHA_SIGNS = ["captcha", "recaptcha", "challenge", "verify", "robot", "security check",
                 "unusual activity"]
RATE_SIGNS = ["rate limit", "too many requests", "slow down", "temporarily blocked", "429",
              "throttled"]
BOT_SIGNS = ["automated requests", "bot detected", "suspicious activity", "access denied",
             "forbidden", "blocked"]
LEVELS = ["none", "low", "medium", "high"]


def error_class(kind: Column, message: Column) -> Column:
    """Class of an error from the words of its type and message."""
    text = F.lower(F.concat_ws(" ", kind, message))
    out = None
    for label, words in CLASS_WORDS:
        hit = any_word(text, words)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("unknown")


def error_severity(kind: Column, label: Column, retries: Column) -> Column:
    often = F.coalesce(retries, F.lit(0)) > 3
    return (
        F.when(kind.isin("MemoryError", "SystemError"), "critical")
        .when(label.isin("system", "resource", "authentication", "permission"), "high")
        .when(label.isin("bot_detection", "rate_limit"), "medium")
        .when((label == "network") & often, "medium")
        .otherwise("low")
    )


def severity_rank(severity: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in SEVERITY_RANK.items() for x in pair])
    return F.element_at(ranks, severity)


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in SEVERITY_RANK]), rank)


def request_error(kind: Column, message: Column, status: Column) -> Column:
    """Struct(category, severity) of a failed page request.

    Rules are tried in order: network words, status code, browser, parsing,
    validation, detection and system words.
    """
    text = F.lower(F.coalesce(message, F.lit("")))

    def result(category: str, severity: Column | str) -> Column:
        level = F.lit(severity) if isinstance(severity, str) else severity
        return F.struct(F.lit(category).alias("category"), level.alias("severity"))

    network = F.when(F.contains(text, F.lit("timeout")), "low").when(
        any_word(text, ["ssl", "certificate"]), "high"
    )
    crashed = F.when(any_word(text, ["crashed", "killed"]), "high").otherwise("medium")
    memory = F.when(kind == "MemoryError", "critical").otherwise("high")
    rules = [
        (
            any_word(text, NETWORK_WORDS) | kind.isin("ConnectionError", "TimeoutError", "SSLError"),
            result("network", network.otherwise("medium")),
        ),
        (status == 429, result("rate_limiting", "high")),
        (status.isin(403, 406), result("detection", "critical")),
        (status.isin(404, 410), result("validation", "low")),
        (status.isin(500, 502, 503, 504), result("system", "medium")),
        (any_word(text, BROWSER_WORDS), result("browser", crashed)),
        (
            any_word(text, PARSING_WORDS)
            | kind.isin("JSONDecodeError", "XMLSyntaxError", "ValueError"),
            result("parsing", "medium"),
        ),
        (
            F.contains(text, F.lit("validation")) | (kind == "ValidationError"),
            result("validation", "low"),
        ),
        (any_word(text, DETECTION_WORDS), result("detection", "critical")),
        (
            any_word(text, SYSTEM_WORDS)
            | kind.isin("MemoryError", "OSError", "IOError", "PermissionError"),
            result("system", memory),
        ),
    ]
    out = F.when(*rules[0])
    for condition, value in rules[1:]:
        out = out.when(condition, value)
    return out.otherwise(result("unknown", "medium"))


def error_id(kind: Column, message: Column, context: Column | None = None) -> Column:
    signature = F.concat(kind, F.lit(":"), message)
    if context is not None:
        signature = F.concat(signature, F.lit(":"), context)
    return F.substring(F.md5(signature.cast("binary")), 1, 12)


def request_risk(message: Column, status: Column) -> Column:
    """Risk a failed request adds to its session."""
    text = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(any_word(text, ["blocked", "captcha", "suspicious", "robot"]), 0.8)
        .when(any_word(text, ["rate limit", "429"]), 0.4)
        .when(status.isin(403, 429), 0.3)
        .otherwise(0.0)
    )


def page_risk(seconds: Column, html: Column, status: Column) -> Column:
    """Risk of a fetched page: fast answer, block words and status code add up."""
    signs = any_word(
        F.lower(F.coalesce(html, F.lit(""))),
        ["blocked", "captcha", "robot", "automation", "suspicious"],
    )
    return (
        F.when(seconds < 0.5, 0.2).otherwise(0.0)
        + F.when(signs, 0.4).otherwise(0.0)
        + F.when(status == 429, 0.6).when(status >= 400, 0.3).otherwise(0.0)
    )


def page_health(status: Column, html: Column, seconds: Column, slow: float = 10.0) -> Column:
    """Struct(level, indicators) of one fetched page."""
    lower = F.lower(F.coalesce(html, F.lit("")))

    def first_sign(label: str, signs) -> Column:
        word = F.coalesce(*[F.when(F.contains(lower, F.lit(s)), F.lit(s)) for s in signs])
        return F.concat(F.lit(f"{label} indicator: "), word)

    indicators = [
        (
            F.when(status == 403, 3).when(status.isin(429, 502, 503, 504), 2),
            F.when(status == 403, "HTTP 403 Forbidden")
            .when(status == 429, "HTTP 429 Rate Limited")
            .when(
                status.isin(502, 503, 504),
                F.concat(F.lit("HTTP "), status.cast("string"), F.lit(" Server Error")),
            ),
        ),
        (F.when(any_word(lower, CAPTCHA_SIGNS), 3), first_sign("CAPTCHA", CAPTCHA_SIGNS)),
        (F.when(any_word(lower, RATE_SIGNS), 2), first_sign("Rate limit", RATE_SIGNS)),
        (F.when(any_word(lower, BOT_SIGNS), 3), first_sign("Bot detection", BOT_SIGNS)),
        (
            F.when(seconds > slow, 1),
            F.when(seconds > slow, F.format_string("High response time: %.2fs", seconds)),
        ),
        (
            F.when(F.length(lower) < 1000, 1),
            F.when(F.length(lower) < 1000, "Suspiciously short content"),
        ),
    ]
    rank = F.coalesce(F.greatest(F.lit(0), *[F.coalesce(r, F.lit(0)) for r, _ in indicators]))
    return F.struct(
        F.element_at(F.array(*map(F.lit, LEVELS)), rank + 1).alias("level"),
        F.array_compact(F.array(*[text for _, text in indicators])).alias("indicators"),
    )
