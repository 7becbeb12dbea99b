"""Request and error logs as batch jobs.

Windowed shapes are shared with the streaming package: the same functions take
a batch or a streaming DataFrame.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bazaarlens.functions import errors as err
from bazaarlens.operators.trailing import trailing_counts


# Classification ---------------------------------------------------------------------

def classified(log: DataFrame) -> DataFrame:
    """Failed requests with class, severity, rank and error id."""
    failed = log.where("NOT success")
    kind, message = F.col("error_type"), F.col("error_message")
    retries = F.col("retry_count") if "retry_count" in log.columns else F.lit(0)
    out = failed.withColumn("category", err.error_class(kind, message))
    out = out.withColumn("severity", err.error_severity(kind, F.col("category"), retries))
    request = err.request_error(kind, message, F.col("status_code"))
    return out.withColumns(
        {
            "severity_rank": err.severity_rank(F.col("severity")),
            "error_id": err.error_id(kind, message),
            "request_category": request["category"],
            "request_severity": request["severity"],
        }
    )


# Recurring errors ------------------------------------------------------------------

def _pattern_measures(minutes: int) -> list[Column]:
    return [
        F.count("*").alias("count"),
        (F.count("*") / F.lit(float(minutes))).alias("frequency"),
        err.severity_name(F.max("severity_rank")).alias("severity"),
        F.min("timestamp").alias("first_occurrence"),
        F.max("timestamp").alias("last_occurrence"),
    ]


def recurring_errors(
    errors: DataFrame, as_of: datetime, minutes: int = 60, threshold: int = 5
) -> DataFrame:
    """Error types and classes seen at least ``threshold`` times before ``as_of``."""
    start = F.lit(as_of - timedelta(minutes=minutes)).cast("timestamp")
    recent = errors.where(
        (F.col("timestamp") > start) & (F.col("timestamp") <= F.lit(as_of).cast("timestamp"))
    )
    return (
        recent.groupBy("error_type", "category")
        .agg(*_pattern_measures(minutes))
        .where(F.col("count") >= threshold)
    )


def error_windows(
    errors: DataFrame, minutes: int = 60, slide: int | None = None, threshold: int = 5
) -> DataFrame:
    """Recurring errors of every (sliding) window; batch or streaming input."""
    size = f"{minutes} minutes"
    window = F.window("timestamp", size, f"{slide} minutes" if slide else size)
    return (
        errors.groupBy(window.alias("w"), "error_type", "category")
        .agg(*_pattern_measures(minutes))
        .where(F.col("count") >= threshold)
        .select(
            F.col("w.start").alias("window_start"),
            "error_type", "category", "count", "frequency", "severity",
            "first_occurrence", "last_occurrence",
        )
    )


def affected(errors: DataFrame, minutes: int = 60, threshold: int = 5) -> DataFrame:
    """Operations and addresses hit by each recurring error, one row each.

    The list is long form: a busy window may touch any number of addresses.
    """
    keyed = errors.withColumn(
        "window_start", F.window("timestamp", f"{minutes} minutes")["start"]
    )
    keys = ["window_start", "error_type", "category"]
    targets = F.array(
        F.struct(F.lit("operation").alias("kind"), F.col("operation").alias("target")),
        F.struct(F.lit("url").alias("kind"), F.col("url").alias("target")),
    )
    seen = (
        keyed.select(*keys, F.explode(targets).alias("t"))
        .where("t.target IS NOT NULL")
        .groupBy(*keys, "t.kind", "t.target")
        .agg(F.count("*").alias("errors"))
    )
    busy = keyed.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= threshold)
    return seen.join(busy.select(*keys), keys)


def frequent_errors(patterns: DataFrame, per_minute: float = 2.0) -> DataFrame:
    """High-priority alerts of error windows above the rate."""
    # Alert sentences.
    return patterns.where(F.col("frequency") > per_minute).select(
        *[c for c in ("window_start",) if c in patterns.columns],
        F.lit("high").alias("priority"),
        F.concat(F.lit("High frequency "), "category", F.lit(" errors")).alias("issue"),
        F.concat(
            F.lit("Investigate "), "error_type", F.lit(" in "), "category", F.lit(" operations")
        ).alias("recommendation"),
        "frequency",
    )


# Rates -----------------------------------------------------------------------------

def request_windows(log: DataFrame, size: str, limit: int | None = None) -> DataFrame:
    """Requests per tumbling window and whether the limit is reached."""
    out = log.groupBy(F.window("timestamp", size).alias("w")).agg(F.count("*").alias("requests"))
    out = out.select(F.col("w.start").alias("window_start"), "requests")
    if limit is not None:
        out = out.withColumn("limit_reached", F.col("requests") >= limit)
    return out


def error_rate_windows(log: DataFrame, size="10 minutes", slide="1 minute") -> DataFrame:
    failed = (~F.col("success")).cast("double")
    return (
        log.groupBy(F.window("timestamp", size, slide).alias("w"))
        .agg(F.count("*").alias("requests"), F.avg(failed).alias("error_rate"))
        .select(F.col("w.start").alias("window_start"), "requests", "error_rate")
    )


def trailing_rates(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Requests of the trailing minute and hour at every logged moment."""
    one = {"requests": F.lit(1)}
    join_on = [*(keys or []), "timestamp"]
    minute = trailing_counts(log, 60, one, keys).withColumnRenamed("requests", "last_minute")
    hour = trailing_counts(log, 3600, one, keys).withColumnRenamed("requests", "last_hour")
    return minute.join(hour, join_on)


def trailing_error_rate(
    log: DataFrame, minutes: int = 10, keys: list[str] | None = None
) -> DataFrame:
    failed = (~F.col("success")).cast("int")
    out = trailing_counts(log, minutes * 60, {"requests": F.lit(1), "errors": failed}, keys)
    return out.withColumn("error_rate", F.try_divide("errors", "requests"))


# Shares and impact ---------------------------------------------------------------------

def last_hour_errors(errors: DataFrame, as_of: datetime) -> DataFrame:
    """Errors of the hour before ``as_of`` by category and by severity."""
    start = F.lit(as_of - timedelta(hours=1)).cast("timestamp")
    pairs = F.array(
        F.struct(F.lit("category").alias("kind"), F.col("category").alias("name")),
        F.struct(F.lit("severity").alias("kind"), F.col("severity").alias("name")),
    )
    return (
        errors.where((F.col("timestamp") > start) & (F.col("timestamp") <= F.lit(as_of)))
        .select(F.explode(pairs).alias("p"))
        .groupBy("p.kind", "p.name")
        .agg(F.count("*").alias("errors"))
    )


def hourly_errors(errors: DataFrame) -> DataFrame:
    """Errors per clock hour, category and severity; batch or streaming input."""
    return (
        errors.groupBy(F.window("timestamp", "1 hour").alias("w"), "category", "severity")
        .agg(F.count("*").alias("errors"))
        .select(F.col("w.start").alias("window_start"), "category", "severity", "errors")
    )


def error_impact(errors: DataFrame) -> DataFrame:
    """Count, share of all errors and time lost per category."""
    counts = errors.groupBy("category").agg(
        F.count("*").alias("count"),
        F.avg("response_time").alias("avg_handling_time"),
        F.sum("response_time").alias("total_impact_time"),
    )
    total = counts.agg(F.sum("count").alias("t")).scalar()
    return counts.withColumn("error_share", F.col("count") / total)


def recovery_rates(attempts: DataFrame) -> DataFrame:
    """Share of recoveries per strategy with advice below one half."""
    counts = attempts.groupBy("strategy").agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("t")).scalar()
    rate = F.col("count") / total
    # Advice sentence.
    return counts.select(
        "strategy",
        "count",
        rate.alias("success_rate"),
        F.when(
            rate < 0.5,
            F.concat(F.lit("Review and improve "), "strategy", F.lit(" recovery strategy")),
        ).alias("recommendation"),
    )


# Page health --------------------------------------------------------------------------

def page_health(pages: DataFrame) -> DataFrame:
    """Health level and indicators of every fetched page."""
    health = err.page_health(F.col("status_code"), F.col("html"), F.col("response_time"))
    return pages.withColumn("_h", health).select(
        *[c for c in pages.columns if c != "html"],
        F.col("_h.level").alias("level"),
        F.col("_h.indicators").alias("indicators"),
    )


def recent_levels(health: DataFrame, time: str = "timestamp", rows: int = 50) -> DataFrame:
    """Level distribution of the newest pages."""
    tie = [c for c in ("page_id", "request_id", "url") if c in health.columns]
    newest = health.orderBy(F.desc(time), *tie).limit(rows)
    return newest.groupBy("level").agg(F.count("*").alias("pages"))


# Sessions ------------------------------------------------------------------------------

def session_summary(log: DataFrame, key: str = "session_id") -> DataFrame:
    """Requests, successes, rate, runtime and throughput per session id."""
    seconds = (F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 1e6
    return log.groupBy(key).agg(
        F.count("*").alias("requests"),
        F.count_if("success").alias("succeeded"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.avg("response_time").alias("avg_response_time"),
        F.min("timestamp").alias("started_at"),
        F.max("timestamp").alias("ended_at"),
        seconds.alias("runtime_seconds"),
        F.try_divide(F.count_if("success") * F.lit(60.0), seconds).alias("per_minute"),
    )


def throughput(log: DataFrame) -> DataFrame:
    """Runtime and successes per minute of the whole log."""
    seconds = (F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 1e6
    return log.agg(
        F.count("*").alias("requests"),
        F.count_if("success").alias("succeeded"),
        seconds.alias("runtime_seconds"),
        F.try_divide(F.count_if("success") * F.lit(60.0), seconds).alias("per_minute"),
    )


def gap_sessions(log: DataFrame, key: str, gap_minutes: int = 30) -> DataFrame:
    """Sessions of a log without session ids: a new one after a long pause.

    Requests are first summed per key and minute, so the ordered step sees at
    most one row per minute whatever the traffic of a key.
    """
    minute = F.date_trunc("minute", "timestamp")
    packed = log.groupBy(key, minute.alias("_m")).agg(
        F.min("timestamp").alias("_from"),
        F.max("timestamp").alias("_to"),
        F.count("*").alias("_n"),
        F.count_if("success").alias("_ok"),
    )
    order = Window.partitionBy(key).orderBy("_m")
    pause = F.unix_micros("_from") - F.unix_micros(F.lag("_to").over(order))
    starts = packed.withColumn(
        "_new", F.coalesce(pause >= gap_minutes * 60_000_000, F.lit(True)).cast("int")
    )
    numbered = starts.withColumn("_s", F.sum("_new").over(order))
    return (
        numbered.groupBy(key, "_s")
        .agg(
            F.min("_from").alias("started_at"),
            F.max("_to").alias("ended_at"),
            F.sum("_n").alias("requests"),
            F.sum("_ok").alias("succeeded"),
        )
        .drop("_s")
    )
