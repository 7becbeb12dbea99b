"""Store statistics, table profiles, status figures and rule effectiveness."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.operators.filters import since_days
from bazaarlens.plans.rules import table_rows


def store_figures(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: rows per table, mean score and price range of priced listings."""
    priced = F.when(F.col("price") > 0, F.col("price"))
    facts = tables["listings"].agg(
        F.count("*").alias("total_listings"),
        F.coalesce(F.avg("data_completeness_score"), F.lit(0.0)).alias("avg_quality_score"),
        F.coalesce(F.min(priced), F.lit(0.0)).alias("min_price"),
        F.coalesce(F.max(priced), F.lit(0.0)).alias("max_price"),
    )
    for name in ("images", "specifications", "sessions"):
        if name in tables:
            rows = tables[name].agg(F.count("*").alias("c")).scalar()
            facts = facts.withColumn(f"total_{name}", rows)
    return facts


def store_breakdown(listings: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Counts by category, by material and by day of the last week, long form."""
    recent = F.when(since_days(as_of, days), F.to_date("scraped_at").cast("string"))
    pairs = F.array(
        F.struct(F.lit("category").alias("kind"), F.col("category").alias("name")),
        F.struct(F.lit("material").alias("kind"), F.col("material").alias("name")),
        F.struct(F.lit("day").alias("kind"), recent.alias("name")),
    )
    return (
        listings.select(F.explode(pairs).alias("p"))
        .where("p.kind <> 'day' OR p.name IS NOT NULL")
        .groupBy("p.kind", "p.name")
        .agg(F.count("*").alias("listings"))
    )


def category_shares(listings: DataFrame) -> DataFrame:
    """Display name, count and share of all listings per category."""
    counts = listings.groupBy("category").agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("t")).scalar()
    return counts.select(
        "category",
        F.initcap(F.replace("category", F.lit("_"), F.lit(" "))).alias("name"),
        "count",
        F.round(F.col("count") * 100.0 / total, 1).alias("percentage"),
    )


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    return table_rows(tables)


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, number of columns and column names per table."""
    parts = [
        df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("table"),
            "rows",
            F.lit(len(df.columns)).alias("columns"),
            F.lit(", ".join(df.columns)).alias("column_names"),
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def column_profile(df: DataFrame) -> DataFrame:
    """Set values, smallest and largest value of every column, one pass."""
    facts = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.count(c).alias("filled"),
                    F.min(c).cast("string").alias("smallest"),
                    F.max(c).cast("string").alias("largest"),
                )
                for c, kind in df.dtypes
                if not kind.startswith(("array", "map", "struct"))
            ]
        ).alias("p")
    )
    return facts.select(F.explode("p").alias("p")).select("p.*")


def collection_status(listings: DataFrame, sessions: DataFrame, as_of: datetime) -> DataFrame:
    running = sessions.agg(F.count_if(F.col("status") == "running").alias("r")).scalar()
    return listings.agg(
        F.max("scraped_at").alias("last_scrape"),
        F.count("*").alias("listings"),
        F.count_if(since_days(as_of, 1)).alias("last_24h"),
    ).withColumn("running_sessions", running)


def batch_quality(scored: DataFrame, score: str = "quality_score") -> DataFrame:
    return scored.agg(F.coalesce(F.avg(score), F.lit(0.0)).alias("batch_quality"))


# Extraction-rule effectiveness --------------------------------------------------------

def rule_effectiveness(attempts: DataFrame) -> DataFrame:
    """Attempts, successes, success rate and mean seconds per extraction rule."""
    return attempts.groupBy("rule_type", "rule_name").agg(
        F.count("*").alias("attempts"),
        F.count_if("success").alias("successes"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.avg("seconds").alias("avg_seconds"),
    )


def effective_rules(attempts: DataFrame, min_rate: float = 0.8, max_seconds: float = 1.0):
    return rule_effectiveness(attempts).where(
        (F.col("success_rate") >= min_rate) & (F.col("avg_seconds") <= max_seconds)
    )


def weak_rules(attempts: DataFrame, below: float = 0.5) -> DataFrame:
    rate = F.col("success_rate")
    return rule_effectiveness(attempts).where((rate > 0) & (rate < below))


def rules_per_type(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("rule_type").agg(
        F.count_distinct("rule_name").alias("rules"), F.count("*").alias("attempts")
    )
