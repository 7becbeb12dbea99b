"""Values on which a query once left its SQL."""

import duckdb
from pyspark.sql import functions as F

from bazaarlens.functions import scoring
from checks.catalog import load


def test_display_values_round_the_exact_double(spark):
    values = [80.05, 80.15, 80.25, 0.125, 2.675, 1.005, 0.05, 100.0, 1234567.885, None]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(
        F.lit("1").alias("listing_id"), F.lit("t").alias("title"), F.lit("EUR").alias("currency"),
        F.col("x").alias("price"), F.col("x").alias("original_price"), F.col("x").alias("seller_rating"),
        (F.col("x") / 100).alias("data_completeness_score"), F.lit(None).cast("timestamp").alias("scraped_at"),
        *[F.lit("c").alias(c) for c in ("category", "material", "brand", "condition", "seller_name", "url")],
        *[F.lit(1).alias(c) for c in ("image_count", "watchers", "bids", "is_validated")],
    ).select(*scoring.summary_columns())
    found = rows.select("price", "seller_rating", "quality_score").collect()
    assert [tuple(r) for r in found] == [
        (None,) * 3 if v is None else (f"EUR {v:.2f}", f"{v:.1f}%", f"{v / 100 * 100:.1f}%") for v in values
    ]


def test_page_indicators_with_signs_in_the_page(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS page_id, 'u' || i AS url, repeat('<b>$429 Robot Verify</b> 429 blocked ',
      CASE WHEN i % 2 = 0 THEN 1 ELSE 40 END) AS html FROM range(0, 130) r(i)) TO '{tmp_path}/pages.parquet'""")
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    check = load()["page_indicators"]
    found = check.run(spark, str(tmp_path)).select("page_id", "level", "indicators").collect()
    expected = con.execute(f"SELECT page_id, level, indicators FROM ({check.sql})").fetchall()
    assert sorted(tuple(r) for r in found) == sorted(expected)
