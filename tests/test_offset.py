"""An offset alone must not bring every row to one task."""

from pyspark.sql import functions as F

from bazaarlens.plans.query import ListingQuery


def test_offset_alone_keeps_the_rows_spread(spark):
    rows = spark.range(0, 5000, 1, 6).select(
        F.col("id").cast("string").alias("listing_id"), (F.col("id") * 7 % 11).cast("double").alias("price"))
    ordered = [r[0] for r in rows.orderBy("price", "listing_id").collect()]
    query = ListingQuery(rows).select("listing_id").order_by_price().order_by("listing_id")
    for skipped in (1, 1700, 4999, 5000, 6000):
        out = query.offset(skipped).build()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "GlobalLimit" not in plan and "CollectLimit" not in plan
        assert [r[0] for r in out.collect()] == ordered[skipped:]
    assert ListingQuery(rows).select("listing_id").offset(4000).build().distinct().count() == 1000
    assert [r[0] for r in query.offset(40).limit(3).build().collect()] == ordered[40:43]
