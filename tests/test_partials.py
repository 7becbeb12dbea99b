"""Stored daily measures and one-pass bundles against the reports over the rows."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from bazaarlens.plans import partials as P
from bazaarlens.plans.reports import DASHBOARD, REPORTS, ReportRequest, generate
from bazaarlens.sources import schemas

NOW = datetime(2024, 5, 1, 15, 30)


def rows(n=500, seed=3, day=None):
    """Listings of twenty days, a third of them of one seller; nulls in every measured column."""
    rng = random.Random(seed)

    def maybe(value):
        return None if rng.random() < 0.1 else value

    out = []
    for i in range(n):
        at = NOW - timedelta(minutes=rng.randrange(20 * 1440)) if day is None else day
        out.append({
            "listing_id": f"{seed}-{i}", "title": maybe(f"ring {i}"), "price": maybe(rng.randrange(1, 900_000) / 100),
            "category": maybe(rng.choice(["rings", "watches", "other"])),
            "material": maybe(rng.choice(["gold", "silver"])), "brand": maybe(rng.choice(["", "A", "B"])),
            "seller_name": "hot" if i % 3 == 0 else maybe(f"s{rng.randrange(12)}"),
            "seller_rating": maybe(rng.randrange(700, 1001) / 10), "main_stone": maybe(rng.choice(["", "ruby"])),
            "data_completeness_score": maybe(rng.randrange(101) / 100),
            "image_count": maybe(rng.randrange(4)), "watchers": maybe(rng.randrange(9)),
            "views": maybe(rng.randrange(90)), "bids": maybe(rng.randrange(3)),
            "is_validated": rng.random() < 0.8, "scraped_at": maybe(at),
        })
    return out


def table(spark, data):
    kinds = {f.name: f.dataType.typeName() for f in schemas.LISTINGS.fields}

    def fit(name, value):
        return float(value) if kinds[name] == "double" and value is not None else value

    return spark.createDataFrame(
        [tuple(fit(n, r.get(n)) for n in kinds) for r in data], schemas.LISTINGS)


def shown(df):
    cols = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    return [tuple(r) for r in df.select(*cols).collect()]


def same(got, want, names):
    for name in names:
        assert got[name].columns == want[name].columns, name
        assert sorted(map(repr, shown(got[name]))) == sorted(map(repr, shown(want[name]))), name


@pytest.fixture(scope="module")
def listings(spark):
    return table(spark, rows()).cache()


@pytest.mark.parametrize("kinds", [DASHBOARD, ["price_analysis", "seller_analysis", "market_insights"]])
def test_one_pass_bundle_equals_each_report(spark, listings, kinds):
    request = ReportRequest(as_of=NOW, time_range="month")
    made = P.one_pass_bundle(kinds, listings, request)
    for kind in kinds:
        want = generate(kind, listings, request)
        assert list(made[kind]) == list(want) == list(REPORTS[kind])
        same(made[kind], want, [n for n in want if n in P.MERGED])


def test_summed_parts_scan_the_rows_once(spark, listings, tmp_path):
    path = str(tmp_path / "rows")
    listings.write.parquet(path)
    stored = spark.read.parquet(path)
    plan = P.partials(stored)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Expand") >= 1
    made = P.one_pass_bundle(["summary"], stored, ReportRequest(as_of=NOW))["summary"]
    assert path not in made["overview"]._jdf.queryExecution().executedPlan().toString()


def test_stored_days_serve_any_range(spark, listings, tmp_path):
    store = P.DailyPartials(spark, str(tmp_path / "days"))
    assert store.stored_days() is None
    names = ["overview", "price_distribution", "top_materials"]
    everything = ReportRequest(as_of=NOW)
    same(store.report("summary", listings, everything), generate("summary", listings, everything), names)
    first, last = date(2024, 4, 14), date(2024, 4, 28)  # rows lie before and after
    store.refresh(listings, first, last)
    assert store.stored_days() == (first, last)
    requests = [
        everything,
        ReportRequest(as_of=NOW, time_range="week"),  # begins within a day
        ReportRequest(as_of=NOW, time_range="today"),  # no stored day
        ReportRequest(as_of=NOW, time_range="custom", start=datetime(2024, 4, 16, 7),
                      end=datetime(2024, 4, 20, 23, 59, 59), categories=("rings", "other")),
        ReportRequest(as_of=NOW, time_range="custom", start=datetime(2024, 4, 16),
                      end=datetime(2024, 4, 16, 23, 59, 59, 999999)),
    ]
    for request in requests:
        same(store.report("summary", listings, request), generate("summary", listings, request), names)
    request = requests[1]
    same(store.report("category_analysis", listings, request),
         generate("category_analysis", listings, request), ["category_summary"])
    scan = store.report("summary", listings, requests[4])["overview"]
    assert "PartitionFilters: [isnotnull(date" in scan._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="days and categories"):
        store.report("summary", listings, ReportRequest(as_of=NOW, sellers=("hot",)))


def test_refreshed_days_replace_the_stored_ones(spark, listings, tmp_path):
    store = P.DailyPartials(spark, str(tmp_path / "days"))
    store.refresh(listings, date(2024, 4, 10), date(2024, 5, 1))
    day = date(2024, 4, 20)
    late = listings.unionByName(table(spark, rows(40, 9, datetime(2024, 4, 20, 12))))
    emptied = late.where("scraped_at IS NULL OR to_date(scraped_at) <> DATE '2024-04-21'")
    request = ReportRequest(as_of=NOW)
    for _ in range(2):  # a repeated refresh changes nothing
        store.refresh(emptied, day, day + timedelta(days=1))
    same(store.report("trend_analysis", emptied, request), generate("trend_analysis", emptied, request),
         ["daily_trends"])
    with pytest.raises(ValueError, match="do not touch"):
        store.refresh(listings, date(2024, 6, 1), date(2024, 6, 2))
    with pytest.raises(ValueError, match="after the last"):
        store.refresh(listings, day, day - timedelta(days=1))


def test_a_bundle_sums_only_what_its_reports_ask_for(spark):
    assert P.grains_of(["seller_analysis"]) == {"seller": False, "rating": False}
    assert P.grains_of(["seller_analysis", "trend_analysis"])["seller"]
    data = table(spark, rows())
    merged = P.partials(data, P.grains_of(["seller_analysis"]))
    assert merged.where("date IS NOT NULL").count() == 0
    assert {r[0] for r in merged.select("grain").distinct().collect()} == {"seller", "rating"}
    # twenty days of thirteen sellers, no seller or none: a row per band, not per day
    assert merged.where("grain = 'seller'").count() <= 4 * 14 * 6 < P.partials(data).where("grain = 'seller'").count()
    sums = merged.where("grain = 'seller'").agg(F.sum("rows"), F.sum("price_n")).first()
    assert tuple(sums) == (data.count(), data.where("price IS NOT NULL").count())
