"""What the rules compute, and move, for every row."""

import random
import statistics

from bazaarlens.operators.latest import duplicate_rows
from bazaarlens.plans import rules as U
from bazaarlens.sources import derived


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_severities_need_no_list_of_texts_per_row(spark):
    rows = derived.listings(spark, "/root/testdata/sf0.001")
    found = U.row_findings(rows, U.row_checks(rows.columns)).select("rule_id", "severity")
    assert "lambda" not in plan(found) and "filter(" not in plan(found)


def test_outliers_of_many_categories_and_few_large_ones(spark):
    rng, data = random.Random(4), []
    for k in range(260):
        n = 400 if k < 3 else 5 if k < 20 else 12
        data += [(f"c{k}", (k + 1) * rng.uniform(1, 2) * (60 if j == 3 else 1)) for j in range(n)]
    data += [(None, 1e9), ("c0", None), ("c1", -1.0)]
    data = [(f"{i}", c, p) for i, (c, p) in enumerate(data)]
    prices = {}
    for _, c, p in data:
        if c and p and p > 0:
            prices.setdefault(c, []).append(p)
    limit = {c: statistics.fmean(v) + 3 * statistics.pstdev(v) for c, v in prices.items() if len(v) >= 10}
    want = {i for i, c, p in data if c in limit and p and p > limit[c]}
    rows = spark.createDataFrame(data, "listing_id string, category string, price double")
    got = U.price_outliers({"listings": rows})
    assert {r["record_id"] for r in got.collect()} == want and len(want) > 200
    assert "LeftOuter" in plan(got)  # the limits of large categories are met before rows move


def test_duplicates_are_counted_by_code_and_told_apart_by_key(spark):
    data = [(f"u{i // 2}" if i % 5 else f"only{i}", f"{i:05d}") for i in range(900)]
    data += [("hot", f"h{i:05d}") for i in range(300)] + [("", "x"), ("", "y"), (None, "z"), ("u1", None)]
    groups = {}
    for key, row in data:
        if key:
            groups.setdefault(key, []).append(row)
    want = {(k, r, min(filter(None, g)), len(g)) for k, g in groups.items() for r in g
            if r is not None and r != min(filter(None, g))}
    out = duplicate_rows(spark.createDataFrame(data, "url string, listing_id string"))
    assert out.columns == ["url", "listing_id", "duplicate_of", "group_size"]
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert "keys=[_code" in plan(out)
