"""Operators against brute force, with one key holding a third of the rows."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaarlens.operators import folds, joins, neighbours
from bazaarlens.operators.latest import duplicate_rows, latest_per_key, upsert
from bazaarlens.operators.quantiles import exact_quantiles
from bazaarlens.operators.trailing import previous_values, trailing_counts

START = datetime(2024, 1, 1)


def skewed(n=3000, seed=1):
    rng = random.Random(seed)
    return [("hot" if i % 3 == 0 else f"k{rng.randrange(200)}", i, rng.randrange(100)) for i in range(n)]


@pytest.fixture(scope="module")
def many(spark):
    return spark.createDataFrame(skewed(), "k string, i long, v long").cache()


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join(spark, many, how):
    lookup = spark.createDataFrame(
        [("hot", "a"), ("hot", "b"), *[(f"k{j}", "c") for j in range(0, 200, 2)]], "k string, x string")
    got = joins.salted_join(many, lookup, ["k"], ["i"], how, salts=7)
    want = many.join(lookup, "k", how)
    assert sorted(map(str, got.select("k", "i", "x").collect())) == sorted(
        map(str, want.select("k", "i", "x").collect()))
    hot = [r[0] for r in joins.hot_keys(many, ["k"]).collect()]
    assert "hot" in hot and len(hot) < joins.HOT_PARTS
    assert [r[0] for r in joins.hot_keys(many, ["k"], parts=4).collect()] == ["hot"]


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_children_join(spark, how):
    listings = spark.createDataFrame([("hot", 1), ("b", 2), ("c", 3)], "listing_id string, p long")
    images = spark.createDataFrame(
        [("hot", f"i{n}") for n in range(50)] + [("b", "j"), ("gone", "z"), (None, "n")],
        "listing_id string, image_id string")
    got = joins.join_children(listings, images, how)
    want = listings.join(images, "listing_id", how)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_session_interval_ends(spark):
    day = datetime(2024, 3, 5)
    listings = spark.createDataFrame(
        [("a", day), ("b", day + timedelta(days=2)), ("c", day + timedelta(days=2, seconds=1)),
         ("d", day + timedelta(days=9)), ("e", None)], "listing_id string, scraped_at timestamp")
    sessions = spark.createDataFrame(
        [("s1", day, day + timedelta(days=2)), ("s2", day + timedelta(days=8), None),
         ("s3", day + timedelta(days=20), day + timedelta(days=21))],
        "session_id string, started_at timestamp, completed_at timestamp")
    as_of = day + timedelta(days=10)

    def pairs(how):
        out = joins.session_join(listings, sessions, as_of, how, session_columns=["session_id"])
        return sorted((r["listing_id"] or "", r["session_id"] or "") for r in out.collect())

    assert pairs("inner") == [("a", "s1"), ("b", "s1"), ("d", "s2")]
    assert pairs("left") == [("a", "s1"), ("b", "s1"), ("c", ""), ("d", "s2"), ("e", "")]
    assert ("", "s3") in pairs("full")


@pytest.mark.parametrize("slices", [1, 2, 7, 256])
def test_session_join_of_any_length(spark, slices):
    """A third of the rows at one moment, sessions of no length, of ten years and never closed."""
    rng = random.Random(5)
    times = [START + timedelta(minutes=5000 if i % 3 == 0 else rng.randrange(10_000)) for i in range(300)]
    listings = spark.createDataFrame(
        [*[(i, t) for i, t in enumerate(times)], (300, None)], "listing_id long, scraped_at timestamp")
    spans = [(START + timedelta(minutes=m), START + timedelta(minutes=m + rng.choice([0, 3, 900])))
             for m in (rng.randrange(10_000) for _ in range(40))]
    spans += [(START - timedelta(days=5), START + timedelta(days=3650)), (START + timedelta(days=1), None),
              (START + timedelta(days=90), START + timedelta(days=91)),
              (START + timedelta(days=2), START + timedelta(days=1))]
    sessions = spark.createDataFrame(
        [(f"s{i}", a, b) for i, (a, b) in enumerate(spans)],
        "session_id string, started_at timestamp, completed_at timestamp")
    as_of = START + timedelta(days=4)
    met = {(i, f"s{j}") for i, t in enumerate(times) for j, (a, b) in enumerate(spans)
           if a <= t <= (b or as_of)}
    lone = {(i, None) for i in range(301)} - {(i, None) for i, _ in met}
    idle = {(None, f"s{j}") for j in range(len(spans))} - {(None, s) for _, s in met}
    for how, want in [("inner", met), ("left", met | lone), ("right", met | idle),
                      ("full", met | lone | idle)]:
        got = joins.session_join(listings, sessions, as_of, how, session_columns=["session_id"],
                                 slices=slices).select("listing_id", "session_id").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_long_session_costs_rows_by_slices(spark):
    """Borders lie at the rows' own times; a span of ten years is repeated once for each range."""
    rows = spark.createDataFrame([(START + timedelta(days=i),) for i in range(1000)], "t timestamp")
    borders = joins.time_borders(rows, "t", 8)
    assert len(borders.first()[0]) == 7
    sliced = joins.with_slice(rows, "_s", F.col("t"), borders.scalar(), 8).groupBy("_s").count().collect()
    assert len(sliced) == 8 and max(r["count"] for r in sliced) <= 130
    none = joins.time_borders(rows.where("false"), "t", 8).scalar()
    assert {r["_s"] for r in joins.with_slice(rows, "_s", F.col("t"), none, 8).collect()} == {0}


def test_duplicates_and_latest(spark, many):
    rows = many.select(F.col("k").alias("url"), F.format_string("%05d", "i").alias("listing_id"), "v")
    found = {r["listing_id"]: (r["duplicate_of"], r["group_size"]) for r in duplicate_rows(rows).collect()}
    groups = {}
    for k, i, _ in skewed():
        groups.setdefault(k, []).append(f"{i:05d}")
    want = {i: (min(g), len(g)) for g in groups.values() if len(g) > 1 for i in g if i != min(g)}
    assert found == want
    latest = {r["url"]: r["listing_id"] for r in latest_per_key(rows, ["url"], ["listing_id"]).collect()}
    assert latest == {k: max(g) for k, g in groups.items()}


def test_upsert_keys(spark):
    schema = "listing_id string, url string, price double, scraped_at timestamp"
    old = spark.createDataFrame([("1", "u1", 1.0, START), ("2", "u2", 2.0, START), ("4", None, 4.0, START)], schema)
    new = spark.createDataFrame(
        [("1", "u1", 9.0, START), ("3", "u2", 3.0, START + timedelta(1)), ("5", None, 5.0, START)], schema)
    got = {r["listing_id"]: r["price"] for r in upsert(old, new).collect()}
    assert got == {"1": 9.0, "3": 3.0, "4": 4.0, "5": 5.0}


def test_quantiles_of_large_group(spark):
    rng = np.random.default_rng(5)
    hot = np.round(rng.lognormal(5, 2, 30_000), 2)
    small = np.array([1.0, 2.0, 10.0])
    same = np.full(500, 7.0)
    rows = [("hot", float(x)) for x in hot] + [("small", float(x)) for x in small]
    rows += [("same", float(x)) for x in same] + [(None, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    wanted = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q9": 0.999, "q10": 1.0}
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", wanted).collect()}
    for name, data in {"hot": hot, "small": small, "same": same, None: np.array([3.0])}.items():
        for label, q in wanted.items():
            assert got[name][label] == pytest.approx(float(np.quantile(data, q)), rel=1e-12)


def test_trailing_counts_are_strict(spark):
    times = [0, 30, 60, 60, 61, 119, 120, 600]
    log = spark.createDataFrame(
        [("a", START + timedelta(seconds=s)) for s in times], "k string, timestamp timestamp")
    got = trailing_counts(log, 60, {"n": F.lit(1)}, ["k"]).orderBy("timestamp").collect()
    want = [sum(1 for u in times if t - 60 < u <= t) for t in sorted(set(times))]
    assert [r["n"] for r in got] == want


@pytest.mark.parametrize("keys", [["k"], []])
def test_trailing_counts_of_random_moments(spark, keys):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", None]), START + timedelta(microseconds=rng.randrange(3 * 10**8)))
            for _ in range(600)]
    rows += [("a", START), ("a", START + timedelta(seconds=7)), ("a", START + timedelta(seconds=14))]
    log = spark.createDataFrame(rows, "k string, timestamp timestamp").repartition(5)
    got = {tuple(r)[:-1]: r["n"] for r in trailing_counts(log, 7, {"n": F.lit(1)}, keys).collect()}
    want = {}
    for k, t in rows:
        own = [u for j, u in rows if (j == k or not keys) and t - timedelta(seconds=7) < u <= t]
        want[(k, t) if keys else (t,)] = len(own)
    assert got == want


def test_a_dense_cluster_of_hashes_lists_no_pairs(spark):
    codes = {0}
    rng = random.Random(2)
    while len(codes) < 20_000:
        codes.add(sum(1 << b for b in rng.sample(range(40), rng.randint(1, 4))))
    df = spark.createDataFrame(list(enumerate(sorted(codes))), "image_id long, hash long")
    out = neighbours.near_duplicates(df, 5)
    assert out.count() == 20_000 and out.where("duplicate_of IS NULL").count() == 1


def test_previous_values_cross_months(spark):
    rows = [("k", START + timedelta(days=13 * i), f"{i:03d}", float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "url string, scraped_at timestamp, listing_id string, price double")
    out = previous_values(df, "url", ["scraped_at", "listing_id"], ["price"]).orderBy("listing_id")
    assert [r["prev_price"] for r in out.collect()] == [None, *[float(i) for i in range(19)]]


def test_folds_match_loop(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"s{i % 7}", START + timedelta(seconds=rng.randrange(500)), i,
             rng.random() < 0.6, rng.choice([0.0, 0.3, 0.4, 0.8])) for i in range(2000)]
    log = spark.createDataFrame(
        rows, "session_id string, timestamp timestamp, request_id long, success boolean, risk double"
    ).repartition(6)
    weighted, decaying = {}, {}
    for k, _, _, ok, x in sorted(rows, key=lambda r: (r[1], r[2])):
        weighted[k] = weighted.get(k, 0.0) * 0.8 + x * 0.2
        s = decaying.get(k, 0.0)
        decaying[k] = s * 0.95 if ok else min(1.0, s + x)
    got = {r[0]: r["risk"] for r in folds.weighted_risk(log, F.col("risk")).collect()}
    assert got == pytest.approx(weighted)
    got = {r[0]: r["risk"] for r in folds.decaying_risk(log, F.col("success"), F.col("risk")).collect()}
    assert got == pytest.approx(decaying)


@pytest.mark.parametrize("crowded", [2000, 3])
def test_near_duplicates_brute_force(spark, crowded, monkeypatch):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(40)]
    codes = list(base)
    for code in base:
        for flips in (1, 5, 6):
            codes.append(code ^ sum(1 << b for b in rng.sample(range(64), flips)))
    codes += [base[0]] * 60 + [base[0] ^ (1 << b) for b in range(30)]
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame(list(enumerate(signed)), "image_id long, hash long")
    monkeypatch.setattr(
        neighbours.closest_earlier, "__defaults__", (crowded,))
    got = {r["image_id"]: r["duplicate_of"] for r in neighbours.near_duplicates(df, 5, 2).collect()}
    want = {
        i: next((j for j in range(i) if (codes[i] ^ codes[j]).bit_count() <= 5), None)
        for i in range(len(codes))
    }
    assert got == want


def plain_kept(images, threshold):
    """The loop: keep an image unless one that was kept is near it."""
    kept, out = [], {}
    for i, code in images:
        near = next((j for j, other in kept if (code ^ other).bit_count() <= threshold), None)
        out[i] = near
        if near is None:
            kept.append((i, code))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_keep_first_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    codes = [rng.getrandbits(64) for _ in range(12)]
    while len(codes) < 260:  # walks from random places: chains whose middles are dropped
        codes.append(rng.choice(codes[-40:]) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    rng.shuffle(codes)
    signed = [(i, c - (1 << 64) if c >> 63 else c) for i, c in enumerate(codes)] + [(999, None)]
    df = spark.createDataFrame(signed, "image_id long, hash long")
    want = plain_kept(list(enumerate(codes)), 5) | {999: None}
    out = neighbours.keep_first(df, 5, 2).collect()
    assert {r["image_id"]: r["duplicate_of"] for r in out} == want
    for r in out:
        if r["duplicate_of"] is not None:
            assert r["distance"] == (codes[r["image_id"]] ^ codes[r["duplicate_of"]]).bit_count() <= 5


def test_keep_first_rounds_are_few(spark, monkeypatch):
    """A path of 24 hashes, each near the next only: every round keeps one and drops one at each
    front; random orders have many fronts."""
    path = [(1 << 5 * k) - 1 if 5 * k < 64 else 0 for k in range(12)]
    codes = path + [(0xABC << 52) ^ p for p in path]
    order = list(range(24))
    random.Random(5).shuffle(order)
    signed = [(n, codes[k] - (1 << 64) if codes[k] >> 63 else codes[k]) for n, k in enumerate(order)]
    calls, search = [], neighbours.closest_earlier
    monkeypatch.setattr(neighbours, "closest_earlier", lambda *a: calls.append(1) or search(*a))
    out = neighbours.keep_first(spark.createDataFrame(signed, "image_id long, hash long"), 5, 2)
    assert {r["image_id"]: r["duplicate_of"] for r in out.collect()} == plain_kept(
        [(n, codes[k]) for n, k in enumerate(order)], 5)
    assert len(calls) <= 11  # at most five rounds of two searches, and the last one
