"""SimHash, components and multiset fingerprints against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from cases import ODD_ROWS, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bazaarlens.llm import components, multiset, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    own = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(own[i : i + 3]) for i in range(len(own) - 2)] if len(own) > 2 else [" ".join(own)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams if own]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints):
    """Smallest reachable id by (id, fingerprint), all pairs compared."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(prints):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(
        ((d, f"{fp:016x}", least.get(find(i))) for i, (d, fp) in enumerate(prints)), key=repr
    )


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB \n\x1cé", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_fingerprint_of_a_text_in_pieces(monkeypatch):
    text = "  ".join(f"w{i % 7}{'x' * (i % 3)}" for i in range(400))
    monkeypatch.setattr(simhash, "_PIECE", 37)
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
    for short in ("", "a", "a b", "a b c", " a  b "):
        assert simhash.fingerprint(short.encode()) == plain_fingerprint(short)


def test_documents(odd, clashing, none, documents):
    for docs in (odd, clashing, documents):
        prints = [(r[0], plain_fingerprint(r[1])) for r in docs.select("doc_id", "text").collect()]
        assert rows(simhash.near_duplicates(docs)) == plain_classes(prints)
    assert rows(simhash.near_duplicates(none)) == []


def test_one_of_each_group_stays(odd, clashing, none, documents):
    assert rows(simhash.one_per_group(none)) == []
    for docs in (odd, clashing, documents):
        kept = simhash.one_per_group(docs)
        assert kept.columns == docs.columns
        classes = plain_classes(
            [(r[0], plain_fingerprint(r[1])) for r in docs.select("doc_id", "text").collect()]
        )
        want = sorted({c for _, _, c in classes if c is not None})
        assert sorted(r[0] for r in kept.collect() if r[0] is not None) == want


def near_cluster(spark, n, seed):
    """``n`` fingerprints close to two centres and as many random ones."""
    pick = random.Random(seed)
    centres = [pick.getrandbits(64), pick.getrandbits(64)]
    prints = {pick.getrandbits(64) for _ in range(n)}
    while len(prints) < 2 * n:
        value = pick.choice(centres)
        for _ in range(pick.randint(0, 4)):
            value ^= 1 << pick.randrange(64)
        prints.add(value)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in prints]
    return spark.createDataFrame(signed, "fp bigint"), sorted(prints)


def roots(links, prints):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in links:
        root[find(a)] = find(b)
    return {frozenset(q for q in prints if find(q) == find(p)) for p in prints}


def test_crowded_cells_lose_no_link(spark):
    distinct, prints = near_cluster(spark, 250, 5)
    every = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 3]
    for crowded in (simhash.CROWDED, 60, 20):
        links = simhash.near_links(distinct, crowded=crowded)
        found = [(a % (1 << 64), b % (1 << 64)) for a, b in links.collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in found)
        assert roots(found, prints) == roots(every, prints)


def test_a_crowded_run_sends_on_a_spanning_forest():
    clique = np.array([0] + [1 << i for i in range(64)], np.uint64)
    a, b = simhash.long_links(clique, 3)
    assert len(a) == len(clique) - 1
    apart = np.array([0x0F << (8 * i) for i in range(8)], np.uint64)
    assert len(simhash.long_links(apart, 3)[0]) == 0


def test_manhattan_distance_is_a_lower_bound():
    values = np.random.default_rng(3).integers(0, 1 << 63, 2000).astype(np.uint64)
    counts = simhash._unary(values)
    plain = np.array([[(int(v) >> 2 * s & 3).bit_count() for s in range(32)] for v in values])
    between = np.bitwise_count(counts[1:] ^ counts[:-1])
    assert (between == np.abs(np.diff(plain, axis=0)).sum(axis=1)).all()
    assert (between <= np.bitwise_count(values[1:] ^ values[:-1])).all()


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    out = rows(components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")))
    assert out == sorted([(i, 0) for i in range(61)] + [(i, 100) for i in range(100, 160)], key=repr)
    empty = spark.createDataFrame([], "a bigint, b bigint")
    assert rows(components.connected_components(empty)) == []


# ------------------------------------------------------------ multiset fingerprints

def spark_hash(*values):
    """Spark's xxhash64 of strings and integers."""
    seed = 42
    for value in values:
        raw = value.encode() if isinstance(value, str) else int(value).to_bytes(4, "little")
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


def plain_print(text):
    equal, counts = [0] * 16, [0] * 96
    for line in (text or "").split("\n"):
        own = WORD.findall(line)
        if not own:
            continue
        digest = hashlib.sha512(line.encode()).digest()
        for i in range(16):
            equal[i] += int.from_bytes(digest[4 * i : 4 * i + 4], "big")
        for pair in zip(own, [*own[1:], None], strict=True):
            value = spark_hash(*[w for w in pair if w is not None])
            counts[(value - (1 << 64) if value >> 63 else value) % 96] += 1
    return [v % (1 << 32) for v in equal], [v % (1 << 16) for v in counts]


def plain_text(print_):
    return "".join(f"{v:08x}" for v in print_[0]) + "".join(f"{v:04x}" for v in print_[1])


def plain_likeness(a, b):
    if a == b:
        return 1.0
    x, y = np.array(a[1], float), np.array(b[1], float)
    if x.std() == 0 or y.std() == 0:
        return 0.0
    return float(np.clip(np.corrcoef(x, y)[0, 1], 0, 1))


def plain_prints(texts):
    def tie(text):
        value = spark_hash(text)
        return value - (1 << 64) if value >> 63 else value

    order = sorted(
        ((d, t or "") for d, t in texts), key=lambda r: tie(r[1])
    )
    order = sorted([r for r in order if r[0] is not None], key=lambda r: r[0], reverse=True) + [
        r for r in order if r[0] is None
    ]
    out = []
    for i, (doc_id, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        n = len(text) // 2
        edited = text[: len(text) - n] + after[:n]
        a, b, c = plain_print(text), plain_print(edited), plain_print(after)
        out.append((
            doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), plain_text(a),
            plain_text(b), round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9),
        ))
    return sorted(out, key=repr)


def rounded(df):
    return rows(df.withColumns({n: F.round(n, 9) for n in ("near_edited", "near_next")}))


def test_multiset_documents(odd, clashing, none, documents):
    want = plain_prints([r[:2] for r in ODD_ROWS])
    for docs in (odd, clashing):
        assert rounded(multiset.fingerprints(docs)) == want
    assert rows(multiset.fingerprints(none)) == []
    alone = multiset.fingerprints(odd.where("doc_id = 10")).first()
    assert alone.near_next == 1.0
    texts = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert rounded(multiset.fingerprints(documents)) == plain_prints(texts)


def test_paragraph_order_does_not_matter_and_edits_are_sums(spark):
    texts = [(1, "a b c\nd e f\ng"), (2, "g\na b c\n\nd e f"), (3, "a b c\ng"), (4, "d e f")]
    docs = spark.createDataFrame(texts, "k bigint, t string")
    prints = {r.k: r for r in multiset.fingerprinted(docs, ["k"], "t").collect()}
    assert prints[1][1:] == prints[2][1:]
    pair = multiset.fingerprinted(docs, ["k"], "t").where("k > 2").groupBy().agg(
        F.max_by("equal", F.expr("k = 3")).alias("a"), F.max_by("equal", F.expr("k = 4")).alias("b"),
    )
    both = pair.select(
        multiset.combined(F.col("a"), F.col("b"), 1, 32).alias("s"), "a", "b"
    ).select("s", "a", multiset.combined(F.col("s"), F.col("b"), -1, 32).alias("back")).first()
    assert list(both.s) == list(prints[1].equal) and both.back == both.a


def test_multiset_plan_has_one_text_shuffle_and_no_python(documents):
    plan = multiset.fingerprints(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("hashpartitioning(_cell") == 1
    assert "Join" not in plan


def test_cells_follow_the_ids(spark):
    """One far id, a repeated id and rows without one: no cell holds much more than its share."""
    ids = [*range(4_000), 10**12, *[-5] * 1_500, *[None] * 1_500]
    docs = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(ids)], "doc_id bigint, text string")
    sizes = [r[0] for r in multiset.in_cells(docs, "doc_id", "text").groupBy("_cell").count().select("count").collect()]
    assert max(sizes) < 12 * multiset.CELL_ROWS and len(sizes) > len(ids) / multiset.CELL_ROWS / 2
    texts = [tuple(r) for r in docs.collect()][3_500:4_200]
    few = spark.createDataFrame(texts, docs.schema)
    assert rounded(multiset.fingerprints(few)) == plain_prints(texts)


def test_text_ids(spark):
    texts = [(i, t) for i, (_, t, *_) in zip(["b", "a", None, "é", "", "b", "10", "9", None, "Z", "aa", "a", "c"], ODD_ROWS)]
    texts += [(f"id{i:03}", f"line {i % 5}\nother {i}") for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id string, text string")
    assert rounded(multiset.fingerprints(docs)) == plain_prints(texts)
    with pytest.raises(TypeError):
        multiset.fingerprints(docs.selectExpr("CAST(1.5 AS double) AS doc_id", "text"))
