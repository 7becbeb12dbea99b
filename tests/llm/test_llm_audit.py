"""Toxicity, filter audit and bit-plane clustering: brute force, held-out rows, odd rows."""

import hashlib
import math
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from cases import ODD_ROWS, SCHEMA, SF, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from bazaarlens.llm import audit, planes, queries, toxicity

MEDIUM = "/root/testdata/sf0.01"


# ---------------------------------------------------------------------- toxicity

def plain_bucket(code, kind):
    m = (1 << 64) - 1
    x = (code + kind * 0xD6E8FEB86659FD93) & m
    x ^= x >> 32
    x = x * 0xBF58476D1CE4E5B9 & m
    x ^= x >> 29
    return (x * 0x94D049BB133111EB & m) >> (64 - toxicity.BITS)


def plain_features(text):
    """Coordinates of a text, word by word."""
    def code(w):
        return zlib.crc32(w.encode()) | zlib.crc32(w.encode(), 0x5BD1E995) << 32

    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    out = {plain_bucket(code(w), 1) for w in words}
    out |= {plain_bucket(code(w[:k]), 16 + k) for w in words for k in (4, 5, 6, 7) if len(w) > k}
    for kind, step in ((2, 1), (3, 2)):
        for a, b in zip(words, words[step:]):
            out.add(plain_bucket((code(a) * 0x9E3779B97F4A7C15 + code(b) * 0xC2B2AE3D27D4EB4F) % (1 << 64), kind))
    return out


def plain_fit(docs, labels, visits):
    """FTRL-proximal over dictionaries, one coordinate at a time; ``visits``: rows in order."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * toxicity.L1) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for row in visits:
        own = docs[row]
        w = {i: weight(i) for i in own}
        g = 1 / (1 + math.exp(-sum(w.values()))) - labels[row]
        for i in own:
            before, after = n.get(i, 0.0), n.get(i, 0.0) + g * g
            z[i] = z.get(i, 0.0) + g - (math.sqrt(after) - math.sqrt(before)) / toxicity.ALPHA * w[i]
            n[i] = after
    return {i: weight(i) for i in z if weight(i)}


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(alphabet="abcdé 1_ßÜ", max_size=60), min_size=1, max_size=4))
def test_features_of_texts(texts):
    found = [set() for _ in texts]
    for row, place in toxicity.features(texts, toxicity.Vocabulary()):
        for r, p in zip(row, place):
            found[r].add(int(p))
    assert found == [plain_features(t) for t in texts]


def test_features_do_not_depend_on_pieces(monkeypatch):
    pick = random.Random(4)
    text = " ".join("".join(pick.choice("abcdefg") for _ in range(pick.randint(1, 9))) for _ in range(3_000))
    monkeypatch.setattr(toxicity, "_PIECE", 101)
    monkeypatch.setattr(toxicity, "_BLOCK", 64)
    monkeypatch.setattr(toxicity, "_VOCABULARY", 50)
    found = {int(p) for _, place in toxicity.features([text], toxicity.Vocabulary()) for p in place}
    assert found == plain_features(text)


def test_fit_equals_a_plain_loop():
    pick = random.Random(2)
    words = [f"w{chr(97 + i)}" for i in range(12)]
    docs, labels = [], []
    for _ in range(120):
        own = pick.sample(words, 5)
        docs.append(plain_features(" ".join(own)))
        labels.append(float("wa" in own or "wb" in own))
    model = toxicity.fit([np.array(sorted(d)) for d in docs], np.array(labels))
    seen = {}
    for d in docs:
        for i in d:
            seen[i] = seen.get(i, 0) + 1
    bias = 1 << toxicity.BITS
    kept = [{i for i in d if seen[i] >= toxicity.LEAST_DOCS} | {bias} for d in docs]
    order = np.random.default_rng(7)
    passes = int(np.clip(toxicity.ROW_VISITS // len(docs), *toxicity.PASSES))
    visits = [i for _ in range(passes) for i in order.permutation(len(docs))]
    want = plain_fit(kept, labels, visits)
    assert np.isclose(model.bias, want.pop(bias, 0.0))
    assert dict(zip(model.places.tolist(), model.weights)) == pytest.approx(want)
    assert 0 < len(want) < len(seen)  # L1 leaves part of the weights at zero


def test_scores_equal_a_plain_scorer(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    weights = dict(zip(model.places.tolist(), model.weights.tolist()))
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(out) == docs.count()
    for r in docs.collect():
        total = model.bias + sum(weights.get(i, 0.0) for i in plain_features(r.text))
        assert math.isclose(out[r.doc_id].score, 1 / (1 + math.exp(-total)), rel_tol=1e-9)
        assert out[r.doc_id].predicted == int(out[r.doc_id].score >= 0.5)


def test_toxicity_held_out(spark):
    out = queries.op11_toxicity(spark, MEDIUM)
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    held = out.where("held_out").join(labels, "doc_id").toPandas()
    assert (held.predicted == held.toxic).mean() > 0.94
    assert held[held.toxic == 0].predicted.mean() < 0.02
    assert out.where("score < 0 OR score > 1 OR predicted <> CAST(score >= 0.5 AS INT)").count() == 0


def test_labels_of_held_out_rows_do_not_matter(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.selectExpr(
        "doc_id", "quality", "IF(crc32(CAST(doc_id AS STRING)) % 5 = 0, 1 - toxic, toxic) AS toxic"
    ).write.parquet(f"{tmp_path}/labels.parquet")
    assert rows(queries.op11_toxicity(spark, str(tmp_path))) == rows(queries.op11_toxicity(spark, SF))


def test_toxicity_of_odd_documents(odd, clashing, none, spark):
    labels = spark.createDataFrame(
        [(6, 1, 0), (7, 1, 0), (7, 0, 1), (4, 0, 0), (3, 0, None), (8, None, 0), (None, 1, 1)],
        "doc_id bigint, quality int, toxic int",
    )
    model = toxicity.train(odd, labels)
    out = toxicity.score(odd, model)
    assert out.count() == len(ODD_ROWS) and out.where("score IS NULL").count() == 0
    assert rows(toxicity.score(clashing, toxicity.train(clashing, labels))) == rows(out)
    assert rows(toxicity.score(none, model)) == []
    bias = 1 / (1 + math.exp(-model.bias))
    assert all(math.isclose(r.score, bias) for r in out.where("doc_id BETWEEN 1 AND 4").collect())
    for learned in (labels.limit(0), labels.where("toxic = 0")):
        fixed = {r.score for r in toxicity.score(odd, toxicity.train(odd, learned)).collect()}
        assert len(fixed) == 1 and 0 < fixed.pop() < 1


# ------------------------------------------------------------------ filter audit

def plain_mask(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return (
        (len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1
        | (100 * len(re.findall("[A-Z]", text)) > 10 * len(text)) << 2
        | bool(re.search(r"[#$%&*|]", text)) << 3
    )


def plain_audit(docs, labels):
    least = {}
    for own, text, _ in docs:
        if own is not None:
            least[text or ""] = min(own, least.get(text or "", own))
    says = [{i for i, *marks in labels if i is not None and marks[k] == 1} for k in (0, 1)]
    data = []
    for own, text, part in docs:
        copy = own is not None and own > least[text or ""]
        data.append((part or "", plain_mask(text or "") | copy << 4, own in says[0], own in says[1]))
    out = []
    for part in {d[0] for d in data}:
        mine = [d for d in data if d[0] == part]
        share = dict.fromkeys("ABCDE", 0)
        found = []
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                bit = 1 << "ABCDE".index(name)
                gone = [d for d in left if d[1] & bit]
                left = [d for d in left if not d[1] & bit]
                share[name] += len(gone)
                found.append((
                    part, "".join(order), step, len(left), len(gone),
                    sum(bool(d[1] & bit) for d in mine) - len(gone), sum(d[1] == bit for d in mine),
                    sum(d[2] for d in gone), sum(d[3] for d in gone),
                ))
        out += [(*f, share[f[1][f[2] - 1]]) for f in found]
    return sorted(out, key=repr)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
           "toxic_lost", "shapley"]


def test_audit_of_odd_documents(odd, clashing, none, spark):
    labels = spark.createDataFrame(
        [(6, 1, 0), (7, 1, 0), (7, 0, 1), (4, 0, None), (8, None, 1), (None, 1, 1), (3, 1, 1), (99, 1, 1)],
        "doc_id bigint, quality int, toxic int",
    )
    more = spark.createDataFrame(
        [(11, "ONE # TWO", "", "z", 1), (12, "ONE # TWO", None, "z", 1), (12, " ".join(f"w{i}" for i in range(99)) + " w1", "en", "z", 1)],
        SCHEMA,
    )
    docs = odd.unionByName(more)
    out = audit.audit(docs, labels)
    assert out.columns == COLUMNS
    plain = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    want = plain_audit(plain, [tuple(r) for r in labels.collect()])
    assert rows(out) == want
    assert rows(audit.audit(clashing.select(*clashing.columns), labels)) == rows(audit.audit(odd, labels))
    assert rows(audit.audit(none, labels)) == []
    assert rows(audit.audit(none, labels.limit(0))) == []
    named = audit.audit(docs.withColumn("doc_id", docs.doc_id.cast("string")), labels.selectExpr("CAST(doc_id AS STRING) AS doc_id", "quality", "toxic"))
    words = [(None if i is None else str(i), t, p) for i, t, p in plain]
    assert rows(named) == plain_audit(words, [(None if i is None else str(i), q, t) for i, q, t in map(tuple, labels.collect())])


def test_audit_with_small_runs_and_long_prefixes(spark, monkeypatch):
    monkeypatch.setattr(audit, "RUN_BYTES", 3_000)
    monkeypatch.setattr(audit, "RUN_ROWS", 40)
    monkeypatch.setattr(audit, "PART_BYTES", 4_000)
    monkeypatch.setattr(audit, "LEAST_CUT", 500)
    pick = random.Random(8)
    same = "the same beginning " * 30
    texts = [same + str(pick.randint(0, 40)) for _ in range(150)] + [same] * 60 + [""] * 50
    texts += ["".join(pick.choice("ab") for _ in range(pick.randint(0, 6))) for _ in range(200)]
    pick.shuffle(texts)
    data = [(pick.randint(0, 10_000), t, pick.choice(["en", "de", None])) for t in texts]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string").repartition(5)
    labels = [(i, pick.randint(0, 1), pick.randint(0, 1)) for i, _, _ in data if i % 3]
    out = audit.audit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert rows(out) == plain_audit(data, labels)


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet="abé", max_size=8), max_size=30))
def test_trie_holds_smallest_ids(texts):
    trie = audit.Trie()
    for i, text in enumerate(texts):
        trie.insert(text, 100 - i).held.append(i)
    found = {text: (node.least, node.held) for text, node in trie.terminals()}
    want = {t: (100 - max(i for i, x in enumerate(texts) if x == t), [i for i, x in enumerate(texts) if x == t])
            for t in texts}
    assert found == want
    assert sorted(n.least for n in trie.walk()) == sorted(least for least, _ in want.values())
    inner = [trie.root]
    while inner:  # compressed: a place inside has two ways on, or a text that ends there
        node = inner.pop()
        assert node is trie.root or node.held is not None or len(node.kids) > 1
        inner += [kid for _, kid in node.kids.values()]


# -------------------------------------------------------------- bit-plane clusters

def plain_clusters(vectors, k, rounds, seed="2"):
    kept = [
        (i, [math.floor(256 * x) for x in v]) for i, v in vectors
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]
    def key(row):
        return hashlib.sha256(f"{seed}:{'' if row[0] is None else row[0]}".encode()).hexdigest(), row[1]

    centres = [list(v) for _, v in sorted(kept, key=key)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        for n, members in own.items():
            centres[n] = [sum(column) // len(members) for column in zip(*members)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    total = {}
    for _, n, d in found:
        total[n] = total.get(n, 0) + d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted([(i, n, d, total[n], sum(total.values()), names[n]) for i, n, d in found], key=repr)


SHAPE = "vec_id bigint, embedding array<float>, cluster int, _v string"


@settings(max_examples=60, deadline=None)
@given(data=st.data())
def test_dot_products_are_exact(data):
    size = data.draw(st.integers(0, 27))
    pick = np.random.default_rng(data.draw(st.integers(0, 1000)))
    low = -(1 << size)
    left = pick.integers(low, -low, (5, 64))
    right = pick.integers(low, -low, (3, 64))
    n = size + 1
    a, b = planes.pack(left, n), planes.pack(right, n)
    assert (planes.unpack(a) == left).all()
    assert (planes.dots(a, b) == left @ right.T).all()


def test_clusters_equal_a_plain_loop(spark):
    pick = np.random.default_rng(3)
    data = [(int(i), [float(np.float32(x)) for x in pick.normal(0, 0.2, 64)]) for i in pick.permutation(300)]
    data += [(1, data[0][1]), (7, [0.0] * 64), (8, [0.0] * 64), (None, [-1.0] * 64), (None, [1.0] * 64)]
    odd = [(400, None), (401, []), (402, [0.5] * 63), (403, [0.5] * 65), (404, [None] + [0.5] * 63),
           (405, [float("nan")] + [0.5] * 63), (406, [float("inf")] + [0.5] * 63)]
    df = spark.createDataFrame([(i, v, 9, "x") for i, v in data + odd], SHAPE).repartition(4)
    out = planes.cluster(df, centroids=7, rounds=3)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert rows(out) == plain_clusters(data + odd, 7, 3)


def test_few_vectors_and_none(spark):
    few = [(3, [0.25] * 64), (4, [0.5] * 64), (4, [0.5] * 64)]
    df = spark.createDataFrame([(i, v, 0, "") for i, v in few], SHAPE)
    assert rows(planes.cluster(df)) == plain_clusters(few, 40, 5)
    assert rows(planes.cluster(df.limit(0))) == []
    assert rows(planes.cluster(df.where("vec_id = 3").withColumn("embedding", df.embedding.cast("array<double>")))) \
        == plain_clusters(few[:1], 40, 5)


def test_huge_components_are_clamped(spark):
    data = [(1, [1e30] * 64), (2, [-1e30] * 64), (3, [0.0] * 64)]
    df = spark.createDataFrame([(i, v, 0, "") for i, v in data], SHAPE)
    out = {r.vec_id: r for r in planes.cluster(df, centroids=1, rounds=0).collect()}
    size = planes.LIMIT
    first = min((1, 2, 3), key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())
    centre = {1: size, 2: -size, 3: 0}[first]
    assert {i: r.distance for i, r in out.items()} == {
        i: 64 * (v - centre) ** 2 for i, v in ((1, size), (2, -size), (3, 0))
    }
    assert {r.inertia for r in out.values()} == {sum(r.distance for r in out.values())}
