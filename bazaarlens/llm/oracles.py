"""DuckDB SQL that states the results of the text queries, where SQL can."""

from itertools import permutations

# bare upper-case base32 of the SHA-1: four letters from every five hexadecimal digits
_BASE32 = """array_to_string(list_transform(range(32), lambda i: substr(
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31)::BIGINT + 1,
    1)), '')"""

TOKEN_COUNTS = r"""
WITH d AS (
  SELECT *, regexp_replace(coalesce(text, ''), '[#*%&$!|]+', ' ', 'g') AS clean,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents),
k AS (SELECT * FROM d WHERE doc_id = first)
SELECT source, lang, v AS tokenizer, count(*) AS n_docs,
  sum(CASE v WHEN 'words@1' THEN len(regexp_extract_all(clean, '[^\x20\x09-\x0D]+'))
    ELSE len(regexp_extract_all(clean, '[0-9A-Za-z\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]')) END
  )::BIGINT AS n_tokens,
  sum(length(clean))::BIGINT AS n_chars
FROM k, (VALUES ('words@1'), ('words@2')) AS versions(v)
GROUP BY source, lang, v
"""

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""


def _found(kind: str, pattern: str, group: int, least: int) -> str:
    """Matches with their places: text lies between matches, so lengths add up to offsets."""
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, source, page, '{kind}' AS kind, s AS start, s + length(m) AS stop, v FROM (
    SELECT doc_id, source, page, unnest(list_transform(range(1, len(ms) + 1), lambda i: {{
      's': list_sum(list_transform(gaps[1:i], lambda g: length(g)))
         + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0),
      'm': ms[i], 'v': vs[i]}}), recursive := true)
    FROM (SELECT doc_id, source, sha256(t) AS page, regexp_extract_all(t, '{quoted}') AS ms,
      regexp_extract_all(t, '{quoted}', {group}) AS vs, regexp_split_to_array(t, '{quoted}') AS gaps
      FROM d WHERE regexp_matches(t, '{quoted}')))
  WHERE length(v) >= {least}"""


_ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[" "\"'" r"]?\x20*[:=]\x20*[" "\"'"
    r"]?([A-Za-z0-9+/_.=-]+)"
)

SECRETS = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
base AS ({_found('assign', _ASSIGN, 2, 6)}
  UNION ALL {_found('access', 'AKIA[A-Z0-9]+', 0, 20)}
  UNION ALL {_found('hex', '[0-9a-f]+', 0, 24)}),
generic AS ({_found('owned', '[A-Za-z0-9+/_=-]+', 0, 20)}),
marked AS (
  SELECT *, len(list_distinct(string_split(v, ''))) >= 10 AND regexp_matches(v, '[0-9]')
    AND regexp_matches(v, '[A-Za-z]') AS live
  FROM (SELECT * FROM base UNION ALL SELECT * FROM generic g WHERE NOT EXISTS (
    FROM base b WHERE b.doc_id = g.doc_id AND b.start < g.stop AND b.stop > g.start))),
candidates AS (SELECT * FROM marked WHERE kind <> 'owned' OR live),
counts AS (
  SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repos, bool_or(live) AS live
  FROM (SELECT v, page, min(source) AS owner, min(doc_id) AS repo, bool_or(live) AS live
    FROM candidates GROUP BY v, page) GROUP BY v),
uses AS (
  SELECT *, CASE WHEN owners >= 3 AND repos >= 3 THEN 'copied'
    WHEN owners <= 1 AND live THEN 'live' ELSE 'other' END AS use FROM counts),
spans AS (
  SELECT c.*, u.use, u.owners, u.repos, list_position(['assign', 'access', 'hex', 'owned'], kind) AS rank,
    kind || ':' || start::BIGINT || ':' || stop::BIGINT AS span
  FROM candidates c JOIN uses u USING (v) WHERE kind <> 'owned' OR use = 'live')
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign,
  count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (kind <> 'owned'), ''))
    AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans,
  count(*) FILTER (use = 'live') AS n_live, count(*) FILTER (use = 'copied') AS n_copied,
  coalesce(string_agg(owners::VARCHAR, ',' ORDER BY start, rank), '') AS owners,
  coalesce(string_agg(repos::VARCHAR, ',' ORDER BY start, rank), '') AS repos
FROM d LEFT JOIN spans s ON s.doc_id = d.doc_id
GROUP BY d.doc_id
"""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

DECONTAMINATION = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
iw AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)
  WHERE len(w) > 0),
pat AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM iw)),
win AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
    FROM dw, (SELECT DISTINCT n FROM pat) WHERE len(w) >= n)),
occ AS (SELECT doc_id, coalesce(item_id::VARCHAR, 'null') AS item, i, n FROM win JOIN pat USING (n, p)),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_BITS = {name: 1 << i for i, name in enumerate("ABCDE")}
_STEPS = ", ".join(
    f"('{''.join(order)}', {at + 1}, {_BITS[name]}, {sum(_BITS[f] for f in order[:at])})"
    for order in permutations("ABCDE") for at, name in enumerate(order)
)

FILTER_AUDIT = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (
  SELECT doc_id, part, (len(w) < 100)::INT
    + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS mask FROM d),
l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
s(filter_order, step, own, before) AS (VALUES {_STEPS})
SELECT part, filter_order, step::INT AS step,
  coalesce(sum(n) FILTER (mask & (own | before) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & own <> 0), 0)::BIGINT AS shapley
FROM c, s GROUP BY part, filter_order, step
"""


def _clusters(rounds: int, centroids: int) -> str:
    """The rounds written out: members by nearest centre, then centres by floored means."""
    parts = [
        f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = 64),
c0 AS (
  SELECT row_number() OVER (ORDER BY h) - 1 AS k, x AS c FROM (
    SELECT x, sha256('2:' || vec_id) AS h FROM v ORDER BY h LIMIT {centroids}))"""
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""
a{i} AS (
  SELECT vec_id, any_value(x) AS x, min({{'d': d, 'k': k}}) AS best FROM (
    SELECT vec_id, x, k, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) ** 2))::BIGINT AS d
    FROM v, c{i}) GROUP BY vec_id)"""
        )
        if i < rounds:
            parts.append(
                f"""
m{i} AS (
  SELECT k, list(floor(mean)::BIGINT ORDER BY j) AS c FROM (
    SELECT k, j, floor(sum(e)::DOUBLE / count(*)) AS mean FROM (
      SELECT best.k AS k, unnest(x) AS e, unnest(range(1, 65)) AS j FROM a{i}) GROUP BY k, j) GROUP BY k),
c{i + 1} AS (SELECT k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))"""
            )
    return ",".join(parts) + f"""
SELECT vec_id, best.k::INT AS cluster, best.d AS distance,
  sum(best.d) OVER (PARTITION BY best.k)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON k = best.k
"""


BIT_PLANES = _clusters(rounds=5, centroids=40)

ORACLES = {
    "op1_token_counts": TOKEN_COUNTS,
    "op3_warc": WARC,
    "op4_secrets": SECRETS,
    "op10_wu_manber": DECONTAMINATION,
    "op12_filter_audit": FILTER_AUDIT,
    "op13_bit_planes": BIT_PLANES,
}
