"""Secret scans with corpus-wide ownership frequency.

Every text is scanned for three kinds of base spans (``assign``, ``access``, ``hex``) and for
generic candidates: runs of 20 or more characters of key material outside base spans. The value of
each span is hashed and aggregated over the whole corpus. Uses of a value in identical texts are one
use, that of the text's smallest owner and repository, so mirrors of a page count once. What is left
is counted by distinct owners and by distinct repositories:

* ``copied``: ``WIDE_OWNERS`` or more owners and ``WIDE_REPOS`` or more repositories, such as an
  example that different manuals repeat,
* ``live``: one owner only, and live-looking (a letter, a digit, ten distinct characters),
* ``other``: anything else.

Base spans are always reported. A generic candidate becomes a span of kind ``owned`` only if the
corpus shows it to be live. Only hashes are shuffled; counting distinct owners combines before it
shuffles, so a value that fills a third of the corpus costs one row per task and text, then one per
task and owner.

Null and empty texts have no spans. Null owners and repositories are not counted. Repeated rows
give repeated rows and count as one repository. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.common import map_texts, slices, spare, staged

KINDS = ["assign", "access", "hex", "owned"]
WIDE_OWNERS = 3
WIDE_REPOS = 3
LIVE_DISTINCT = 10
MASK = "[SECRET]"


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(map(_either_case, ["password", "passwd", "secret", "token", "api_?key"]))
_ASSIGN = re.compile(rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
# a run of these classes is matched whole or not at all, so the length can be in the pattern
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_GENERIC = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


def looks_live(value: str) -> bool:
    return (
        len(set(value)) >= LIVE_DISTINCT
        and any(c in "0123456789" for c in value)
        and any(c not in "0123456789+/_=-." for c in value)
    )


def find_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value): base spans and ``owned`` candidates, by start, then kind."""
    found = [
        ("assign", m.start(), m.end(), m[2])
        for m in (_ASSIGN.finditer(text) if ":" in text or "=" in text else ())
        if len(m[2]) >= 6
    ]
    for kind, pattern in (("access", _ACCESS), ("hex", _HEX)):
        found += [(kind, m.start(), m.end(), m[0]) for m in pattern.finditer(text)]
    base = sorted((a, b) for _, a, b, _ in found)
    i, reach = 0, 0
    for m in _GENERIC.finditer(text):
        while i < len(base) and base[i][0] < m.end():
            reach = max(reach, base[i][1])
            i += 1
        if reach <= m.start() and looks_live(m[0]):
            found.append(("owned", m.start(), m.end(), m[0]))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


_SPANS = (
    "array<struct<kind:string,start:bigint,end:bigint,value_hash:string,live:boolean>>"
)
_SPAN_TYPE = pa.list_(
    pa.struct(
        [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
         ("value_hash", pa.string()), ("live", pa.bool_())]
    )
)


def scan(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys, text_hash, spans``: base spans and generic candidates of every text with value
    hashes, and the hash of the text where it has any."""

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        rows, hashes = [], []
        for text in batch.column(batch.num_columns - 1):
            text = text.as_py() or ""
            rows.append([
                {
                    "kind": kind, "start": a, "end": b,
                    "value_hash": hashlib.sha256(value.encode()).hexdigest(),
                    "live": looks_live(value),
                }
                for kind, a, b, value in find_spans(text)
            ])
            hashes.append(hashlib.sha256(text.encode()).hexdigest() if rows[-1] else None)
        return [*batch.columns[:-1], pa.array(hashes, pa.string()), pa.array(rows, _SPAN_TYPE)]

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "text_hash string", f"spans {_SPANS}"])
    return map_texts(docs, [*keys, text_col], schema, work)


def ownership(found: DataFrame, owner: str, repo: str) -> DataFrame:
    """``value_hash, owners, repos, use`` of every candidate of ``found`` (owner, repo, text_hash,
    spans)."""
    values = found.select(
        F.col(owner).alias("_o"), F.col(repo).alias("_r"), "text_hash", F.inline("spans")
    )
    texts = values.groupBy("value_hash", "text_hash").agg(
        F.min("_o").alias("_o"), F.min("_r").alias("_r"), F.max("live").alias("live")
    )
    counts = texts.groupBy("value_hash").agg(
        F.count_distinct("_o").alias("owners"), F.count_distinct("_r").alias("repos"),
        F.max("live").alias("live"),
    )
    wide = (F.col("owners") >= WIDE_OWNERS) & (F.col("repos") >= WIDE_REPOS)
    use = (
        F.when(wide, "copied")
        .when((F.col("owners") <= 1) & F.col("live"), "live")
        .otherwise("other")
    )
    return counts.select("value_hash", "owners", "repos", use.alias("use"))


def classified(found: DataFrame, owner: str, repo: str, key: str) -> DataFrame:
    """``key, spans`` (kind, start, end, use, owners, repos) of the rows of ``found`` that have
    any; generic candidates that are not live are left out."""
    # from a table, so that Spark can split the join rows of a value that is everywhere
    uses = staged(ownership(found, owner, repo), "ownership")
    spans = found.select(key, F.inline("spans")).join(uses, "value_hash")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct("start", rank.alias("rank"), "end", "kind", "use", "owners", "repos")
    return (
        spans.where("kind <> 'owned' OR use = 'live'")
        .groupBy(key).agg(F.array_sort(F.collect_list(span)).alias("spans"))
    )


def _joined(spans) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ), ",",
    )


def secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
    repo_col: str = "doc_id",
) -> DataFrame:
    """Per document ``id_col, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied``, and
    ``owners, repos``: of each of its spans in order, how many have its value."""
    keyed = docs.select(
        F.col(id_col).alias("_id"), F.col(owner_col).alias("_owner"),
        F.col(repo_col).alias("_repo"), F.col(text_col).alias("_text"),
    )
    found = scan(keyed, ["_id", "_owner", "_repo"], "_text")
    found = staged(found.withColumn("_row", F.monotonically_increasing_id()), "spans")
    full = found.where(F.size("spans") > 0)
    spans = classified(full, "_owner", "_repo", "_row")
    none = F.array().cast(
        "array<struct<start:bigint,rank:bigint,end:bigint,kind:string,use:string,owners:bigint,repos:bigint>>"
    )
    rows = found.select("_id", "_row").join(spans, "_row", "left").withColumn(
        "spans", F.coalesce("spans", none)
    )

    def number(field: str, value: str) -> Column:
        return F.size(F.filter("spans", lambda s: s[field] == value)).cast("bigint")

    def counts(field: str) -> Column:
        each = F.transform("spans", lambda s: s[field].cast("string"))
        return F.array_join(each, ",").alias(field)

    return rows.select(
        F.col("_id").alias(id_col),
        *[number("kind", kind).alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"] != "owned")), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
        number("use", "live").alias("n_live"),
        number("use", "copied").alias("n_copied"),
        counts("owners"), counts("repos"),
    )


def mask(text: str, spans: list[dict]) -> str:
    """``text`` with the union of ``spans`` (sorted by start) replaced by ``MASK``."""
    out, done = [], 0
    for span in spans:
        if span["start"] >= done:
            out += [text[done : span["start"]], MASK]
        done = max(done, span["end"])
    return "".join(out) + text[done:]


def masked_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
    repo_col: str = "doc_id", length_col: str | None = "n_chars",
) -> DataFrame:
    """All rows of ``docs`` with their secrets masked; widely copied examples stay as they are.

    ``length_col`` (if present) is set to the new length where a text changed.
    """
    row, own_id, own_row, marked = spare(docs, "_row", "_own_id", "_own_row", "_spans")
    keyed = docs.select("*", F.xxhash64(*[F.col(c) for c in docs.columns]).alias(row))
    narrow = keyed.select(
        F.col(id_col).alias("_id"), F.col(owner_col).alias("_owner"),
        F.col(repo_col).alias("_repo"), F.col(row).alias("_row"), F.col(text_col).alias("_text"),
    )
    found = scan(narrow, ["_id", "_owner", "_repo", "_row"], "_text").where(F.size("spans") > 0)
    # equal rows have equal spans: one of them is enough
    found = staged(found, "spans").dropDuplicates(["_id", "_row"])
    found = found.withColumn("_key", F.struct("_id", "_row"))
    marks = classified(found, "_owner", "_repo", "_key").select(
        F.col("_key._id").alias(own_id), F.col("_key._row").alias(own_row),
        F.filter("spans", lambda s: s["use"] != "copied").alias(marked),
    ).where(F.size(marked) > 0)
    same = F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(row) == F.col(own_row))
    joined = keyed.join(marks, same, "left").select(*docs.columns, marked)
    names, text, spans = docs.columns, docs.columns.index(text_col), len(docs.columns)
    length = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text):
                columns = piece.columns
                if piece.column(spans).null_count < piece.num_rows:
                    marks = piece.column(spans).to_pylist()
                    texts = piece.column(text).to_pylist()
                    hit = [i for i, found in enumerate(marks) if found]
                    for i in hit:
                        texts[i] = mask(texts[i], marks[i])
                    columns[text] = pa.array(texts, piece.schema.field(text).type)
                    if length is not None:
                        sizes = columns[length].to_pylist()
                        for i in hit:
                            sizes[i] = len(texts[i])
                        columns[length] = pa.array(sizes, piece.schema.field(length).type)
                yield pa.RecordBatch.from_arrays(columns[:spans], names=names)

    return joined.mapInArrow(run, docs.schema)
