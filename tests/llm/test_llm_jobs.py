"""WARC archives, token rollups, the pipeline and the registration of the queries."""

import base64
import hashlib
import io
import re
import zipfile

import corpus_pipeline
import pytest
from cases import ODD_ROWS, SF, rows
from pyspark.sql import functions as F
from test_llm_prints import plain_classes, plain_fingerprint
from test_llm_scan import BPE, plain_marks

from bazaarlens.llm import bpe, queries, rollup, warc
from bazaarlens.session import work_dir

PAGES = "page_id bigint, url string, html string"


# -------------------------------------------------------------------------- WARC

def plain_pages(pages, least=0):
    first = {}
    for page_id, _, html in pages:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    out = []
    for page_id, _, html in pages:
        raw = (html or "").encode()
        origin = first.get(html or "")
        n = sum((h or "") == (html or "") for _, _, h in pages)
        again = origin is not None and n > 1 and page_id != origin and len(raw) >= least
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((page_id, len(raw), digest, "revisit" if again else "response",
                    origin if again else None))
    return sorted(out, key=repr)


ODD_PAGES = [
    (5, "http://a/ b\r\nX: y", "<p>one</p>"), (3, None, "<p>one</p>"), (None, "u", "<p>one</p>"),
    (3, None, "<p>one</p>"), (7, "u", None), (8, "u", ""), (9, "u", "WARC/1.1\r\n\r\nPK\x05\x06é"),
    (10, "u", "x" * 9_000_000), (-4, "u", "\n\n"),
]


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    pages = spark.createDataFrame(ODD_PAGES, PAGES).repartition(3).withColumns(
        {n: F.lit(1) for n in ("id", "payload", "_sha", "kind", "size", "archive")}
    )
    assert rows(warc.round_trip(pages, least)) == plain_pages(ODD_PAGES, least)


def test_warc_of_no_pages(spark):
    assert rows(warc.round_trip(spark.createDataFrame([], PAGES))) == []


def test_archives_are_zip_files_with_readable_members(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    path = work_dir(spark, "zip")
    warc.write_archives(pages, path)
    found, payloads = 0, []
    for r in spark.read.format("binaryFile").load(path).where("length > 0").collect():
        with zipfile.ZipFile(io.BytesIO(bytes(r.content))) as archive:
            assert archive.testzip() is None
            assert archive.namelist() == [warc.DATA, warc.INDEX]
            found += archive.read(warc.INDEX).count(b"\n")
            payloads.append(archive.read(warc.DATA))
    assert found == pages.count()
    html = [r.html.encode() for r in pages.select("html").collect()]
    assert all(any(h in p for p in payloads) for h in html)
    index = warc.index_of(spark, path)
    some = rows(warc.read_records(index.where("start % 2 = 0")).select("record_id", "payload"))
    assert 0 < len(some) < found
    back = warc.read_records(index).join(pages, F.col("record_id") == F.col("page_id"))
    assert back.where(F.col("payload") == F.col("html").cast("binary")).count() == found


class Ranges(io.BytesIO):
    """A file that counts the bytes read from it."""

    seen = 0

    def read_at(self, n, start):
        self.seen += n
        return self.getvalue()[start : start + n]


def test_directories_of_other_writers():
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as archive:  # small archive: no ZIP64 records
        archive.writestr("archive/data.warc", "d" * 200_000)
        archive.writestr("packed", "p" * 99, zipfile.ZIP_DEFLATED)
        archive.comment = b"a comment"
    file = Ranges(plain.getvalue())
    members = warc.read_directory(file, len(plain.getvalue()))
    assert list(members) == ["archive/data.warc"] and file.seen < 70_000
    own = members["archive/data.warc"]
    assert plain.getvalue()[own.start : own.start + own.size] == b"d" * 200_000
    with pytest.raises(ValueError):
        warc.read_directory(Ranges(b"no archive"), 10)


def test_damaged_records_are_refused():
    good = warc.make_record(1, "u", b"abc", warc.payload_digest(b"abc"), "response", None)
    assert warc.parse_record(good)["payload"] == b"abc"
    for bad in (good.replace(b"\r\nabc", b"\r\nabd"), good[:-3], b"HTTP" + good):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


# ----------------------------------------------------------------------- rollups

COUNTS = "source string, lang string, tokenizer string, n_tokens bigint, n_chars bigint, doc_id int"


def test_batches_are_signed_idempotent_and_survive_compaction(spark):
    one = spark.createDataFrame(
        [("a", "en", "w@1", 5, 20, 1), ("a", "en", "w@1", 7, 30, 2), (None, None, "w@1", None, 3, 3)],
        COUNTS,
    )
    two = spark.createDataFrame([("a", "en", "w@1", 4, 18, 1)], COUNTS)
    totals = rollup.TokenRollup(spark, work_dir(spark, "rollup"))
    assert rows(totals.totals()) == []
    assert totals.commit("one", rollup.signed(one, 1))
    assert not totals.commit("one", rollup.signed(one, 1))
    assert totals.commit("two", rollup.revised(one.where("doc_id = 1"), two))
    want = [("a", "en", "w@1", 2, 11, 48), (None, None, "w@1", 1, 0, 3)]
    assert rows(totals.totals()) == sorted(want, key=repr)
    totals.compact()
    assert not totals.commit("two", rollup.signed(one, 1))
    assert rows(totals.totals()) == sorted(want, key=repr)
    assert totals.commit("three", rollup.signed(one.where("doc_id = 3"), -1))
    totals.compact()
    totals.compact()
    assert rows(totals.totals()) == want[:1]
    with pytest.raises(ValueError):
        totals.commit("../up", rollup.signed(one, 1))


def test_a_broken_batch_is_not_counted(spark):
    path = work_dir(spark, "rollup")
    totals = rollup.TokenRollup(spark, path)
    one = spark.createDataFrame([("a", "en", "w@1", 5, 20, 1)], COUNTS)
    delta = spark.createDataFrame([("a", "en", "w@1", 9, 9, 9)], rollup.DELTA)
    delta.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(
        f"{path}/batches/one"
    )
    assert rows(totals.totals()) == []
    assert totals.commit("one", rollup.signed(one, 1))
    assert rows(totals.totals()) == [("a", "en", "w@1", 1, 5, 20)]


def test_counters(odd, none):
    counted = odd.select("doc_id", *[rollup.word_count(F.col("text"), v).alias(v) for v in rollup.WORDS])
    got = {r[0]: tuple(r[1:]) for r in counted.where("doc_id IS NOT NULL").collect()}
    assert got[1] == (0, 0) and got[4] == (3, 5) and got[5] == (4, 4) and got[10] == (5, 9)
    sizes = rows(rollup.bpe_counts(odd, BPE, "bpe@1").select("doc_id", "n_tokens"))
    assert sizes == sorted([(r[0], len(BPE.encode(r[1]))) for r in ODD_ROWS], key=repr)
    assert rows(rollup.bpe_counts(none, BPE, "bpe@1")) == []


# ---------------------------------------------------------------------- pipeline

def staged_through(spark, docs, sf_dir):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = work_dir(spark, name)
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_decide_like_brute_force(spark, documents):
    whole, known, distinct, clean, masked, last = staged_through(spark, documents, SF)
    for df in (known, distinct, clean, masked):
        assert df.columns == documents.columns
    # every test document is in a known language
    assert rows(known) == rows(whole)
    prints = [(r[0], plain_fingerprint(r[1])) for r in known.select("doc_id", "text").collect()]
    assert [r[0] for r in rows(distinct.select("doc_id").sort("doc_id"))] == sorted(
        {c for _, _, c in plain_classes(prints)}, key=lambda i: repr((i,))
    )
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    marked = {r[0] for r in distinct.select("doc_id", "text").collect() if plain_marks(r[1], items)[1]}
    assert {r[0] for r in distinct.join(clean, "doc_id", "left_anti").collect()} == marked
    assert masked.count() == clean.count() == last.count()
    assert masked.where("text rlike 'token = .[0-9a-f]{30}'").count() == 0
    assert rows(last) == rows(bpe.round_trip(masked, BPE))
    assert rows(corpus_pipeline.run(spark, SF)) == rows(last)


def test_stages_take_odd_and_empty_documents(spark, clashing, none):
    for docs in (clashing, none):
        out = staged_through(spark, docs, SF)
        for df in out[:-1]:
            assert df.columns == docs.columns
    assert out[-1].count() == 0


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and set(queries.ORACLES) <= set(queries.QUERIES)


def plain_totals(data):
    """Totals of kept, cleaned texts by key, with a plain loop."""
    least, out = {}, {}
    for own, text, *_ in data:
        if own is not None:
            least[text or ""] = min(own, least.get(text or "", own))
    for own, text, lang, source, *_ in data:
        if own != least.get(text or ""):
            continue
        clean = re.sub(queries.DEBRIS, " ", text or "")
        counts = {
            "words@1": len(re.findall(r"[^\x20\x09-\x0D]+", clean)),
            "words@2": len(re.findall("[0-9A-Za-z\x80-\U0010ffff]+|[!-/:-@\\[-`{-~]", clean)),
        }
        for version, n in counts.items():
            total = out.setdefault((source, lang, version), [0, 0, 0])
            for k, v in enumerate((1, n, len(clean))):
                total[k] += v
    return sorted(((*k, *v) for k, v in out.items()), key=repr)


def test_token_counts_of_odd_documents(spark, odd, clashing, none):
    more = spark.createDataFrame(
        [(20, "a ## b", "en", "a", 1), (21, "a ## b", "en", "z", 1), (None, "a ## b", "en", "z", 1),
         (22, "c|d e", None, "a", 1)], odd.schema)
    docs = odd.unionByName(more)
    want = plain_totals([tuple(r) for r in docs.collect()])
    assert rows(queries.token_counts(docs, work_dir(spark, "odd"))) == want
    assert rows(queries.token_counts(clashing, work_dir(spark, "clashing"))) == plain_totals(ODD_ROWS)
    assert rows(queries.token_counts(none, work_dir(spark, "none"))) == []
