"""WARC archives packaged as ZIP files, written by Spark and read back by ranges.

An archive is one ZIP file with two stored (uncompressed) members: ``archive/data.warc`` with the
records and ``indexes/index.cdxj`` with one JSON line per record (offset within the member, length,
URL, digest). Sizes are known only at the end, so members carry data descriptors, and the central
directory is written with ZIP64 fields throughout.

Writing: every task turns its rows into one archive, streamed as chunks to Spark's own text sink,
so any file system and the job's commit protocol serve, and a failed task leaves no archive. The
sink ends a row with a line feed; each chunk ends with a byte that is one anyway (the end of a
record, an index line or the archive comment).

Reading: file names and lengths come from Spark. A task reads the end of an archive, parses the
(ZIP64) end record and central directory, locates the stored members, reads the index by range and
gives one row per record. These small rows are then dealt out again, and record bytes are fetched
by range, neighbours together, without extracting a member. Files are opened with ``pyarrow.fs``
under the URI that Spark reports.

Payload digests decide revisits: of records with equal payloads of at least ``least`` bytes that
with the smallest id is a response, all others revisit it. Shorter payloads are always responses.

A null payload is empty; a null URL is written as empty. A null id never is the smallest unless
all are null. Repeated rows of the smallest id all are responses. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm.common import staged
from bazaarlens.session import work_dir

DATA, INDEX = "archive/data.warc", "indexes/index.cdxj"
REACH = 1 << 22
STRETCH = 1 << 24
_DATE = "2024-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LONG = 0xFFFFFFFF


# --------------------------------------------------------------------- records

def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(record_id: int | None) -> str:
    return f"<urn:page:{'' if record_id is None else record_id}>"


def _from_urn(text: str | None) -> int | None:
    value = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value else None


def make_record(
    record_id: int | None, url: str | None, payload: bytes, digest: str, kind: str,
    refers_to: int | None,
) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP head alone."""
    url = "".join((url or "").split())
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(record_id)}",
        f"WARC-Target-URI: {url}", f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of one record; ``payload`` is None for a revisit. Damaged records raise."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n" or len(block) != int(fields["content-length"]):
        raise ValueError("record length does not fit")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(
        int(line.split(b":")[1]) for line in http.split(b"\r\n")
        if line.lower().startswith(b"content-length:")
    )
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError("payload does not fit its digest")
    return {
        "record_id": _from_urn(fields["warc-record-id"]), "url": fields["warc-target-uri"],
        "kind": kind, "refers_to": _from_urn(fields.get("warc-refers-to")),
        "digest": digest, "size": size, "payload": payload if kind == "response" else None,
    }


# ------------------------------------------------------------------ ZIP writing

def _local_header(name: str) -> bytes:
    # version 4.5, flag 8: sizes follow the data; both sizes are in a ZIP64 field
    extra = struct.pack("<HHQQ", 1, 16, 0, 0)
    return struct.pack(
        "<IHHHHHIIIHH", 0x04034B50, 45, 8, 0, 0, 0x21, 0, _LONG, _LONG, len(name), len(extra)
    ) + name.encode() + extra


def _descriptor(crc: int, size: int) -> bytes:
    return struct.pack("<IIQQ", 0x08074B50, crc, size, size)


def _directory(members: list[tuple[str, int, int, int]], at: int) -> bytes:
    """Central directory at ``at`` with the ZIP64 end records; ends in a one-byte comment."""
    entries = b""
    for name, crc, size, offset in members:
        extra = struct.pack("<HHQQQ", 1, 24, size, size, offset)
        entries += struct.pack(
            "<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 8, 0, 0, 0x21, crc, _LONG, _LONG,
            len(name), len(extra), 0, 0, 0, 0, _LONG,
        ) + name.encode() + extra
    count, size = len(members), len(entries)
    end64 = struct.pack(
        "<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, count, count, size, at
    )
    locator = struct.pack("<IIQI", 0x07064B50, 0, at + size, 1)
    end = struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, _LONG, _LONG, 1)
    return entries + end64 + locator + end + b"\n"


def archive_chunks(records: Iterator[tuple[dict, bytes]]) -> Iterator[bytes]:
    """A whole archive as chunks that end in a line feed; (index fields, record bytes) in."""
    chunk, crc, size, lines = _local_header(DATA), 0, 0, []
    for fields, record in records:
        lines.append(json.dumps(fields | {"offset": size, "length": len(record)}) + "\n")
        crc, size = zlib.crc32(record, crc), size + len(record)
        yield chunk + record
        chunk = b""
    if not lines:
        return
    start = len(_local_header(DATA)) + size
    chunk = _descriptor(crc, size) + _local_header(INDEX)
    index = start + 24
    index_crc, index_size = 0, 0
    for line in lines:
        raw = line.encode()
        index_crc, index_size = zlib.crc32(raw, index_crc), index_size + len(raw)
        yield chunk + raw
        chunk = b""
    at = index + len(_local_header(INDEX)) + index_size + 24
    members = [(DATA, crc, size, 0), (INDEX, index_crc, index_size, index)]
    yield _descriptor(index_crc, index_size) + _directory(members, at)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records():
        for batch in batches:
            ids, urls, payloads, refers, kinds = batch.columns
            for i in range(batch.num_rows):
                payload = payloads[i].as_py() or b""
                kind, refers_to = kinds[i].as_py(), refers[i].as_py()
                digest = payload_digest(payload)
                record = make_record(
                    ids[i].as_py(), urls[i].as_py(), payload, digest, kind, refers_to
                )
                yield {"id": ids[i].as_py(), "digest": digest, "type": kind}, record

    held, size = [], 0
    for chunk in archive_chunks(records()):
        held.append(chunk[:-1])
        size += len(chunk)
        if size > REACH:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["chunk"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["chunk"])


def with_revisits(
    pages: DataFrame, id_col: str, payload_col: str, url_col: str, least: int
) -> DataFrame:
    """``id, url, payload, refers_to, kind`` of every page."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"),
        payload.alias("payload"),
    ).withColumns({"_sha": F.sha1("payload"), "_size": F.length("payload")})
    shared = (
        rows.where(F.col("_size") >= least).groupBy("_sha")
        .agg(F.min("id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
        .select("_sha", "_first")
    )
    # read back from a table, both sides of the join are shuffled for it and Spark can split the
    # rows of a payload that fills a large part of them
    shared = staged(shared, "shared-payloads")
    revisit: Column = F.col("_first").isNotNull() & ~F.col("id").eqNullSafe(F.col("_first"))
    return rows.join(shared, "_sha", "left").select(
        "id", "url", "payload", F.when(revisit, F.col("_first")).alias("refers_to"),
        F.when(revisit, "revisit").otherwise("response").alias("kind"),
    )


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html",
    url_col: str = "url", least: int = 0,
) -> None:
    """One archive per task below ``path``; tasks without rows leave an empty file."""
    chunks = with_revisits(pages, id_col, payload_col, url_col, least).mapInArrow(
        _write, "chunk binary"
    )
    # the cast keeps the bytes as they are; the sink writes them without looking at them
    chunks.select(F.col("chunk").cast("string")).write.option("compression", "none").text(path)


# ------------------------------------------------------------------ ZIP reading

@dataclass
class Member:
    name: str
    size: int
    start: int  # of its data in the file


def _read_at(file, start: int, length: int) -> bytes:
    data = file.read_at(length, start)
    if len(data) != length:
        raise ValueError("archive ends too early")
    return data


def read_directory(file, length: int) -> dict[str, Member]:
    """Stored members of an archive by name, from its central directory."""
    tail_at = max(0, length - 65_557)
    tail = _read_at(file, tail_at, length - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, count, size, at, _ = struct.unpack_from("<IHHHHIIH", tail, end)
    if count == 0xFFFF or size == _LONG or at == _LONG:
        locator = _read_at(file, tail_at + end - 20, 20)
        signature, _, end64, _ = struct.unpack("<IIQI", locator)
        if signature != 0x07064B50:
            raise ValueError("no ZIP64 locator")
        record = struct.unpack("<IQHHIIQQQQ", _read_at(file, end64, 56))
        count, size, at = record[7], record[8], record[9]
    entries, place, out = _read_at(file, at, size), 0, {}
    for _ in range(count):
        fields = struct.unpack_from("<IHHHHHHIIIHHHHHII", entries, place)
        if fields[0] != 0x02014B50:
            raise ValueError("damaged central directory")
        method, packed, full, offset = fields[4], fields[8], fields[9], fields[16]
        names, extras, comments = fields[10], fields[11], fields[12]
        name = entries[place + 46 : place + 46 + names].decode()
        extra = entries[place + 46 + names : place + 46 + names + extras]
        place += 46 + names + extras + comments
        while len(extra) >= 4:
            tag, n = struct.unpack_from("<HH", extra)
            if tag == 1:  # the fields that are too long above, in this order
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                full = wide.pop(0) if full == _LONG else full
                packed = wide.pop(0) if packed == _LONG else packed
                offset = wide.pop(0) if offset == _LONG else offset
            extra = extra[4 + n :]
        if method != 0:
            continue  # compressed members cannot be read by range
        head = struct.unpack("<IHHHHHIIIHH", _read_at(file, offset, 30))
        out[name] = Member(name, full, offset + 30 + head[9] + head[10])
    return out


def _open(uri: str):
    system, path = pafs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            with _open(uri) as file:
                members = read_directory(file, length)
                data, index = members[DATA], members[INDEX]
                done, rest = 0, b""
                while done < index.size:
                    part = _read_at(file, index.start + done, min(REACH, index.size - done))
                    done += len(part)
                    *lines, rest = (rest + part).split(b"\n")
                    rows = [json.loads(line) for line in lines]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([uri] * len(rows), pa.string()),
                            pa.array([data.start + r["offset"] for r in rows], pa.int64()),
                            pa.array([r["length"] for r in rows], pa.int64()),
                        ],
                        names=["archive", "start", "length"],
                    )


def archives(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` of the archives below ``path``; their contents are not read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
        .select("path", "length").where("length > 0")
    )


def index_of(spark: SparkSession, path: str) -> DataFrame:
    """``archive, start, length``: where every record of the archives below ``path`` lies."""
    return archives(spark, path).mapInArrow(
        _locate, "archive string, start bigint, length bigint"
    )


def _ranges(batch: pa.RecordBatch) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Rows that lie together in one archive, at most ``REACH`` bytes (or one record) each."""
    rows = sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True))
    held: list[tuple[int, int]] = []
    own = None
    for uri, start, length in rows:
        apart = held and start != held[-1][0] + held[-1][1]
        if held and (uri != own or apart or start + length - held[0][0] > REACH):
            yield own, held
            held = []
        own = uri
        held.append((start, length))
    if held:
        yield own, held


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        uri, file = None, None
        try:
            for own, places in _ranges(batch):
                if own != uri:
                    if file is not None:
                        file.close()
                    uri, file = own, _open(own)
                first = places[0][0]
                data = _read_at(file, first, places[-1][0] + places[-1][1] - first)
                rows = [parse_record(data[a - first : a - first + n]) for a, n in places]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["record_id"] for r in rows], pa.int64()),
                        pa.array([r["url"] for r in rows], pa.string()),
                        pa.array([r["kind"] for r in rows], pa.string()),
                        pa.array([r["refers_to"] for r in rows], pa.int64()),
                        pa.array([r["digest"] for r in rows], pa.string()),
                        pa.array([r["size"] for r in rows], pa.int64()),
                        pa.array([r["payload"] for r in rows], pa.binary()),
                    ],
                    names=["record_id", "url", "kind", "refers_to", "digest", "size", "payload"],
                )
        finally:
            if file is not None:
                file.close()


def read_records(index: DataFrame, tasks: int | None = None) -> DataFrame:
    """Records of ``index`` rows (any subset of ``index_of``), read by range; digests are
    checked on the way. Records are dealt out by stretches of their archive.

    Index rows are far smaller than what they stand for, so Spark's own choice of partitions is
    too coarse for whole archives: ``tasks`` sets their number.
    """
    by = ["archive", F.floor(F.col("start") / STRETCH)]
    dealt = index.repartition(tasks, *by) if tasks else index.repartition(*by)
    dealt = dealt.sortWithinPartitions("archive", "start")
    return dealt.mapInArrow(
        _fetch,
        "record_id bigint, url string, kind string, refers_to bigint, digest string, "
        "size bigint, payload binary",
    )


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back: per page
    ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    spark = pages.sparkSession
    path = work_dir(spark, "warc")
    write_archives(pages, path, least=least)
    size = archives(spark, path).agg(F.sum("length")).first()[0] or 0
    return read_records(index_of(spark, path), 1 + size // STRETCH).select(
        F.col("record_id").alias("page_id"), F.col("size").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to",
    )
