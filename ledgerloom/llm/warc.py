"""WARC archives and a salvage reader (operator 1).

Writing: a record per page in its own gzip member, members grouped into bounded
files through Spark's text sink. That sink ends every value with one byte; a
gzip member ends with the high byte of its length, which is zero below 16 MB,
so the sink's terminator is that byte and the files are plain .warc.gz content.

Reading: `records` walks a file member by member (or record by record, in an
uncompressed archive) and checks the member's checksum and length, the version
line, Content-Length, and the block and payload digests. Where a check fails it
searches for the next gzip magic or version line that parses, goes on from
there, and reports the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import arrow_map, materialize, read_binary, rejoin, shared_path, write_binary

VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Compressed bytes of members in one value of the sink, and values in one file.
VALUE_BYTES, VALUES_PER_FILE = 1 << 20, 16
#: Payloads of at least this many bytes are stored once.
MIN_REVISIT = 0

_MAGIC = b"\x1f\x8b\x08"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r?\n")
_HEAD_END = re.compile(rb"\r?\n\r?\n")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed record; a revisit keeps the HTTP header, with the full payload's length, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    uri = re.sub(r"[\r\n]+", " ", url or "").encode()
    fields = [
        (b"WARC-Type", kind.encode()),
        (b"WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>".encode()),
        (b"WARC-Date", DATE.encode()),
        (b"WARC-Target-URI", uri),
        (b"Content-Type", b"application/http; msgtype=response"),
        (b"WARC-Block-Digest", b"sha1:" + sha1_base32(block).encode()),
        (b"WARC-Payload-Digest", b"sha1:" + digest.encode()),
        (b"X-Page-ID", b"" if page_id is None else str(page_id).encode()),
    ]
    if kind == "revisit":
        fields += [(b"WARC-Profile", REVISIT_PROFILE.encode()), (b"WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>".encode()), (b"X-Refers-To-Page-ID", str(refers_to).encode())]
    head = b"".join(k + b": " + v + b"\r\n" for k, v in fields if v) + b"Content-Length: %d\r\n" % len(block)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member whose last byte is zero: lengths of 16 MB and more get an empty member behind."""
    def one(x: bytes) -> bytes:
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        return c.compress(x) + c.flush()

    out = one(data)
    return out if out[-1] == 0 else out + one(b"")


@dataclass
class Found:
    """A record at `offset` of the file, or a gap of `length` quarantined bytes with the reason."""

    offset: int
    length: int
    headers: dict[str, str] | None
    block: bytes = b""
    reason: str = ""


def _parse(data: bytes, at: int) -> tuple[int, dict[str, str] | None, bytes, str]:
    """The record at `at`: (end, headers, block, why it fails)."""
    if not _VERSION_LINE.match(data, at):
        return at, None, b"", "no version line"
    end = _HEAD_END.search(data, at)
    if not end:
        return at, None, b"", "header without end"
    headers = {}
    for line in data[at : end.start()].splitlines()[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return at, None, b"", "header line without colon"
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = headers.get("content-length", "")
    if not size.isdigit():
        return at, None, b"", "no content length"
    stop = end.end() + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        return at, None, b"", "record does not end where its length says"
    block = data[end.end() : stop]
    want = headers.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:] != sha1_base32(block):
        return at, None, b"", "block digest differs"
    if headers.get("warc-type") == "response" and (want := headers.get("warc-payload-digest", "")).startswith("sha1:") and want[5:] != sha1_base32(payload_of(block)):
        return at, None, b"", "payload digest differs"
    return stop + 4, headers, block, ""


def payload_of(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


def _inflate(data: bytes, at: int) -> tuple[int, bytes, str]:
    """The gzip member at `at`: (end, content, why it fails). Fed in steps, so that what follows is not copied each time."""
    d, out, view = zlib.decompressobj(31), [], memoryview(data)
    try:
        while not d.eof and at < len(data):
            part = view[at : at + 65536]
            out.append(d.decompress(part))
            at += len(part)
    except zlib.error as e:
        return at, b"", f"gzip: {e}"
    if not d.eof:
        return at, b"", "gzip: member is cut off"
    return at - len(d.unused_data), b"".join(out), ""


def records(data: bytes) -> Iterator[Found]:
    """Records and gaps of an archive, in file order; the gaps and records cover every byte once.

    A member that inflates but holds no valid record is a gap as a whole, but
    records after a failed one inside it are recovered too. Empty members count
    as padding of the record before.
    """
    at, gap, why, size = 0, -1, "", len(data)
    while at < size:
        end, found, reason = at, [], ""
        if data.startswith(_MAGIC, at):
            end, content, reason = _inflate(data, at)
            if not reason:
                inner = list(_plain(content)) if content else []
                if content and all(x.headers is None for x in inner):
                    reason = inner[0].reason
                else:
                    found = [Found(at, end - at, x.headers, x.block, x.reason) if x.headers is not None else Found(at, 0, None, b"", f"in member: {x.reason}") for x in inner]
        elif _VERSION_LINE.match(data, at):
            end, headers, block, reason = _parse(data, at)
            found = [Found(at, end - at, headers, block)] if headers is not None else []
        else:
            reason = "neither member nor version line"
        if reason:
            if gap < 0:
                gap, why = at, reason
            at = _next(data, at + 1)
            continue
        if gap >= 0:
            yield Found(gap, at - gap, None, b"", why)
            gap = -1
        yield from found
        at = end
    if gap >= 0:
        yield Found(gap, size - gap, None, b"", why)


def _next(data: bytes, at: int) -> int:
    """The next place at or after `at` where a member or a record may begin; the end if none."""
    a = data.find(_MAGIC, at)
    m = _VERSION_LINE.search(data, at)
    return min(x for x in (a if a >= 0 else len(data), m.start() if m else len(data)))


def _plain(data: bytes) -> Iterator[Found]:
    """Records of uncompressed content, with resynchronisation at version lines."""
    at, gap, why = 0, -1, ""
    while at < len(data):
        end, headers, block, reason = _parse(data, at)
        if headers is None:
            if gap < 0:
                gap, why = at, reason
            m = _VERSION_LINE.search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        if gap >= 0:
            yield Found(gap, at - gap, None, b"", why)
            gap = -1
        yield Found(at, end - at, headers, block)
        at = end
    if gap >= 0:
        yield Found(gap, len(data) - gap, None, b"", why)


READ = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("reason", T.StringType()),
    ]
)


def write_archives(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> None:
    """`pages` (page_id, url, html) to archive files under `path`; equal payloads are stored once.

    Of equal payloads of at least `min_revisit` bytes the one with the smallest
    page_id is the response and others are revisits of it. A null html is an
    empty payload. Of repeated rows with that page_id one is the response, the
    others revisit it; a null page_id sorts after all others.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html"), F.sha1(body.cast("binary")).alias("digest"))
    marks = materialize(rows.where(F.octet_length("html") >= min_revisit).groupBy("digest", "page_id").agg(F.count("*").alias("n")), "digests")
    first = marks.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id")).alias("first"), F.sum("n").alias("n")).where("n > 1").select("digest", "first")
    later = rejoin(marks, first, ["digest"], "inner").where("not (page_id <=> first.page_id)").select(F.col("page_id").alias("__page"), F.col("digest").alias("__digest"), F.col("first.page_id").alias("refers_to"), F.lit(True).alias("revisit"))
    full = rows.join(materialize(later, "revisits"), F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("digest") == F.col("__digest")), "left")
    revisit = F.coalesce("revisit", F.lit(False))
    if marks.where("n > 1").limit(1).count():
        again = F.row_number().over(W.partitionBy("page_id", "digest").orderBy("url")) > 1
        full = full.withColumn("__again", again & (F.octet_length("html") >= min_revisit))
        full = full.withColumn("refers_to", F.when(F.col("__again") & ~revisit, F.col("page_id")).otherwise(F.col("refers_to"))).withColumn("revisit", revisit | F.col("__again"))
    full = full.select("page_id", "url", "html", F.coalesce("revisit", F.lit(False)).alias("revisit"), "refers_to")

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        value: list[bytes] = []
        out, size = [], 0
        for page, url, html, again, refers in zip(*(batch.column(k).to_pylist() for k in range(5))):
            data = (html or "").encode()
            one = member(record("revisit" if again else "response", page, url, data, sha1_base32(data), refers))
            if value and size + len(one) > VALUE_BYTES:
                out.append(b"".join(value)[:-1])
                value, size = [], 0
            value.append(one)
            size += len(one)
        if value:
            out.append(b"".join(value)[:-1])
        yield {"value": out}

    write_binary(arrow_map(full, step, T.StructType([T.StructField("value", T.BinaryType())])), "value", path, VALUES_PER_FILE)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record and every quarantined gap under `path` (record_type null, with a reason); one task reads whole files.

    A revisit's payload_bytes is the length that its HTTP header states.
    Unknown headers are ignored; records without page id keep a null page_id.
    """

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            cols: dict[str, list] = {f.name: [] for f in READ}
            held = 0
            for x in records(content.as_py() or b""):
                h = x.headers or {}
                http, _, data = x.block.partition(b"\r\n\r\n")
                stated = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                full = len(data) if h.get("warc-type") == "response" or not stated else int(stated[1])
                row = (name, x.offset, x.length, _int(h.get("x-page-id")), h.get("warc-target-uri"), h.get("warc-type"), full if x.headers is not None else None, h.get("warc-payload-digest", "").removeprefix("sha1:") or None, _int(h.get("x-refers-to-page-id")), data if payloads and x.headers is not None else None, x.reason or None)
                for f, value in zip(READ, row):
                    cols[f.name].append(value)
                held += len(data) if payloads else 64
                if held > 16 << 20:
                    yield cols
                    cols, held = {f.name: [] for f in READ}, 0
            yield cols

    return arrow_map(read_binary(spark, path), step, READ)


def _int(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d+", text) else None


def round_trip(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Write `pages` to archives in the shared folder and return what the salvage reader recovers.

    Raises if the reader has not found as many records as there are pages.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path)
    found = materialize(read_archives(spark, path, payloads), "records")
    n, wanted = found.where("record_type is not null").count(), pages.count()
    if n != wanted:
        raise RuntimeError(f"{wanted} records were written, {n} recovered")
    return found
