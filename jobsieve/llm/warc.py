"""WARC 1.1 writing and salvage reading on Spark.

Writing. Every page becomes one record, a gzip member of its own, and Spark's text sink writes the members (with
an empty gzip member, which holds no bytes, as line separator), so archives go to any file system and a lost
task's file is never committed. Pages with equal payloads of at least ``min_revisit_bytes`` bytes share one
payload: the page with the smallest id is a response, the others are revisit records that refer to it.

Salvage reading. Archives are read as binary files and walked record by record. A record stands in a whole gzip
member (alone or with others, which share its offset and length) or plainly, with a version line, a Content-Length that
fits and, where given, block and payload digests that match. Digests are checked where algorithm and spelling are
understood (``DIGESTS``, in hex or base 32); the payload of an ``application/http`` response is what follows its HTTP headers,
and is not checked when it is chunked. When a check fails the reader searches for the next place that starts a valid
member or a version line, goes on there and logs the skipped bytes as a quarantined gap (file, offset, length,
reason; of a gap inside a member: the member's); later records are not lost.

Defined cases: null html is an empty payload; a null url is written without target; rows with a null id are
responses and are never referred to; repeated rows with the smallest id are responses as well; an empty table
writes no records and reads none; extra columns are ignored."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsieve.llm.common import binary_rows, bounded_slices, text_digest
from jobsieve.session import scratch_path

VERSION = b"WARC/1.1"
#: an empty gzip member (fixed value): separates records without adding a byte to their content
EMPTY_MEMBER = bytes([31, 139, 8, 0, 0, 0, 0, 0, 0, 255, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
#: digest algorithms that are checked, and their bytes
DIGESTS = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")

_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")

RECORD_SCHEMA = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("kind", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("refers_to_id", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("payload_length", T.LongType()), T.StructField("payload", T.BinaryType()), T.StructField("reason", T.StringType())])


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id, url: str | None, payload: bytes, refers_to, date: str) -> bytes:
    """One uncompressed WARC record."""
    digest = sha1_base32(payload)
    revisit = refers_to is not None
    block = b"" if revisit else payload
    head = [VERSION.decode(), f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>",
            f"WARC-Date: {date}", "Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha1:{digest}",
            f"Content-Length: {len(block)}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    else:
        head.append(f"WARC-Block-Digest: sha1:{digest}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, records_per_file: int = 4000,
                   date: str = "2024-01-01T00:00:00Z", file_bytes: int = 64 << 20) -> None:
    """Write ``pages`` (page_id, url, html) as gzip archives under ``path``, each of at most ``records_per_file`` records and,
    by the largest payload, about ``file_bytes`` (or one record): an archive is read back as one row."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", text_digest("html").alias("digest"), F.octet_length(F.encode(payload, "UTF-8")).alias("size"))
    first = (rows.where(F.col("size") >= min_revisit_bytes).groupBy("digest")
             .agg(F.min("page_id").alias("original"), F.count("*").alias("copies")).where("copies > 1 and original is not null")
             .select("digest", "original"))
    largest = rows.agg(F.max("size")).first()[0] or 0
    records_per_file = max(1, min(records_per_file, file_bytes // (largest + 4096)))
    plan = rows.join(first, "digest", "left").select(
        "page_id", "url", "html", F.when(F.col("page_id") != F.col("original"), F.col("original")).alias("refers_to"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_slices(batches, "html"):
            cols = [batch.column(n).to_pylist() for n in ("page_id", "url", "refers_to")]
            out = [gzip_member(record_bytes(i, u, h, r, date)) for i, u, r, h in zip(*cols, binary_rows(batch.column("html")))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    (plan.mapInArrow(members, "value binary").select(F.col("value").cast("string").alias("value"))
     .write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1")
     .option("maxRecordsPerFile", records_per_file).text(path))


def _member(data: memoryview, at: int) -> tuple[bytes, int]:
    """Content and end of the gzip member at ``at``; raises ValueError when it is damaged or cut."""
    z = zlib.decompressobj(31)
    out, step, pos = [], 1 << 16, at
    try:
        while not z.eof:
            if pos >= len(data):
                raise ValueError("member cut off")
            out.append(z.decompress(data[pos:pos + step]))
            pos += step
    except zlib.error as e:
        raise ValueError(f"damaged member: {e}") from e
    return b"".join(out), min(pos, len(data)) - len(z.unused_data)


def _differs(given: str | None, data: bytes) -> bool:
    """A digest header that is understood and does not belong to ``data``."""
    name, _, value = (given or "").partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip()
    size = DIGESTS.get(name)
    if size is None:
        return False
    try:
        if len(value) == 2 * size:
            want = bytes.fromhex(value)
        elif len(value.rstrip("=")) == -(-size * 8 // 5):
            bare = value.rstrip("=")
            want = base64.b32decode(bare + "=" * (-len(bare) % 8), casefold=True)
        else:
            return False
    except ValueError:
        return False
    return hashlib.new(name, data).digest() != want


def _payload(head: dict, block: bytes) -> bytes | None:
    """What a response's payload digest covers; None where that cannot be told."""
    if not head.get("content-type", "").lower().startswith("application/http"):
        return block
    http, sep, body = block.partition(b"\r\n\r\n")
    return body if sep and b"\ntransfer-encoding:" not in http.lower() else None


def _record(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """Headers, block and end of the plain record at ``at``; raises ValueError when a check fails."""
    end = data.find(b"\r\n\r\n", at)
    if not re.match(rb"WARC/1\.[01]\r\n", data[at:at + 10]):
        raise ValueError("no version line")
    if end < 0:
        raise ValueError("header cut off")
    head = {}
    for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, sep, value = line.partition(":")
        if not sep:
            raise ValueError("malformed header line")
        head[name.strip().lower()] = value.strip()
    if not head.get("content-length", "").isdigit():
        raise ValueError("no content length")
    begin, stop = end + 4, end + 4 + int(head["content-length"])
    if data[stop:stop + 4] != b"\r\n\r\n":
        raise ValueError("block length does not fit")
    block = data[begin:stop]
    kind = head.get("warc-type")
    if _differs(head.get("warc-block-digest"), block):
        raise ValueError("block digest differs")
    payload = _payload(head, block) if kind == "response" else None
    if payload is not None and _differs(head.get("warc-payload-digest"), payload):
        raise ValueError("payload digest differs")
    return head, block, stop + 4


def _inside(content: bytes, offset: int, length: int) -> Iterator[tuple]:
    """Records and gaps of one member's content, at the member's place."""
    at, why = 0, None
    while at < len(content):
        try:
            head, block, end = _record(content, at)
        except ValueError as e:
            why = why or str(e)
            nxt = _VERSION_LINE.search(content, at + 1)
            at = nxt.start() if nxt else len(content)
            continue
        yield offset, length, head, block, None
        at = end
    if why:
        yield offset, length, None, b"", why


def salvage(data: bytes) -> Iterator[tuple]:
    """(offset, length, headers, block, reason): records (reason None) and gaps (headers None) in file order."""
    view, at, gap, why = memoryview(data), 0, None, ""
    while at < len(data):
        try:
            if data[at:at + 3] == b"\x1f\x8b\x08":
                content, end = _member(view, at)
                found = list(_inside(content, at, end - at))  # none: a separator
                if found and all(f[2] is None for f in found):
                    raise ValueError(found[0][4])
            else:
                head, block, end = _record(data, at)
                found = [(at, end - at, head, block, None)]
        except ValueError as e:
            if gap is None:
                gap, why = at, str(e)
            nxt = _START.search(data, at + 1)
            at = nxt.start() if nxt else len(data)
            continue
        if gap is not None:
            yield gap, at - gap, None, b"", why
            gap = None
        yield from found
        at = end
    if gap is not None:
        yield gap, len(data) - gap, None, b"", why


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records and quarantined gaps of all archives under ``path`` (``RECORD_SCHEMA``; kind ``gap`` with a reason).

    One archive is one task's bytes, so archives should be of bounded size (``records_per_file``)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = RECORD_SCHEMA.fieldNames()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file, data, rows, size = batch.column("path")[i].as_py(), batch.column("content")[i].as_py(), [], 0
                for at, length, head, block, reason in salvage(data):
                    h = head or {}
                    ident = h.get("warc-record-id")
                    digest = h.get("warc-payload-digest")
                    rows.append((file, at, length, "gap" if head is None else h.get("warc-type"), ident, h.get("warc-refers-to"),
                                 h.get("warc-target-uri"), digest.removeprefix("sha1:") if digest else None,
                                 int(h["x-payload-length"]) if h.get("x-payload-length", "").isdigit() else (None if head is None else len(block)),
                                 None if head is None else block, reason))
                    size += len(block)
                    if size > 4 << 20:
                        yield _batch(rows, names)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, names)

    return files.mapInArrow(walk, RECORD_SCHEMA)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def archive_round_trip(spark: SparkSession, pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path)
    number = r"<urn:page:(-?\d+)>"
    return read_archives(spark, path).where("kind <> 'gap'").select(
        F.expr(f"try_cast(nullif(regexp_extract(record_id, '{number.replace(chr(92), chr(92) * 2)}', 1), '') as bigint)").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"), "payload_digest", F.col("kind").alias("record_type"),
        F.expr(f"try_cast(nullif(regexp_extract(refers_to_id, '{number.replace(chr(92), chr(92) * 2)}', 1), '') as bigint)").alias("refers_to"))
