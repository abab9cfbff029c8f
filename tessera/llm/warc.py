"""WARC archives: records written from pages, and segments put together again.

Writing.  Each page becomes a record whose block is an HTTP answer in chunked
transfer framing.  A block beyond ``segment_bytes`` is cut: the first part
stays in the record, the rest follows in continuation records that name the
first one's record id and count up; the last carries the total length.  Of
pages with one payload the smallest page_id holds it, the others are revisit
records that refer to it.

Reading.  Archives of bounded size are split into records by their declared
lengths.  Continuation records are grouped by origin identifier with their
first record, ordered by segment number, and checked: numbers without gap,
and the sum of the lengths equal to the total.  Then the chunk framing is
decoded and the payload's digest compared.

Defined results.  Null html is an empty payload; a null url is written as
``urn:page:`` with the page's number.  Among repeated rows all with the
smallest page_id are responses; pages without page_id are responses.  A record
whose segments are incomplete, or whose length or digest does not hold, comes
back with ``ok`` false and no payload.  Records that are neither response,
revisit nor continuation are left out.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import durable, small_batches
from tessera.session import shared_dir

SEGMENT = 8192           # bytes of a block in one record
CHUNK = 2000             # bytes of a transfer chunk
RECORDS = 2000           # records of an archive file, so it stays below about 20 MB
BETWEEN = "\r\n\r\n"     # ends every record
VERSION = b"WARC/1.1\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
NAMES = uuid.UUID(int=0x5A3C0DE)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[k:k + size] for k in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload of chunk framing (extensions and trailers skipped), None
    if it is broken or incomplete."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        at = end + 2
        if size < 0:
            return None
        if size == 0:
            return b"".join(out)
        if body[at + size:at + size + 2] != b"\r\n":
            return None
        out.append(body[at:at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes | None:
    """The payload of an HTTP answer, unchunked if it says so."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None
    fields = [line.partition(b":") for line in head.split(b"\r\n")[1:]]
    coded = any(k.strip().lower() == b"transfer-encoding" and b"chunked" in v.lower() for k, _, v in fields)
    return unchunked(body) if coded else body


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return VERSION + lines.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def _clean(url: str) -> str:
    """Line ends and other white space would break the header."""
    return "".join("%%%02X" % ord(c) if c in " \t\r\n\v\f" else c for c in url)


def _written(segment_bytes: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for page, url, html, first, first_url in zip(*(c.to_pylist() for c in batch.columns)):
                at += 1
                rid = f"<urn:uuid:{uuid.uuid5(NAMES, f'{part}/{at}')}>"
                payload = (html or "").encode()
                again = first is not None and page is not None and first != page
                uri = _clean(url) if url else f"urn:page:{page}"
                fields: list[tuple[str, object]] = [
                    ("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", rid),
                    ("WARC-Date", "2000-01-01T00:00:00Z"), ("WARC-Target-URI", uri),
                    ("Content-Type", "application/http;msgtype=response"),
                    ("WARC-Payload-Digest", "sha1:" + digest(payload)), ("X-Payload-Length", len(payload)),
                    ("X-Page", page)]
                if again:
                    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                               ("WARC-Refers-To-Target-URI", _clean(first_url) if first_url else f"urn:page:{first}"),
                               ("X-Refers-To-Page", first)]
                    out.append(record(fields, HTTP))
                    continue
                block = HTTP + chunked(payload, chunk)
                parts = [block[k:k + segment_bytes] for k in range(0, len(block), segment_bytes)]
                if len(parts) > 1:
                    fields.append(("WARC-Segment-Number", 1))
                out.append(record(fields, parts[0]))
                for k, p in enumerate(parts[1:], 2):
                    own = f"<urn:uuid:{uuid.uuid5(NAMES, f'{part}/{at}/{k}')}>"
                    out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", own),
                                       ("WARC-Date", "2000-01-01T00:00:00Z"), ("WARC-Target-URI", uri),
                                       ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", k),
                                       ("WARC-Segment-Total-Length", len(block) if k == len(parts) else None)], p))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["r"])
    return run


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT, chunk: int = CHUNK,
                   least: int = 0, records: int = RECORDS) -> None:
    """Writes ``pages`` (page_id, url, html) as compressed archives below
    ``path``.  Payloads of fewer than ``least`` bytes are never revisits."""
    p = small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    key = F.when(F.octet_length("html") >= least, F.sha1(F.col("html").cast("binary")))
    # One row per payload that several pages share.
    shared = (p.select(key.alias("_key"), "page_id", "url").where("_key is not null and page_id is not null")
              .groupBy("_key").agg(F.min(F.struct("page_id", F.coalesce("url", F.lit("")).alias("url"))).alias("f"),
                                   F.count("*").alias("c")).where("c > 1")
              .select("_key", F.col("f.page_id").alias("first"), F.col("f.url").alias("first_url")))
    shared = durable(shared, "payloads")
    rows = (p.select("*", key.alias("key")).join(shared, F.col("key") == F.col("_key"), "left")
            .select("page_id", "url", "html", "first", "first_url"))
    (rows.mapInArrow(_written(segment_bytes, chunk), "r binary").select(F.col("r").cast("string").alias("value"))
     .write.option("lineSep", BETWEEN).option("compression", "gzip").option("maxRecordsPerFile", records).text(path))


def split_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no record at byte {at}")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        at = end + 4 + size
        if at > len(data):
            raise ValueError("record cut off")
        yield fields, data[end + 4:at]
        at += 4


def _inflated(data: bytes) -> bytes:
    """Content of a file of one or many gzip members, or of a plain one."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        z = zlib.decompressobj(31)
        out.append(z.decompress(data) + z.flush())
        data = z.unused_data
    return b"".join(out)


RECORD = ("record_id string, kind string, origin string, segment int, total long, page_id long, refers_to long, "
          "uri string, payload_digest string, payload_bytes long, block binary")
_KINDS = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(),
          pa.string(), pa.int64(), pa.binary()]
_NAMES = [x.split()[0] for x in RECORD.split(", ")]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda f, k: int(f[k]) if k in f else None
    for batch in batches:
        for k in range(batch.num_rows):
            rows = []
            for f, block in split_records(_inflated(batch.column(0)[k].as_py())):
                kind = f.get("warc-type")
                if kind in ("response", "revisit", "continuation"):
                    rid = f["warc-record-id"]
                    rows.append((rid, kind, f.get("warc-segment-origin-id", rid), number(f, "warc-segment-number"),
                                 number(f, "warc-segment-total-length"), number(f, "x-page"),
                                 number(f, "x-refers-to-page"), f.get("warc-target-uri"),
                                 f.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                                 number(f, "x-payload-length"), block))
                if len(rows) == 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], _NAMES)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], _NAMES)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(_read, RECORD)


PAGE = ("page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "ok boolean, payload binary")


def _decoded(keep: bool):
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, uri, kind, refers, said, size, whole, block in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == "revisit":
                    rows.append((page, uri, size, said, kind, refers, True, None))
                    continue
                payload = payload_of(block) if whole and block is not None else None
                ok = payload is not None and (said is None or digest(payload) == said)
                rows.append((page, uri, len(payload) if ok else None, digest(payload) if ok else None, kind, refers, ok,
                             payload if ok and keep else None))
            cols = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                             [x.split()[0] for x in PAGE.split(", ")])
    return run


def reassembled(records: DataFrame) -> DataFrame:
    """One row per response or revisit, with its whole block, and ``whole``
    false if segments are missing, repeated or of another length in total."""
    facts = ["page_id", "uri", "kind", "refers_to", "payload_digest", "payload_bytes"]
    single = records.where("segment is null and kind <> 'continuation'").select(*facts, F.lit(True).alias("whole"), "block")
    parts = records.where("segment is not null or kind = 'continuation'")
    s = F.struct(F.col("segment").alias("n"), F.col("block").alias("b"))
    first = lambda c: F.max(F.when(F.col("kind") != "continuation", F.col(c))).alias(c)
    # A group is one record's segments.
    many = parts.groupBy("origin").agg(
        F.sort_array(F.collect_list(s)).alias("parts"), F.max("total").alias("total"),
        *[first(c) for c in ("page_id", "uri", "refers_to", "payload_digest", "payload_bytes")],
        F.max(F.when(F.col("kind") != "continuation", F.col("kind"))).alias("kind"))
    numbers = F.transform("parts", lambda x: x["n"])
    block = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["b"]))
    many = many.select(*facts, "total", numbers.alias("numbers"), F.size("parts").alias("k"), block.alias("block"))
    right = ((F.col("numbers") == F.sequence(F.lit(1), F.col("k")))
             & (F.octet_length("block") == F.col("total")) & F.col("kind").isNotNull())
    return single.unionByName(many.select(*facts, F.coalesce(right, F.lit(False)).alias("whole"), "block"))


def read_pages(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """page_id, uri, payload_bytes, payload_digest, record_type, refers_to, ok
    and payload of every response and revisit below ``path``."""
    found = reassembled(read_records(spark, path))
    return found.select("page_id", "uri", "kind", "refers_to", "payload_digest", "payload_bytes", "whole",
                        "block").mapInArrow(_decoded(keep_payload), PAGE)


def archived(pages: DataFrame, segment_bytes: int = SEGMENT, keep_payload: bool = True) -> DataFrame:
    """Writes ``pages`` to the shared folder and reads them back."""
    path = shared_dir(pages.sparkSession, "warc")
    write_archives(pages, path, segment_bytes)
    return read_pages(pages.sparkSession, path, keep_payload)
