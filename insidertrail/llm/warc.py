"""WARC archives: written one gzip member per record, read back in sequence with every length and digest checked."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insidertrail.llm.common import table, work_path

# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-page:"
NO_KEY = "urn:x-page-without-key:"
DATE = "2024-01-01T00:00:00Z"

# A longer block goes on in continuation records, so that a record's length stays below 2^24 bytes.
SEGMENT_BYTES = 8 << 20
READ_BYTES = 1 << 16
RECORDS_PER_ARCHIVE = 20_000


class BadRecord(ValueError):
    """An archive that breaks the format, or whose content does not match its digests."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_urn(key: str | None) -> str:
    return f"<{NO_KEY}>" if key is None else f"<{URN}{quote(key, safe='')}>"


def key_of(urn: str | None) -> str | None:
    inner = (urn or "").strip("<>")
    return unquote(inner[len(URN):]) if inner.startswith(URN) else None


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = b"\r\n".join([VERSION] + [f"{k}: {v}".encode() for k, v in fields] + [b"Content-Length: %d" % len(block)])
    packer = zlib.compressobj(wbits=31)
    return packer.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def record(key: str | None, url: str | None, payload: bytes, payload_digest: str, refers_to: str | None,
           revisit: bool) -> bytes:
    """A response, or a revisit of the record ``refers_to``: one gzip member, more for a long payload."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
    block = http if revisit else http + payload
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"{NO_KEY}target"
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_urn(key)),
              ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
              ("Content-Type", "application/http;msgtype=response")]
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_urn(refers_to))]
    parts = [block[i:i + SEGMENT_BYTES] for i in range(0, len(block), SEGMENT_BYTES)]
    members = []
    for n, part in enumerate(parts, 1):
        own = fields if n == 1 else [
            ("WARC-Type", "continuation"), ("WARC-Record-ID", f"{record_urn(key)[:-1]}/{n}>"), ("WARC-Date", DATE),
            ("WARC-Target-URI", target), ("WARC-Segment-Origin-ID", record_urn(key))]
        own = own + [("WARC-Block-Digest", f"sha1:{digest(part)}")]
        if len(parts) > 1:
            own.append(("WARC-Segment-Number", str(n)))
        if 1 < n == len(parts):
            own.append(("WARC-Segment-Total-Length", str(len(block))))
        members.append(_member(own, part))
    return b"".join(members)


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
                   revisit_from: int = 0) -> None:
    """Writes a record per row to archives in the folder ``path``.

    Of the rows with equal payloads of at least ``revisit_from`` bytes, those with the smallest key are
    responses and the others revisits of it; smaller payloads are all responses.  Null payloads are empty.
    Repeated rows with the smallest key are all responses; a row without a key is a revisit where a row with a
    key has the same payload, else a response; a null url has a placeholder as target.

    Spark's own writer stores and commits the archives, so they can go to any store it knows and a repeated
    task leaves nothing twice.  It ends every row with a separator.  A gzip member ends with the high byte of
    its length, zero below 2^24 bytes: that zero byte is the separator.
    """
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), body.alias("body"))
    rows = rows.withColumn("digest", F.sha1("body")).withColumn("size", F.octet_length("body"))
    shared = (rows.filter(F.col("size") >= revisit_from).groupBy("digest", "size")
              .agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    told = rows.join(shared.hint("shuffle_hash"), ["digest", "size"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                out = []
                for row in batch.slice(start, 64).to_pylist():
                    sha1 = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                    out.append(record(row["key"], row["url"], row["body"], sha1, row["first"], row["revisit"]))
                assert all(x[-1] == 0 for x in out)
                yield pa.RecordBatch.from_arrays([pa.array([x[:-1] for x in out], pa.binary())], ["member"])

    members = told.select(F.col("key").cast("string").alias("key"), "url", "body", "digest",
                          F.col("first").cast("string").alias("first"), revisit.alias("revisit")).mapInArrow(run, "member binary")
    (members.select(F.col("member").cast("string")).write.option("lineSep", "\0")
     .option("maxRecordsPerFile", RECORDS_PER_ARCHIVE).text(path))


class Member:
    """One gzip member, unpacked piece by piece as its record is read."""

    def __init__(self, data: memoryview, start: int):
        self.data, self.at, self.held = data, start, bytearray()
        self.unpacker = zlib.decompressobj(wbits=31)

    def more(self) -> bool:
        if self.unpacker.eof:
            return False
        piece = self.data[self.at:self.at + READ_BYTES]
        if not piece:
            raise BadRecord("the archive ends within a record")
        try:
            self.held += self.unpacker.decompress(piece)
        except zlib.error as error:
            raise BadRecord(f"not a gzip member: {error}") from error
        self.at += len(piece) - len(self.unpacker.unused_data)
        return True

    def head(self) -> bytes:
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            if not self.more():
                raise BadRecord("a record without an end of its header")
        return self.take(end + 4)[:end]

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise BadRecord("a record shorter than its length says")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def finish(self) -> int:
        if self.take(4) != b"\r\n\r\n":
            raise BadRecord("a record longer than its length says")
        while self.more():
            pass
        if self.held:
            raise BadRecord("more than one record in a member")
        return self.at


def _fields(head: bytes) -> dict[str, str]:
    first, *lines = head.split(b"\r\n")
    if not re.fullmatch(rb"WARC/\d\.\d", first):
        raise BadRecord("a record that does not begin with a version")
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _checked(data: bytes, stated: str | None, what: str) -> None:
    if stated and stated.lower().startswith("sha1:") and stated[5:].upper() != digest(data):
        raise BadRecord(f"the digest of the {what} does not match")


def single_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of each record of an archive, in sequence."""
    view, at = memoryview(data), 0
    while at < len(view):
        member = Member(view, at)
        fields = _fields(member.head())
        if not fields.get("content-length", "").isdigit():
            raise BadRecord("a record without a length")
        block = member.take(int(fields["content-length"]))
        at = member.finish()
        _checked(block, fields.get("warc-block-digest"), "block")
        yield fields, block


def read_records(data: bytes) -> Iterator[dict]:
    """Responses and revisits of an archive, segments put together, digests verified.

    What breaks off the reading comes last, as a row with ``problem`` alone.
    """
    held: tuple[dict, list[bytes]] | None = None
    try:
        for fields, block in single_records(data):
            follows = fields.get("warc-type") == "continuation"
            if follows:
                if not held or fields.get("warc-segment-origin-id") != held[0].get("warc-record-id"):
                    raise BadRecord("a continuation without its beginning")
                held[1].append(block)
            elif held:
                raise BadRecord("a record without its end")
            elif "warc-segment-number" in fields:
                held = (fields, [block])
            else:
                yield _row(fields, block)
            if follows and "warc-segment-total-length" in fields:
                first, parts = held
                held, whole = None, b"".join(parts)
                if str(len(whole)) != fields["warc-segment-total-length"]:
                    raise BadRecord("segments of another length than stated")
                yield _row(first, whole)
        if held:
            raise BadRecord("a record without its end")
    except BadRecord as error:
        yield {"problem": str(error)}


def _row(fields: dict[str, str], block: bytes) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    stated = fields.get("warc-payload-digest", "")
    if fields.get("warc-type") == "response":
        _checked(payload, stated, "payload")
        if length and int(length[1]) != len(payload):
            raise BadRecord("a payload of another length than stated")
    else:
        payload = None
    return {"record_key": key_of(fields.get("warc-record-id")), "record_type": fields.get("warc-type"),
            "target": fields.get("warc-target-uri"), "refers_to_key": key_of(fields.get("warc-refers-to")),
            "payload_digest": stated.removeprefix("sha1:"), "payload_bytes": int(length[1]) if length else None,
            "payload": payload, "problem": None}


ROW = pa.schema([("record_key", pa.string()), ("record_type", pa.string()), ("target", pa.string()),
                 ("refers_to_key", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                 ("payload", pa.binary()), ("problem", pa.string())])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per response or revisit of all archives in the folder ``path``; each archive is read in sequence.

    Columns: record_key, record_type, target, refers_to_key, payload_digest and payload_bytes (both of the full
    payload), payload (null for revisits) and problem, null but for an archive whose reading broke off.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                some: list[dict] = []
                for row in read_records(data.as_buffer().to_pybytes()):
                    some.append(row)
                    if len(some) == 256:
                        yield pa.RecordBatch.from_pylist(some, ROW)
                        some = []
                if some:
                    yield pa.RecordBatch.from_pylist(some, ROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(
        run, "record_key string, record_type string, target string, refers_to_key string, payload_digest string, "
             "payload_bytes long, payload binary, problem string")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    found = read_archives(spark, path)
    return found.select(F.col("record_key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        F.col("refers_to_key").cast("long").alias("refers_to"), "problem")


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP4_SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS size, sha1(coalesce(html, '')) AS hex FROM pages),
firsts AS (SELECT hex, size, min(page_id) AS first FROM p GROUP BY hex, size)
SELECT page_id, size::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('{_BASE32}', 1 + (
         (('0x' || substr(p.hex, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), 'string_agg', '')
         AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, NULL::VARCHAR AS problem
FROM p JOIN firsts USING (hex, size)
"""
