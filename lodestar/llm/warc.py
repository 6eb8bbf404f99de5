"""WARC archives: writing with revisits and segments, reading with segment reassembly.

Writing: pages whose payloads are equal are found by digest on narrow rows; the smallest page_id's record is the response, the
others revisit it. Blocks are HTTP messages in chunked transfer framing; a block longer than a segment is cut into a first
record and continuation records. Records are gzip members, packed into archives of a bounded size, one row each, which
Spark's own writer puts into the shared folder (so its commit protocol holds when executors are lost).

Reading: archives are parsed record by record; continuation records are grouped by the identifier of their origin, ordered by
segment number, checked against the total length, and the chunked framing of the whole block is decoded. A group is one
record's segments. Payloads are checked against their digest.

Defined cases: a null html is an empty payload; a null url has no target header; a null page_id is not the smallest unless all
are null, and then its record is a response; rows equal in page_id and payload are the same record and treated alike; an
empty table gives an empty archive. Extra columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch, small, table

SEGMENT = 8 << 10  # bytes of a block in one record
CHUNK = 4 << 10  # bytes in one chunk of the transfer framing
ARCHIVE = 8 << 20  # bytes of an archive, give or take a record
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An empty gzip member without its last byte, which is the writer's line separator.
_EMPTY = zlib.compressobj(6, zlib.DEFLATED, 31).flush()


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of 40 hex digits: five of them are four letters."""
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{digest}')}>"


def chunked(payload: bytes) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(x), x) for i in range(0, len(payload), CHUNK) if (x := payload[i : i + CHUNK])]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        if len(out[-1]) != n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = end + 4 + n


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, revisits: bool, refers_to: int | None) -> list[bytes]:
    """A page's records: a response, cut into segments where it is long, or a revisit."""
    target = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    own = record_id(page_id, digest)
    head = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("Page-ID", page_id)]
    if revisits:
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        return [record([("WARC-Type", "revisit"), *head, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("Refers-To-Page-ID", refers_to)], http)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    if len(parts) == 1:
        return [record([("WARC-Type", "response"), *head], block)]
    out = [record([("WARC-Type", "response"), *head, ("WARC-Segment-Number", 1)], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        total = len(block) if k == len(parts) else None
        part_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{own}|{k}')}>"
        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", part_id), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total)], part))
    return out


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(r_id, r_digest, refers_to) of the pages that revisit another's record; pages: page_id, size, digest."""
    firsts = pages.filter(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 AND refers_to IS NOT NULL")
    firsts = small(materialize(firsts.select("digest", "refers_to"), "warc-firsts"))
    later = pages.filter(F.col("size") >= least_bytes).join(firsts, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return later.select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to").distinct()


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Archives page_id, url and html under path."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", base32_of_hex(F.sha1(F.encode("html", "UTF-8"))))
    again = small(materialize(revisits(rows.select("page_id", "digest", F.octet_length("html").alias("size")), least_bytes), "warc-revisits"))
    typed = rows.join(again, rows["page_id"].eqNullSafe(again["r_id"]) & (rows["digest"] == again["r_digest"]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        close = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held) + _EMPTY[:-1]], pa.binary())], ["archive"])
        for batch in batches:
            for page_id, url, html, digest, other, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                for r in page_records(page_id, url, html.encode(), digest, other is not None, refers_to):
                    z = zlib.compressobj(4, zlib.DEFLATED, 31)
                    held.append(z.compress(r) + z.flush())
                    size += len(held[-1])
                    if size >= ARCHIVE:
                        yield close()
                        held, size = [], 0
        if held:
            yield close()

    archives = typed.select("page_id", "url", "html", "digest", F.col("r_digest").alias("other"), "refers_to").mapInArrow(run, "archive binary")
    archives.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of an archive of gzip members."""
    at = 0
    while at < len(data):
        z = zlib.decompressobj(31)
        parts = []
        while not z.eof and at < len(data):  # in steps, so that what follows a member is not copied each time
            parts.append(z.decompress(data[at : at + (16 << 10)]))
            at += 16 << 10
        if not z.eof:
            raise ValueError("an archive is cut short")
        at = min(at, len(data)) - len(z.unused_data)
        got = b"".join(parts)
        p = 0
        while p < len(got):
            end = got.index(b"\r\n\r\n", p)
            first, *lines = got[p:end].decode().split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError(f"not a record: {first[:40]!r}")
            headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            n = int(headers["content-length"])
            block = got[end + 4 : end + 4 + n]
            if len(block) != n or got[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
                raise ValueError("a record is cut short")
            yield headers, block
            p = end + 8 + n


PARSED = "origin string, number int, total long, page_id long, url string, record_type string, refers_to long, digest string, block binary"
READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _int(x: str | None) -> int | None:
    return None if x is None else int(x)


def finish(row: tuple, with_payload: bool) -> tuple:
    """(page_id, url, record_type, refers_to, digest, block) -> a row of READ, checked."""
    page_id, url, kind, refers_to, digest, block = row
    head, _, body = block.partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if kind == "revisit":
        return page_id, url, kind, refers_to, int(http[b"content-length"]), digest, None
    payload = unchunked(body) if http.get(b"transfer-encoding") == b"chunked" else body
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if digest and own != digest:
        raise ValueError(f"page {page_id}: the payload's digest is {own}, not {digest}")
    return page_id, url, kind, refers_to, len(payload), own, payload if with_payload else None


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = _arrow_schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The archives' page records, reassembled: READ's columns; a revisit has no payload."""
    kinds = {"response", "revisit"}

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for h, block in parse(data.as_py()):
                    number = _int(h.get("warc-segment-number"))
                    if h["warc-type"] in kinds:
                        digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
                        row = (h["warc-record-id"], number, None, _int(h.get("page-id")), h.get("warc-target-uri"), h["warc-type"], _int(h.get("refers-to-page-id")), digest)
                        if number is None:  # whole: what is left to do is done here
                            done = finish((*row[3:], block), with_payload)
                            row, block = (*row[:2], done[4], *row[3:7], done[5]), done[6]
                        rows.append((*row, block))
                    elif h["warc-type"] == "continuation":
                        rows.append((h["warc-segment-origin-id"], number, _int(h.get("warc-segment-total-length")), None, None, None, None, None, block))
                    else:
                        continue
                    size += len(block or b"") + 200
                    if size > 4 << 20:
                        yield _batch(rows, PARSED)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, PARSED)

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segments in batch.column(0):
                parts = sorted(segments.as_py(), key=lambda s: s["number"])
                first, last = parts[0], parts[-1]
                block = b"".join(s["block"] for s in parts)
                if [s["number"] for s in parts] != list(range(1, len(parts) + 1)) or last["total"] != len(block):
                    raise ValueError(f"page {first['page_id']}: {len(parts)} segments of {len(block)} bytes, {last['total']} expected")
                yield _batch([finish((first["page_id"], first["url"], first["record_type"], first["refers_to"], first["digest"], block), with_payload)], READ)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    parsed = files.mapInArrow(records, PARSED)
    whole = parsed.filter("number IS NULL").select("page_id", "url", "record_type", "refers_to", F.col("total").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("block").alias("payload"))
    # a repeated row's segments repeat too; the file and the copies are equal, so one of each number is enough for each copy
    cut = parsed.filter("number IS NOT NULL").groupBy("origin", "number").agg(F.first(F.struct("number", "total", "page_id", "url", "record_type", "refers_to", "digest", "block")).alias("segment"), F.count("*").alias("copies"))
    groups = cut.groupBy("origin").agg(F.collect_list("segment").alias("segments"), F.max("copies").alias("copies"))
    joined = groups.select(F.explode(F.array_repeat("segments", F.col("copies").cast("int"))).alias("segments")).mapInArrow(reassemble, READ)
    return whole.unionByName(joined)


def op5_warc(spark, sf_dir):
    path = scratch(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x FROM p),
e AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  (((('0x' || substr(x, (i // 4 * 5 + 1)::BIGINT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  min(page_id) OVER (PARTITION BY x) AS least FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = least THEN NULL ELSE least END AS refers_to FROM e
"""
