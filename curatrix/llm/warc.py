"""WARC archives: writing with revisits and segments, and reassembly on reading.

Writing gives each page one record, and records longer than a segment become a
first record and ``continuation`` records that name it in
WARC-Segment-Origin-ID. Payloads travel in HTTP responses with chunked transfer
framing. Records end in CRLF CRLF, which is the line separator of Spark's text
writer, so archives are written on any file system Spark knows, gzip compressed,
each with a bounded number of records and so a bounded size.

Reading splits archives into records by their lengths, groups those of an origin,
orders them by segment number, verifies that the numbers are complete and the
total length is as declared, and undoes the chunk framing.

Defined results: null html is an empty payload; equal payloads under
:data:`LEAST_BYTES` are all responses; among larger ones the smallest page_id
responds and the others revisit it; rows that repeat the responding page_id and
payload respond as well; null page_ids don't respond
for others, and where all are null each responds for itself; an empty table gives no rows;
columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.common import bound_batches, pieces
from curatrix.sources.store import shared_folder

LEAST_BYTES = 100
#: Block bytes of a record at most; longer ones are segmented.
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 8 << 10
#: Records of an archive file at most, so that a file holds 32 MB at most before compression.
FILE_RECORDS = 2000
DATE = "2024-01-01T00:00:00Z"
RECORD = "record_id string, record_type string, page_id long, refers_to long, origin string, segment int, total long, digest string, payload_bytes long, block binary"


def classified(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, html, payload_bytes, digest, first): first is the page_id that responds for a repeated payload, else null."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html, 256).alias("digest")
    )
    found = pages.select("page_id", html.alias("html")).filter(F.octet_length("html") >= least_bytes).select(
        F.col("page_id").cast("long").alias("page_id"), F.sha2("html", 256).alias("digest")
    )
    firsts = found.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("digest", "first")
    return rows.join(firsts, "digest", "left")


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing."""
    out = [b"%x\r\n%b\r\n" % (len(payload[k : k + size]), payload[k : k + size]) for k in range(0, len(payload), size)]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of chunked transfer framing; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        chunk = body[end + 2 : end + 2 + size]
        if len(chunk) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(chunk)
        at = end + 4 + size


def records(row: dict, segment_bytes: int, chunk_bytes: int) -> Iterator[tuple[bytes, bytes]]:
    """(head, block) of the records of one page."""
    base = f"<urn:x-page:{row['record']}>"
    payload = b"" if row["revisit"] else row["html"].encode("utf-8", "surrogatepass")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    block = http if row["revisit"] else http + chunked(payload, chunk_bytes)
    kind = "revisit" if row["revisit"] else "response"
    url = "".join(c if c > " " else "%20" for c in row["url"])
    common = [f"WARC-Target-URI: {url}", f"WARC-Date: {DATE}"]
    page = "" if row["page_id"] is None else row["page_id"]
    head = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: {base}", *common, "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{row['digest']}", f"X-Payload-Length: {row['payload_bytes']}", f"X-Page-ID: {page}"
    ]
    if row["revisit"]:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"X-Refers-To-Page-ID: {'' if row['first'] is None else row['first']}"
        ]
    pieces = [block[k : k + segment_bytes] for k in range(0, len(block), segment_bytes)]
    for n, piece in enumerate(pieces, 1):
        if n > 1:
            head = ["WARC-Type: continuation", f"WARC-Record-ID: {base[:-1]}:{n}>", *common, f"WARC-Segment-Origin-ID: {base}"]
        more = [f"WARC-Segment-Number: {n}"] if len(pieces) > 1 else []
        if n == len(pieces) > 1:
            more.append(f"WARC-Segment-Total-Length: {len(block)}")
        yield "\r\n".join(["WARC/1.1", *head, *more, f"Content-Length: {len(piece)}", "", ""]).encode("utf-8", "surrogatepass"), piece


def write_warc(pages: DataFrame, path: str, *, least_bytes: int = LEAST_BYTES, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write archives of ``pages`` (page_id, url, html) to the folder ``path``."""
    rows = classified(pages, least_bytes)
    rows = rows.withColumn("revisit", F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False)))
    # A revisit's payload isn't written.
    rows = rows.select(
        "page_id", "url", F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html")).alias("html"), "payload_bytes", "digest", "first", "revisit",
        F.expr("uuid()").alias("record")
    )
    names = rows.columns

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out, held = [], 0
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for head, block in records(dict(zip(names, values, strict=True)), segment_bytes, chunk_bytes):
                    out.append(head + block)
                    held += len(out[-1])
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                        out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    written = rows.mapInArrow(lines, "value binary").select(F.col("value").cast("string").alias("value"))
    written.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        stop = start + int(fields["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has a wrong length")
        yield fields, data[start:stop]
        at = stop + 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in ``path``, gzip compressed or not, as they stand."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("origin", pa.string()),
                ("segment", pa.int32()), ("total", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("block", pa.binary())
            ]
        )
        number = lambda v: int(v) if v else None
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                if data[:2] == b"\x1f\x8b":
                    members = []
                    while data:
                        z = zlib.decompressobj(31)
                        members.append(z.decompress(data))
                        data = z.unused_data
                    data = b"".join(members)
                rows, held = [], 0
                for f, block in parsed(data):
                    rows.append(
                        (
                            f["warc-record-id"], f["warc-type"], number(f.get("x-page-id")), number(f.get("x-refers-to-page-id")),
                            f.get("warc-segment-origin-id"), number(f.get("warc-segment-number")), number(f.get("warc-segment-total-length")),
                            f.get("warc-payload-digest", "").removeprefix("sha256:"), number(f.get("x-payload-length")), block
                        )
                    )
                    held += len(block)
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return files.mapInArrow(run, RECORD)


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" in head.lower():
        return unchunked(body)
    return body


def reassembled(found: DataFrame) -> DataFrame:
    """(record_id, record_type, page_id, refers_to, digest, payload_bytes, payload): one row a page, its segments joined."""
    whole = found.filter("segment is null").select(
        "record_id", "record_type", "page_id", "refers_to", "digest", "payload_bytes", F.array("block").alias("blocks"),
        F.length("block").cast("long").alias("total"), F.lit(True).alias("complete")
    )
    parts = found.filter("segment is not null").groupBy(F.coalesce("origin", "record_id").alias("record_id")).agg(
        *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("record_type", "page_id", "refers_to", "digest", "payload_bytes")],
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"),
    )
    parts = parts.select(
        "record_id", "record_type", "page_id", "refers_to", "digest", "payload_bytes", F.col("parts.block").alias("blocks"), "total",
        F.forall(F.transform("parts", lambda p, i: p["segment"] == i + 1), lambda ok: ok).alias("complete")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            names, payloads = batch.schema.names, []
            for record, kind, blocks, total, complete in zip(
                *(batch.column(c).to_pylist() for c in ("record_id", "record_type", "blocks", "total", "complete")), strict=True
            ):
                block = b"".join(blocks)
                if not complete or len(block) != total:
                    raise ValueError(f"record {record}: {len(block)} bytes of segments, declared are {total}")
                payloads.append(b"" if kind == "revisit" else payload_of(block))
            keep = [c for c in names if c not in ("blocks", "total", "complete")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(payloads, pa.binary())], [*keep, "payload"])

    return whole.unionByName(parts).mapInArrow(
        run, "record_id string, record_type string, page_id long, refers_to long, digest string, payload_bytes long, payload binary"
    )


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives, read them back and describe every page; responses by what was read, revisits by their record."""
    bound_batches(spark)
    path = shared_folder(spark, "warc")
    write_warc(pages, path)
    out = reassembled(read_records(spark, path))
    own = F.col("record_type") == "response"
    return out.select(
        "page_id", F.when(own, F.length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"), "record_type", "refers_to"
    )


ORACLE = f"""
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as payload_bytes, sha256(html) as payload_digest from p),
r as (select *, min(page_id) over (partition by payload_digest) as first from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= {LEAST_BYTES} and page_id <> first then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= {LEAST_BYTES} and page_id <> first then first end as refers_to
from r
"""
