"""WARC archives: one gzip member per record, and a sequential reader.

The reader inflates a file piece by piece; members end where zlib says so, records are framed by their
Content-Length, and block and payload digests are recomputed and compared. Files are rolled at ``FILE_BYTES``,
so that a task holds one file at most (a longer single record is a file of its own).

Defined results: a null html is an empty payload; of equal payloads the row with the smallest page_id is the
response (a null page_id comes last; among rows of equal id the first read), the others revisit it; an empty
table writes and reads nothing; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import bounded, table, work_dir, write_shared

FILE_BYTES = 32 << 20
LEVEL = 4
_DATE = datetime(2024, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_ID = "urn:weftline:page:"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page: str, url: str | None, payload: bytes, refers: str | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP headers only. Page ids are texts; "null" for none."""
    block = _HTTP + (payload if refers is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <{_ID}{page}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"X-Payload-Length: {len(payload)}",  # a revisit has no payload to measure
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        # header values hold no line breaks
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    if refers is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_ID}{refers}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(data: memoryview, step: int = 1 << 16) -> Iterator[bytes]:
    """The inflated gzip members, one after the other. A cut-off member is an error."""
    at = 0
    while at < len(data):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(data):
                raise ValueError("WARC: the last gzip member is cut off")
            piece = data[at : at + step]
            out.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one record, framed by Content-Length; digests must hold."""
    cut = data.index(b"\r\n\r\n")
    lines = data[:cut].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"WARC: no version line but {lines[0][:40]!r}")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(head["content-length"])
    block = data[cut + 4 : cut + 4 + size]
    if len(block) != size or data[cut + 4 + size :] != b"\r\n\r\n":
        raise ValueError("WARC: the block does not fill its Content-Length")
    if (said := head.get("warc-block-digest")) and said != "sha1:" + sha1_base32(block):
        raise ValueError(f"WARC: block digest of {head.get('warc-record-id')} does not hold")
    if head.get("warc-type") == "response" and (said := head.get("warc-payload-digest")):
        if said != "sha1:" + sha1_base32(block.partition(b"\r\n\r\n")[2]):
            raise ValueError(f"WARC: payload digest of {head.get('warc-record-id')} does not hold")
    return head, block


def _page(uri: str | None) -> int | None:
    """The page of a record's id; null for ids that ``write`` has not made."""
    text = (uri or "").strip("<>").removeprefix(_ID)
    return int(text) if re.fullmatch(r"-?[0-9]{1,19}", text) else None


def described(head: dict[str, str], block: bytes) -> tuple[int | None, str | None, bytes | None]:
    """(payload length, digest, payload) of a record. A response's payload, behind its HTTP head, and any other record's
    block are measured; of a revisit, which has none, what the record says of it, or null."""
    said = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if head.get("warc-type") == "revisit":
        return int(head["x-payload-length"]) if "x-payload-length" in head else None, said, None
    payload = block.partition(b"\r\n\r\n")[2] if head.get("warc-type") == "response" else block
    return len(payload), said or sha1_base32(payload), payload


def with_refers(pages: DataFrame, least: int = 0) -> DataFrame:
    """Adds refers_to: the smallest page_id of equal payloads of at least ``least`` bytes, for all rows but that one.

    Digests are counted before the shuffle, and only those of several rows are joined; Spark splits a hot one.
    """
    rows = pages.withColumn("_row", F.monotonically_increasing_id()).withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumn("_sha", F.when(F.octet_length("html") >= least, F.unhex(F.sha1(F.col("html").cast("binary")))))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "_row")
    firsts = rows.where("_sha IS NOT NULL").groupBy("_sha").agg(F.min(order).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    joined = rows.join(firsts, "_sha", "left")
    other = F.col("_first").isNotNull() & (F.col("_first._row") != F.col("_row"))
    return joined.select(*pages.columns, other.alias("revisits"), F.when(other, F.col("_first.page_id")).alias("refers_to"))


def write(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes (page_id, url, html, revisits, refers_to) rows to .warc.gz files; (file, records, bytes) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, files, held, size = TaskContext.get().partitionId(), [], [], 0

        def close() -> None:
            nonlocal held, size
            name = f"{folder}/part-{part:06d}-{len(files):05d}.warc.gz"
            write_shared(name, b"".join(held))
            files.append((name, len(held), size))
            held, size = [], 0

        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "html", "revisits", "refers_to")]
            for i in range(batch.num_rows):
                page, url, html, revisits, refers = (c[i].as_py() for c in cols)
                name = lambda x: "null" if x is None else str(x)
                data = member(record(name(page), url, html.encode(), name(refers) if revisits else None))
                if held and size + len(data) > file_bytes:
                    close()
                held.append(data)
                size += len(data)
        if held:
            close()
        if files:
            f, n, b = zip(*files, strict=True)
            yield pa.record_batch([pa.array(f), pa.array(n, pa.int64()), pa.array(b, pa.int64())], names=["file", "records", "bytes"])

    bounded(pages.sparkSession, 8 << 20)
    cols = pages.select("page_id", "url", "html", "revisits", "refers_to")
    return cols.mapInArrow(run, "file string, records bigint, bytes bigint")


READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row for every record of the folder's .warc.gz files, whoever wrote them, as ``described``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for data in members(memoryview(content.as_buffer())):
                    head, block = parse(data)
                    length, digest, body = described(head, block)
                    body = body if payloads else None
                    rows.append((_page(head.get("warc-record-id")), head.get("warc-target-uri"), length, digest, head.get("warc-type"), _page(head.get("warc-refers-to")), body))
                    size += len(body or b"")
                    if size > 8 << 20 or len(rows) >= 10_000:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")
    return files.mapInArrow(run, READ)


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = work_dir(spark, "warc")
    done = write(with_refers(pages), folder).agg(F.sum("records")).first()[0]
    if not done:
        return spark.createDataFrame([], READ).drop("url", "payload")
    return read(spark, folder, payloads=False).drop("url", "payload")


ORACLE = """
WITH p AS (SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT *, first_value(page_id) OVER w AS first_id, first_value(r) OVER w AS first_r FROM p
      WINDOW w AS (PARTITION BY h ORDER BY page_id NULLS LAST, r)),
x AS (SELECT *, unhex(sha1(h)) AS s FROM f)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
       (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + CAST('0b' || substr(CAST(CAST(s AS BIT) AS VARCHAR), 1 + 5 * i, 5) AS INT), 1), '' ORDER BY i) FROM unnest(range(0, 32)) AS u(i)) AS payload_digest,
       CASE WHEN r = first_r THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN r <> first_r THEN first_id END AS refers_to
FROM x"""
