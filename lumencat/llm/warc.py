"""Operator 5: WARC archives, written from pages and read back as one nested row for each capture.

Writing. A page becomes three records: the request, the response and a metadata record with the page's id. Request and
metadata name the response in WARC-Concurrent-To. Of pages with equal payloads of at least ``min_bytes`` bytes, the one of
the smallest id is a response; the others are revisit records that refer to it and hold no payload. Records are written by
Spark's text sink, whose line separator is the blank lines that end a record, gzip-compressed (one member a file, as that
sink makes it); a task's first record is a warcinfo record.

Reading. Files are unpacked and parsed record by record, by Content-Length. Requests and metadata are joined to responses and revisits through the
concurrent-to ids, and a revisit takes its payload's size and digest, computed from the payload as read, from the response that it refers to.

Scale: equal payloads are found by an aggregate of digests with map-side combining and a join adaptive execution may split,
so that a payload of a third of all pages is no single task's work; likewise when revisits meet their response. Payloads
pass one shuffle when written and none when read, unless asked for. A file holds RECORDS_PER_FILE records at most, and
fewer where pages are long on average, for about FILE_BYTES; a reader holds a file's packed bytes and one record.

Defined cases: null html is an empty payload, which is a payload like others (all empty pages revisit the first); a null
page id comes back null and is never the smallest; null urls come back null; line ends in a url are percent-encoded;
repeated rows come back as often as they occur, as responses if they have the smallest id; extra columns are not read; an
empty table gives no archive records and an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumencat.llm.common import pieces, scratch, stored, table

RECORDS_PER_FILE = 3000
FILE_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BATCH_ROWS = 500
END = b"\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, block: str, **fields: str | None) -> str:
    """A record without the blank lines that end it."""
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {DATE}"]
    head += [f"{name.replace('_', '-')}: {value}" for name, value in fields.items() if value is not None]
    return "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block.encode())}", "", block])


def _uuid(hexed: str) -> str:
    return f"{hexed[:8]}-{hexed[8:12]}-{hexed[12:16]}-{hexed[16:20]}-{hexed[20:32]}"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    about = record("warcinfo", _uuid(hashlib.md5(str(TaskContext.get().partitionId()).encode()).hexdigest()), "format: WARC File Format 1.1\r\n", Content_Type="application/warc-fields")
    out = [about]
    for whole in pieces(batches, BATCH_BYTES, "html"):
        for lo in range(0, whole.num_rows, BATCH_ROWS):
            for r in whole.slice(lo, BATCH_ROWS).to_pylist():
                own, html = _uuid(r["own"]), r["html"]
                url = None if r["url"] is None else r["url"].replace("\r", "%0D").replace("\n", "%0A")
                about = {"WARC_Target_URI": url, "WARC_Concurrent_To": f"<urn:uuid:{own}>"}
                path = "/" + (url or "").partition("//")[2].partition("/")[2]
                host = (url or "").partition("//")[2].partition("/")[0]
                out.append(record("request", _uuid(r["request"]), f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n", **about, Content_Type="application/http; msgtype=request"))
                size = len(html.encode())
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
                fields = {"WARC_Target_URI": url, "Content_Type": "application/http; msgtype=response", "WARC_Payload_Digest": "sha1:" + payload_digest(html.encode())}
                if r["refers"] is None:
                    out.append(record("response", own, http + html, **fields))
                else:
                    out.append(record("revisit", own, http, **fields, WARC_Refers_To=f"<urn:uuid:{_uuid(r['refers'])}>", WARC_Profile=PROFILE))
                number = "" if r["page_id"] is None else r["page_id"]
                out.append(record("metadata", _uuid(r["metadata"]), f"page_id: {number}\r\npayload_bytes: {size}\r\n", **about, Content_Type="application/warc-fields"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
            out = []


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Writes pages (page_id, url, html) as gzip-compressed WARC files below path."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("sha", F.sha1("html"))
    large = F.octet_length("html") >= min_bytes
    # of equal payloads the smallest id, and the url that is in its record's id
    first = p.where(large).groupBy("sha").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("f"), F.count("*").alias("n")).where("n > 1").select("sha", "f.page_id", "f.url").toDF("sha", "first_id", "first_url")
    name = lambda kind, key, url: F.md5(F.concat_ws("\n", F.lit(kind), F.col("sha"), F.coalesce(F.col(key).cast("string"), F.lit("-")), F.coalesce(F.col(url), F.lit("-"))))
    is_first = F.col("page_id").eqNullSafe(F.col("first_id"))
    joined = p.join(first, "sha", "left").select(
        "page_id", "url", "html", name("response", "page_id", "url").alias("own"), name("request", "page_id", "url").alias("request"), name("metadata", "page_id", "url").alias("metadata"),
        F.when(large & F.col("first_id").isNotNull() & ~is_first, name("response", "first_id", "first_url")).alias("refers"),
    )
    mean = p.agg(F.avg(F.octet_length("html"))).first()[0] or 0
    most = max(3, min(RECORDS_PER_FILE, int(3 * FILE_BYTES / (mean + 1000))))
    joined.mapInArrow(_records, "value string").write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def parse(archive: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an uncompressed archive, one after the other."""
    while line := archive.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:20]!r}")
        head = {}
        while (line := archive.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        size = int(head["content-length"])
        block = archive.read(size)
        if len(block) < size or archive.read(len(END)) != END:
            raise ValueError("a WARC record is cut off")
        yield head, block


_READ = "kind string, record_id string, uri string, concurrent_to string, refers_to string, date string, fields string, payload_bytes long, payload_digest string, sound boolean"


def _parsed(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for content in whole.column("content"):
                rows = []
                held = 0
                for head, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())), 1 << 20)):
                    kind = head.get("warc-type")
                    if kind == "warcinfo":
                        continue
                    body = block.partition(END)[2] if kind == "response" else b""
                    own = payload_digest(body) if kind == "response" else None
                    told = head.get("warc-payload-digest", "").partition(":")[2] or None
                    row = (kind, head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-date"), block.decode("utf-8", "replace") if kind in ("metadata", "request") else None, len(body) if own else None, own or told, own is None or told is None or own == told)
                    rows.append((*row, body if own else None) if with_payload else row)
                    held += len(body) + 500
                    if held > 16 << 20:
                        yield _batch(rows, with_payload)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, with_payload)

    return run


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    types = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.bool_()] + [pa.binary()] * with_payload
    names = [f.split()[0] for f in _READ.split(", ")] + ["payload"] * with_payload
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def captures(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row for each response or revisit, with its request and metadata.

    (page_id, url, record_id, record_type, payload_bytes, payload_digest, refers_to, refers_to_page, verified,
    request struct<record_id, http>, metadata struct<record_id, fields>[, payload]). verified: the payload has the digest
    that its record tells, a revisit's response too. payload is that of the own record; a revisit has none.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    records = files.mapInArrow(_parsed(with_payload), _READ + ", payload binary" * with_payload)
    if not with_payload:
        records = stored(records, "records")
    # ids are unique in sound archives; if one repeats, the first of its records in order counts
    asked = records.where("kind = 'request'").groupBy("concurrent_to").agg(F.min(F.struct("record_id", F.col("fields").alias("http"))).alias("request")).withColumnRenamed("concurrent_to", "asked")
    told = records.where("kind = 'metadata'").groupBy("concurrent_to").agg(F.min(F.struct("record_id", "fields")).alias("metadata")).withColumnRenamed("concurrent_to", "told")
    main = records.where("kind in ('response', 'revisit')")
    page = F.regexp_extract(F.col("metadata.fields"), r"(?:^|\n)page_id: *(-?\d+)", 1)
    one = main.join(asked, main.record_id == asked.asked, "left").join(told, main.record_id == told.told, "left").withColumn("page_id", F.when(page != "", page.cast("long"))).drop("asked", "told")
    origin = one.where("kind = 'response'").groupBy(F.col("record_id").alias("origin")).agg(F.min("page_id").alias("refers_to_page"), F.min("payload_bytes").alias("origin_bytes"), F.min("payload_digest").alias("origin_digest"), F.bool_and("sound").alias("origin_sound"))
    # records that refer to nothing get a key of their own: nulls would all meet in one task
    key = F.coalesce("refers_to", F.concat(F.lit("-"), F.col("record_id")))
    whole = one.withColumn("key", key).join(origin, F.col("key") == F.col("origin"), "left")
    revisit = F.col("kind") == "revisit"
    return whole.select(
        "page_id", F.col("uri").alias("url"), "record_id", F.col("kind").alias("record_type"),
        F.when(revisit, F.col("origin_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("origin_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "refers_to", "refers_to_page",
        F.when(revisit, F.coalesce(F.col("origin_sound") & (F.col("origin_digest") == F.col("payload_digest")), F.lit(False))).otherwise(F.col("sound")).alias("verified"),
        "request", "metadata", *["payload"] * with_payload,
    )


def op5_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return captures(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"), "url", "verified", "request", "metadata")
