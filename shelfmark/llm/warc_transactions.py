"""WARC: write captures as archives, read archives, assemble the records of each capture into one row.

Writing is plain Spark: every page becomes the text of its three records (request, response or revisit,
metadata) and Spark's text writer ends each with the blank lines that end a record. Of equal payloads
of at least ``REVISIT_BYTES`` the one with the largest page_id (then url) is a response and the others
revisit it; only payload digests that occur twice are joined back.
Reading parses each archive file by its Content-Length headers, plain or gzip, in the task that holds
it; files are kept small by ``PAGES_PER_ARCHIVE``. Assembly joins request and metadata records to the
response or revisit they are concurrent to, and revisits to the response they refer to.

A null html is an empty payload. Pages without an id are written and come back without one. Repeated
rows give equal records; each comes back. A record cut short ends its file as type ``damaged``.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfmark.llm.common import checked, written
from shelfmark.session import shared_folder

REVISIT_BYTES = 1000
PAGES_PER_ARCHIVE = 4000
# Fixed values of the format.
VERSION = "WARC/1.1"
END = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = (
    "type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, "
    "payload_digest string, block string, payload_bytes long, payload binary"
)


def _record_id(kind: str, page: str = "") -> Column:
    page_id, url = F.col(f"{page}page_id").cast("string"), F.col(f"{page}url")
    digest = F.md5(F.concat_ws("\x00", F.lit(kind), F.coalesce(page_id, F.lit("-")), F.coalesce(url, F.lit("-")), "digest"))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(digest, a, n) for a, n in cuts]), F.lit(">"))


def _record(kind: Column | str, headers: list[tuple[str, Column]], block: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit(VERSION), F.concat(F.lit("WARC-Type: "), kind)]
    # a header without a value is left out by concat_ws
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(END, *lines), F.lit(END + END), block)


def transactions(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(value): the three records of each page (page_id, url, html), without the end of the last."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("n", F.octet_length("html"))
    first = (
        rows.where(F.col("n") >= REVISIT_BYTES).groupBy("digest")
        .agg(F.max(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
        .select(F.col("digest").alias("again"), "first", _record_id("response", "first.").alias("first_id"))
    )
    first = checked(written(first))
    # small payloads find nothing and are spread
    meet = F.when(F.col("n") >= REVISIT_BYTES, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    rows = rows.join(first, meet == F.col("again"), "left")
    revisits = F.coalesce(~F.struct("page_id", "url").eqNullSafe(F.col("first")), F.lit(False)) & F.col("first_id").isNotNull()
    uri = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7F]", "%20")
    line = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{END}{END}"))
    answer = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("n").cast("string"), F.lit(END + END))
    fields = F.concat_ws(END, F.concat(F.lit("pageId: "), F.col("page_id").cast("string")), F.concat(F.lit("payloadBytes: "), F.col("n").cast("string")))
    day, main = F.lit(date), _record_id("response")
    shared = [("WARC-Target-URI", uri), ("WARC-Date", day)]
    request = _record("request", [("WARC-Record-ID", _record_id("request")), ("WARC-Concurrent-To", main), *shared, ("Content-Type", F.lit("application/http;msgtype=request"))], line)
    response = _record(
        F.when(revisits, F.lit("revisit")).otherwise(F.lit("response")),
        [("WARC-Record-ID", main), *shared, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
         ("WARC-Refers-To", F.when(revisits, F.col("first_id"))), ("WARC-Profile", F.when(revisits, F.lit(REVISIT_PROFILE))),
         ("Content-Type", F.lit("application/http;msgtype=response"))],
        F.concat(answer, F.when(revisits, F.lit("")).otherwise(F.col("html"))),
    )
    metadata = _record("metadata", [("WARC-Record-ID", _record_id("metadata")), ("WARC-Concurrent-To", main), *shared, ("Content-Type", F.lit("application/warc-fields"))], fields)
    return rows.select(F.concat_ws(END + END, request, response, metadata).alias("value"))


def write_archives(pages: DataFrame, path: str, pages_per_archive: int = PAGES_PER_ARCHIVE) -> None:
    """Gzip archives under ``path``; a file holds at most so many pages."""
    writer = transactions(pages).write.option("lineSep", END + END).option("maxRecordsPerFile", pages_per_archive)
    writer.text(path, compression="gzip")


def parse_archive(data: bytes) -> Iterator[dict]:
    """The records of one archive, in order."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    view, at, n = memoryview(data), 0, len(data)
    while at < n:
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        stop = data.find(b"\r\n\r\n", at)
        lines = bytes(view[at:stop]).decode("utf-8", "replace").split("\r\n") if stop >= 0 else []
        pairs = [line.partition(":")[::2] for line in lines[1:]]
        headers = {name.strip().lower(): value.strip() for name, value in pairs}
        size = headers.get("content-length", "")
        if not lines or not lines[0].startswith("WARC/") or not size.isdigit() or stop + 4 + int(size) > n:
            yield {"type": "damaged", "record_id": headers.get("warc-record-id")}
            return
        begin = stop + 4
        at = begin + int(size)
        block = view[begin:at]
        record = {
            "type": headers.get("warc-type"), "record_id": headers.get("warc-record-id"), "concurrent_to": headers.get("warc-concurrent-to"),
            "refers_to": headers.get("warc-refers-to"), "target_uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"),
            "payload_digest": headers.get("warc-payload-digest"),
        }
        if record["type"] in ("response", "resource"):
            inner = data.find(b"\r\n\r\n", begin, at) if record["type"] == "response" else begin - 4
            payload = bytes(view[inner + 4 : at]) if inner >= 0 else bytes(block)
            record |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}
        elif record["type"] in ("request", "metadata", "warcinfo"):
            record["block"] = bytes(block).decode("utf-8", "replace")
        yield record


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {
        "type": pa.string(), "record_id": pa.string(), "concurrent_to": pa.string(), "refers_to": pa.string(), "target_uri": pa.string(),
        "date": pa.string(), "payload_digest": pa.string(), "block": pa.string(), "payload_bytes": pa.int64(), "payload": pa.binary(),
    }

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in kinds.items()], names=list(kinds))

    for batch in batches:
        for data in batch.column("content"):
            rows, held = [], 0
            for record in parse_archive(data.as_py()):
                rows.append(record)
                held += len(record.get("payload") or b"") + 500
                if held > 8 << 20:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record. A response's digest and length are those of the payload that was read."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parse_batches, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: request, response (or revisit), metadata and, of a revisit, what it refers to.

    Of several requests or metadata records of one capture the first by record id is nested. Records
    concurrent to nothing known are left out; captures without a request or metadata stay.
    """
    small = records.where(F.col("type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    nested = F.struct("record_id", "target_uri", "date", "block")
    attached = written(
        small.groupBy(F.col("concurrent_to").alias("main_id")).agg(
            F.min(F.when(F.col("type") == "request", nested)).alias("request"),
            F.min(F.when(F.col("type") == "metadata", nested)).alias("metadata"),
        )
    )
    main = records.where(F.col("type").isin("response", "revisit", "resource"))
    captures = main.join(attached, F.col("record_id") == F.col("main_id"), "left").drop("main_id", "concurrent_to", "block")
    wanted = main.where("type = 'revisit'").select(F.col("refers_to").alias("record_id")).distinct()
    # one row per record id on either side, so that repeated records meet once
    known = records.where(F.col("type").isin("response", "resource") & F.col("record_id").isNotNull()).join(wanted, "record_id", "left_semi")
    known = known.groupBy(F.col("record_id").alias("original_id")).agg(F.min(F.struct("payload_digest", "payload_bytes")).alias("found"))
    fields = attached.select("main_id", F.col("metadata.block").alias("fields"))
    originals = known.join(fields, F.col("original_id") == F.col("main_id"), "left").select(
        "original_id", F.struct("found.payload_digest", "found.payload_bytes", "fields").alias("original")
    )
    originals = checked(written(originals))
    revisits = captures.where("type = 'revisit'").join(originals, F.col("refers_to") == F.col("original_id"), "left").drop("original_id")
    others = captures.where("type <> 'revisit'").withColumn("original", F.lit(None).cast(originals.schema["original"].dataType))
    return revisits.unionByName(others).withColumnRenamed("type", "record_type")


def field_of(block: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(block, rf"(?m)^{name}: (.*?)\r?$", 1), F.lit("")).cast("bigint")


def op1_warc_transactions(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{folder}/pages.parquet"), path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    captures = assemble(written(read_archives(spark, path).drop("payload")))
    return captures.select(
        field_of(F.col("metadata.block"), "pageId").alias("page_id"),
        F.coalesce("payload_bytes", "original.payload_bytes").alias("payload_bytes"),
        F.when(F.col("record_type") == "revisit", F.col("original.payload_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        field_of(F.col("original.fields"), "pageId").alias("refers_to"),
    )


OP1_SQL = """
WITH p AS (SELECT row_number() OVER () AS r, page_id, url, coalesce(html, '') AS html FROM pages),
k AS (SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS place,
  first_value(page_id) OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS top FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN strlen(html) >= 1000 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(html) >= 1000 AND place > 1 THEN top END AS refers_to
FROM k
"""
