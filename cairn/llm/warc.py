"""WARC archives with revisit records.

Headers (page_id and digest) are shuffled by payload digest: the smallest page of each digest is the response, the others become
revisit records that refer to it and carry no payload. What was found joins the pages again by page_id and digest, so a popular
payload never gathers its copies in one task; where it is few rows it is broadcast instead. Records have fresh headers. Each is a
gzip member of its own, in files of bounded bytes that a task writes under another name and moves into place, so a lost executor
leaves no half archive. Reading follows each record's Content-Length, whatever the payload holds, and checks its digest.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import discard, in_order, put, scratch, small, stored

LEAST_BYTES, FILE_BYTES, SALTS, FEW = 100, 32 << 20, 8, 200_000
_END = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def headers(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null: empty), its digest and bytes n."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.withColumns({"digest": F.sha2(F.col("html").cast("binary"), 256), "n": F.octet_length("html").cast("long")})


def revisits(rows: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(page_id, digest, first) of the pages that revisit the page `first`; digests of many pages are spread by salts."""
    short = rows.filter(F.col("n") >= least).select("page_id", "digest")
    many = short.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1 and first is not null")
    salted = many.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = short.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"])
    return met.filter(~F.col("first").eqNullSafe(F.col("page_id"))).select("page_id", "digest", "first").distinct()


def resolved(pages: DataFrame, least: int = LEAST_BYTES, few: int = FEW) -> tuple[DataFrame, list[str]]:
    """page_id, url, html, digest, n, first: the page that this one revisits, or null; and the paths of stored tables behind it."""
    rows = headers(pages)
    again, path = stored(revisits(rows, least).withColumnsRenamed({"page_id": "_page", "digest": "_digest"}), "revisits")
    again = small(again, few)  # two numbers and a digest a row
    return rows.join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").drop("_page", "_digest"), [path]


def urn(page_id: int | None, digest: str) -> str:
    """A record's id; rows that repeat a page_id with another payload have another."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest[:32]}>"


def record(page_id: int | None, url: str | None, html: bytes, digest: str, n: int, first: int | None, date: str) -> bytes:
    """One WARC record with the two line breaks that end it."""
    again = first is not None
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: {urn(page_id, digest)}", f"WARC-Date: {date}",
        *([] if url is None else ["WARC-Target-URI: " + url.replace("\r", " ").replace("\n", " ")]), f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {n}",
        *([f"WARC-Refers-To: {urn(first, digest)}", f"WARC-Profile: {_PROFILE}"] if again else []), "Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if again else n}",
    ]
    return (_END.join(lines) + _END * 2).encode() + (b"" if again else html) + (_END * 2).encode()


def write_archives(pages: DataFrame, uri: str, least: int = LEAST_BYTES, file_bytes: int = FILE_BYTES, few: int = FEW) -> DataFrame:
    """Writes the archives under uri and returns (name, records, bytes), a row for each file. A file ends with the record that
    takes it past `file_bytes` compressed bytes."""

    def run(batches):
        task = TaskContext.get()
        part, attempt, made, members, size = task.partitionId(), str(task.taskAttemptId()), [], [], 0

        def flush():
            nonlocal members, size
            name = f"part-{part:07d}-{len(made):05d}.warc.gz"
            put(uri, name, b"".join(members), attempt)
            made.append((name, len(members), size))
            members, size = [], 0

        for batch in in_order(batches):
            for page_id, url, html, digest, n, first, date in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                members.append(gzip.compress(record(page_id, url, html, digest, n, first, date), 6, mtime=0))
                size += len(members[-1])
                if size >= file_bytes:
                    flush()
        if members:
            flush()
        columns = list(zip(*made, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["name", "records", "bytes"])

    rows, paths = resolved(pages, least, few)
    html = F.when(F.col("first").isNull(), F.col("html").cast("binary")).otherwise(F.lit(b""))
    date = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    files, path = stored(rows.select("page_id", "url", html.alias("html"), "digest", "n", "first", date.alias("date")).mapInArrow(run, "name string, records long, bytes long"), "archives")
    discard(pages.sparkSession, *paths)
    return files


def members(data: bytes):
    """The gzip members of a file, one decompressed at a time."""
    while data:
        one = zlib.decompressobj(31)
        yield one.decompress(data) + one.flush()
        if not one.eof:
            raise ValueError("the archive ends inside a record")
        data = one.unused_data


def parsed(data: bytes):
    """(headers, payload) of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split(_END)
        if version != "WARC/1.1":
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines)
        n = int(head["Content-Length"])
        yield head, data[end + 4 : end + 4 + n]
        if data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end")
        at = end + 8 + n


def checked(head: dict[str, str], payload: bytes) -> bytes:
    """The payload of a response, whose digest must be the header's."""
    if f"sha256:{hashlib.sha256(payload).hexdigest()}" != head["WARC-Payload-Digest"]:
        raise ValueError(f"the payload of {head['WARC-Record-ID']} doesn't have its digest")
    return payload


def read_archives(spark: SparkSession, uri: str, payloads: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, html of all records; html is null for revisits, and for
    all without `payloads`. The digest of every response is checked against its bytes; another payload raises an error."""

    def page(x: str | None) -> int | None:
        found = x.split(":")[2] if x else ""
        return int(found) if found else None

    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                out, size = [], 0
                for one in members(data.as_py()):
                    for head, payload in parsed(one):
                        revisit = head["WARC-Type"] == "revisit"
                        html = None if revisit else checked(head, payload)
                        size += len(payload) if payloads else 300
                        out.append((page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"], page(head.get("WARC-Refers-To")), html if payloads else None))
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(uri).select("content")
    return files.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html binary")


def archived(pages: DataFrame, least: int = LEAST_BYTES, **how) -> DataFrame:
    """Writes pages (page_id, url, html, ...) as archives in the shared folder and reads their records back.

    A null html is an empty payload; very long ones are written whole. Of equal pages with one page_id each is a response if it is
    the smallest; a null page_id is never the smallest. Line breaks in a url become spaces. An empty table gives no records. Other
    columns are ignored.
    """
    uri = scratch(pages.sparkSession, "warc")
    if not write_archives(pages, uri, least, **how).limit(1).count():
        return pages.sparkSession.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_archives(pages.sparkSession, uri, payloads=False).drop("html", "url")
