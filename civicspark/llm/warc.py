"""WARC archives with revisit resolution.

Only headers (payload digest, size and id) are shuffled to find pages of equal
payload; the one with the largest id stays a response, the others become revisit
records that name it.  Archives are gzip text parts of bounded size, written by
the tasks of Spark's own writer and read back whole files at a time.
"""

from __future__ import annotations

import gzip
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.llm.common import bounded, keep, scratch_dir, with_schema

#: Records of one archive, at most.
FILE_RECORDS = 2_000
#: Payloads below this size are always written in full.
LEAST_BYTES = 1_000
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SCHEMA = pa.schema([
    ("record_type", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()),
    ("refers_to", pa.string()), ("refers_to_page", pa.int64()), ("payload", pa.binary()),
])
_COLUMNS = "record_type string, record_id string, page_id long, url string, digest string, refers_to string, refers_to_page long, payload binary"


def _record_id(page_id: Column, digest: Column) -> Column:
    """A stable urn:uuid from a page's id and digest."""
    h = F.md5(F.concat_ws("|", page_id.cast("string"), digest))
    groups = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *groups), F.lit(">"))


def payload_headers(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Each page's id, url and payload with the payload's SHA-1 digest and size; a null payload is empty."""
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    return pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.regexp_replace(F.col(url).cast("string"), r"[\r\n]+", " ").alias("url"),
        body.alias("html"), F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).cast("long").alias("size"),
    )


def revisit_targets(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``digest`` and ``target``, the largest page id, of payloads that several rows share.

    Counts and maxima are taken before the shuffle, so a payload that a third of
    all pages share costs one row a task.
    """
    return (
        headers.where(F.col("size") >= least_bytes).groupBy("digest")
        .agg(F.count("*").alias("rows"), F.max("page_id").alias("target")).where("rows > 1 and target is not null").select("digest", "target")
    )


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise("")


def write_warc(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, **columns) -> None:
    """Write a record for each row of ``pages`` to archives under ``path``.

    Rows of equal payloads of at least ``least_bytes`` revisit the row with the
    largest id; of repeated rows of that id each is a response.  A null id never
    is a target.  A null url is left out of the record's header.
    """
    headers = payload_headers(pages, **columns)
    targets = bounded(keep(revisit_targets(headers, least_bytes), "targets"))
    rows = headers.join(targets, "digest", "left")
    revisit = F.col("target").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("target"))
    payload = F.when(revisit, "").otherwise(F.col("html"))
    kind = F.when(revisit, "revisit").otherwise("response")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", kind), _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        _line("WARC-Date", F.lit(DATE)), _line("WARC-Target-URI", F.col("url")), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _line("WARC-Page-ID", F.col("page_id")), _line("WARC-Profile", F.when(revisit, _PROFILE)),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("target"), F.col("digest")))), _line("WARC-Refers-To-Page-ID", F.when(revisit, F.col("target"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), _line("Content-Length", F.octet_length(http) + F.octet_length(payload)), F.lit("\r\n"),
    )
    # the writer's line separator is the two line ends that close a WARC record
    record = F.concat(head, http, payload).alias("value")
    rows.select(record).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse_warc(data: bytes):
    """Records of an archive as dicts; plain, gzip, or a gzip member for each record.

    Lengths come from ``Content-Length``, so payloads may hold any bytes.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {}
        for line in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = data[stop + 4 : stop + 4 + size]
        if len(block) < size:
            raise ValueError("a record is cut short")
        at = stop + 4 + size
        payload = block
        if fields.get("content-type", "").startswith("application/http"):
            payload = block.partition(b"\r\n\r\n")[2]
        number = lambda name: int(fields[name]) if re.fullmatch(r"-?\d+", fields.get(name, "")) else None
        yield {
            "record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "page_id": number("warc-page-id"),
            "url": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest", "").rpartition(":")[2] or None,
            "refers_to": fields.get("warc-refers-to"), "refers_to_page": number("warc-refers-to-page-id"), "payload": payload,
        }


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives under ``path``; a file is read whole, as one task's row."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                held, size = [], 0
                for record in parse_warc(data):
                    held.append(record)
                    size += len(record["payload"])
                    if size > 4_000_000:
                        yield {f.name: [r[f.name] for r in held] for f in _SCHEMA}
                        held, size = [], 0
                if held:
                    yield {f.name: [r[f.name] for r in held] for f in _SCHEMA}

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(with_schema(run, _SCHEMA), _COLUMNS)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` without payloads but with the size and the digest of the full one, also for revisits.

    Revisit headers are joined to the headers of the responses they name; a
    revisit whose response is not there has null size.
    """
    heads = records.select(
        "record_type", "record_id", "page_id", "url", "digest", "refers_to", "refers_to_page",
        F.sha1("payload").alias("own_digest"), F.octet_length("payload").cast("long").alias("own_size"),
    )
    heads = keep(heads, "headers")
    responses = heads.where("record_type = 'response'")
    named = heads.where("record_type = 'revisit'").select(F.col("refers_to").alias("record_id")).distinct()
    originals = responses.join(named, "record_id", "left_semi").groupBy("record_id").agg(F.min("own_digest").alias("full_digest"), F.min("own_size").alias("full_size"))
    revisits = heads.where("record_type = 'revisit'").join(
        bounded(originals.withColumnRenamed("record_id", "original")), F.col("refers_to") == F.col("original"), "left"
    )
    columns = ["record_type", "record_id", "page_id", "url", "refers_to", "refers_to_page"]
    return responses.select(*columns, F.col("own_digest").alias("payload_digest"), F.col("own_size").alias("payload_bytes")).union(
        revisits.select(*columns, F.col("full_digest").alias("payload_digest"), F.col("full_size").alias("payload_bytes"))
    )


def archive_round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write ``pages`` to deduplicated archives in the shared folder and return their resolved headers."""
    path = f"{scratch_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, least_bytes)
    return resolve_revisits(read_warc(pages.sparkSession, path))
