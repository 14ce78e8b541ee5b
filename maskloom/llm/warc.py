"""WARC archives: writing captures and assembling their transactions again.

A page is captured as three records: request, response (or revisit, where an earlier page had the same payload) and
metadata. The request and the metadata name the response in WARC-Concurrent-To. Reading joins the three through that
identifier and emits one nested row per capture.

Archives are written by Spark's text writer, a record a row and two line ends after each, gzipped by file: any Hadoop file
system holds them, and failed tasks leave nothing behind. They are read as binary files; a record's end is found by its
Content-Length, so payloads may contain anything, line ends and record headers included.

Defined results: a null payload is empty; payloads shorter than `least` bytes are always written in full; of pages with equal
payloads the smallest page_id is the response (each of its rows, if repeated; all have identifiers of their own) and the
others refer to it; a null page_id
never leads a group that has another; a null url is the empty target; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

CRLF = "\r\n"
#: Digits of base 32 as numbers and as RFC 4648 has them.
_DIGITS = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: its 160 bits are four times 40, eight digits each."""
    h = F.sha1(payload)
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]), *_DIGITS)


def _record(kind: Column, fields: list[tuple[str, Column]], body: Column) -> Column:
    """The record's text; a field that is null is left out."""
    head = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind)]
    head += [F.concat(F.lit(f"{k}: "), v) for k, v in fields]
    head += [F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *head), F.lit(CRLF * 2), body)


def _id(what: str, page: Column) -> Column:
    """A record's identifier: a UUID from a hash of what it is of."""
    h = F.md5(F.concat(F.lit(what + ":"), page))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def capture_plan(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, digest, and refers_to: the page that holds the payload, null for responses."""
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", sha1_base32(F.col("html").cast("binary")))
    # groups of equal payloads meet as one row each; only those with more than one page come back
    groups = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("lead"), F.count("*").alias("n")).where("n > 1").select("digest", "lead")
    joined = rows.join(groups, "digest", "left")
    return joined.select("page_id", "url", "html", "digest", F.when((F.octet_length("html") >= least) & ~F.col("page_id").eqNullSafe(F.col("lead")), F.col("lead")).alias("refers_to"))


def _numbered(pages: DataFrame, plan: DataFrame) -> DataFrame:
    """plan and `turn`: 1, 2, ... for rows of one page and payload. Only rows of repeated page_ids are dealt around."""
    again = pages.groupBy(F.col("page_id").cast("long").alias("_again")).count().where("count > 1").select("_again")
    if again.isEmpty():
        return plan.withColumn("turn", F.lit(1))
    same = F.col("page_id").eqNullSafe(F.col("_again"))
    w = Window.partitionBy("page_id", "digest").orderBy("url")
    return plan.join(again, same, "left_anti").withColumn("turn", F.lit(1)).union(plan.join(again, same, "left_semi").withColumn("turn", F.row_number().over(w)))


def write_warc(pages: DataFrame, path: str, least: int = 0, per_file: int = 2000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Archives of at most `per_file` records each under `path`."""
    plan = _numbered(pages, capture_plan(pages, least))
    page, url, html = F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.col("url"), F.col("html")
    uri = F.regexp_replace(url, r"[\r\n]", "")
    when = ("WARC-Date", F.lit(date))
    own = F.concat(page, F.lit(":"), F.col("digest"), F.when(F.col("turn") > 1, F.concat(F.lit(":"), F.col("turn").cast("string"))).otherwise(F.lit("")))
    response = _id("response", own)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF * 2))
    is_revisit = F.col("refers_to").isNotNull()
    common = [when, ("WARC-Target-URI", uri)]
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    main = _record(
        F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response")),
        [("WARC-Record-ID", response), *common, ("WARC-Payload-Digest", digest), ("WARC-Profile", F.when(is_revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))), ("WARC-Refers-To", F.when(is_revisit, _id("response", F.concat(F.col("refers_to").cast("string"), F.lit(":"), F.col("digest"))))), ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.when(is_revisit, http).otherwise(F.concat(http, html)),
    )
    request = _record(F.lit("request"), [("WARC-Record-ID", _id("request", own)), *common, ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1"), F.lit(CRLF * 2)))
    length = F.octet_length(html).cast("string")
    meta = F.concat(F.lit("pageId: "), page, F.lit("\r\npayloadLength: "), length, F.lit("\r\nrefersToPage: "), F.coalesce(F.col("refers_to").cast("string"), F.lit("")), F.lit(CRLF))
    metadata = _record(F.lit("metadata"), [("WARC-Record-ID", _id("metadata", own)), *common, ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/warc-fields"))], meta)
    plan.select(F.explode(F.array(request, main, metadata)).alias("value")).write.mode("overwrite").option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record."""
    at = 0
    while (at := raw.find(b"WARC/", at)) >= 0:
        end = raw.index(b"\r\n\r\n", at)
        fields = dict(line.split(": ", 1) for line in raw[at:end].decode("utf-8").split(CRLF)[1:] if ": " in line)
        fields = {k.lower(): v for k, v in fields.items()}
        start, size = end + 4, int(fields.get("content-length", "0"))
        yield fields, raw[start : start + size]
        at = start + size


_RECORDS = pa.schema([("type", pa.string()), ("id", pa.string()), ("concurrent_to", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("block_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("http", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
_RECORDS_DDL = "type string, id string, concurrent_to string, uri string, date string, digest string, refers_to string, block_bytes long, payload_bytes long, payload_digest string, http string, fields map<string,string>, payload binary"


def _parse(keep_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                raw = content.as_py()
                raw = zlib.decompress(raw, 47) if raw[:2] == b"\x1f\x8b" else raw
                rows: dict[str, list] = {k: [] for k in _RECORDS.names}
                held = 0
                for f, block in parse_records(raw):
                    http, _, payload = block.partition(b"\r\n\r\n") if f.get("content-type", "").startswith("application/http") else (b"", b"", block)
                    meta = dict(x.split(": ", 1) for x in block.decode().split(CRLF) if ": " in x) if f["warc-type"] == "metadata" else {}
                    row = (f["warc-type"], f.get("warc-record-id"), f.get("warc-concurrent-to"), f.get("warc-target-uri"), f.get("warc-date"), (f.get("warc-payload-digest") or "").removeprefix("sha1:") or None, f.get("warc-refers-to"), len(block), len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), http.decode("utf-8", "replace"), list(meta.items()), payload if keep_payload else None)
                    for k, x in zip(rows, row):
                        rows[k].append(x)
                    held += len(block)
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_pydict(rows, schema=_RECORDS)
                        rows, held = {k: [] for k in _RECORDS.names}, 0
                if rows["type"]:
                    yield pa.RecordBatch.from_pydict(rows, schema=_RECORDS)

    return run


def read_records(spark, path: str, keep_payload: bool = True) -> DataFrame:
    """One row per record of the archives under `path`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content")
    return files.mapInArrow(_parse(keep_payload), _RECORDS_DDL)


def read_captures(spark, path: str, keep_payload: bool = True) -> DataFrame:
    """One nested row per capture: capture (the response's or revisit's id), and structs response, request, metadata.

    The three kinds meet in one aggregation by the response's identifier: each capture has three rows, so no key is hot.
    """
    records = read_records(spark, path, keep_payload)
    capture = F.coalesce("concurrent_to", "id")
    whole = F.struct(*[F.col(c) for c in _RECORDS.names])
    is_main = F.col("type").isin("response", "revisit")
    return records.select(capture.alias("capture"), F.col("type"), whole.alias("r")).groupBy("capture").agg(
        *[F.any_value(F.when(test, F.col("r")), ignoreNulls=F.lit(True)).alias(name) for name, test in (("response", is_main), ("request", F.col("type") == "request"), ("metadata", F.col("type") == "metadata"))]
    )


def archive_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the archives to the shared folder, reads them back: page_id, payload_bytes, payload_digest, record_type,
    refers_to, url, request_line, intact (the payload that was read has the digest that was written)."""
    spark = pages.sparkSession
    ws = Workspace(spark, "warc")
    path = ws.path("archives")
    write_warc(pages, path, least)
    r, fields = F.col("response"), F.col("metadata.fields")
    full = r["type"] == "response"  # of a revisit only the header knows the payload, which is not in its record
    return read_captures(spark, path, keep_payload=False).select(
        fields["pageId"].try_cast("long").alias("page_id"), F.when(full, r["payload_bytes"]).otherwise(fields["payloadLength"].cast("long")).alias("payload_bytes"), F.when(full, r["payload_digest"]).otherwise(r["digest"]).alias("payload_digest"), r["type"].alias("record_type"),
        fields["refersToPage"].try_cast("long").alias("refers_to"), r["uri"].alias("url"), F.col("request.http").alias("request_line"), F.when(full, r["payload_digest"] == r["digest"]).alias("intact"),
    )
