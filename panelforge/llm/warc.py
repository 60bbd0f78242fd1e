"""WARC archives: writing captures, reading records back, and assembling transactions.

Writing. Every page becomes three records: the request, the response, and a metadata record that carries the page id.
Request and metadata name the response in WARC-Concurrent-To. Of pages with equal payloads the one with the smallest
page_id is the response; the others become revisit records that name it in WARC-Refers-To and hold the HTTP header only.
Records are plain strings; Spark's text writer puts the two line breaks after each and compresses the files, so archives
land in any store Spark can write to. Files are kept near `file_bytes` before compression.

Reading. Each archive is decompressed member by member and cut by Content-Length in one task; payload digests are computed again and must
match the header.

Assembly. Records meet on the identifier of the response (their own, or the one they are concurrent to), and each capture
is one nested row. A group holds the records of one capture, so no key is hot; revisits find the page they refer to by a
join on the record id, whose right side has one row per response.

Defined cases: NULL html is an empty payload; a NULL url gives no WARC-Target-URI and reads back as NULL; line breaks in
a url are percent-encoded; a NULL page_id sorts after every other and reads back as NULL; repeated rows are captures of
their own with equal identifiers, and those with the smallest page_id are all responses; an empty table gives an empty
result. Other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.core.scale import shared_folder, written

FILE_BYTES = 8 << 20
CRLF = "\r\n"
BREAK = CRLF + CRLF
_HEX_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD_SCHEMA = (
    "type string, record_id string, concurrent_to string, refers_to string, uri string, digest string, "
    "payload_bytes long, fields map<string,string>, payload string"
)


def base32_sha1(binary: Column) -> Column:
    """SHA-1 in bare upper-case base 32: 5 hexadecimal digits are 4 digits of base 32."""
    digest = F.sha1(binary)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), _HEX_DIGITS, _BASE32_DIGITS)


def _urn(kind: str, *of: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(c.cast("string"), F.lit("~")) for c in of]))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _record(headers: dict[str, Column | str], block: Column) -> Column:
    """Header lines (a NULL value leaves its line out), an empty line, the block."""
    lines = [F.lit("WARC/1.1")]
    for name, value in headers.items():
        lines.append(F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value))
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(BREAK), block)


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages with their payload digest and, for copies, the response they revisit."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.col(url_col), "\r", "%0D"), "\n", "%0A").alias("url"),
        html.alias("html"),
        F.sha2(html, 256).alias("key"),
    )
    smallest = F.struct(F.coalesce(F.col("page_id"), F.lit((1 << 63) - 1)).alias("order"), "page_id", "url")
    groups = rows.groupBy("key").agg(F.min(smallest).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    rows = rows.join(groups, "key", "left")
    copy = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return rows.select(
        "page_id",
        "url",
        "html",
        copy.alias("copy"),
        base32_sha1(F.col("html").cast("binary")).alias("digest"),
        _urn("response", F.col("page_id"), F.col("url"), F.col("key")).alias("capture"),
        F.when(copy, _urn("response", F.col("first.page_id"), F.col("first.url"), F.col("key"))).alias("refers_to"),
    )


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    date: str = "2024-01-01T00:00:00Z",
    file_bytes: int = FILE_BYTES,
) -> None:
    """Writes the archives of the pages to a folder."""
    size = pages.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(html_col)).alias("b")).first()
    a = captures(pages, id_col, url_col, html_col)
    http = F.concat(
        F.lit(CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=UTF-8", "Content-Length: "])),
        F.octet_length("html").cast("string"),
        F.lit(BREAK),
    )
    common = {"WARC-Date": date, "WARC-Target-URI": F.col("url")}
    joined = common | {"WARC-Concurrent-To": F.col("capture")}
    ask = F.concat(F.lit("GET "), F.coalesce(F.col("url"), F.lit("/")), F.lit(" HTTP/1.1" + BREAK))
    request = _record(
        {"WARC-Type": "request", "WARC-Record-ID": _urn("request", F.col("capture")), "Content-Type": "application/http; msgtype=request"} | joined, ask
    )
    answer = _record(
        {
            "WARC-Type": F.when(F.col("copy"), "revisit").otherwise("response"),
            "WARC-Record-ID": F.col("capture"),
            "WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("digest")),
            "WARC-Refers-To": F.col("refers_to"),
            "WARC-Profile": F.when(F.col("copy"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            "Content-Type": "application/http; msgtype=response",
        }
        | common,
        F.when(F.col("copy"), http).otherwise(F.concat(http, F.col("html"))),
    )
    about = F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    metadata = _record(
        {"WARC-Type": "metadata", "WARC-Record-ID": _urn("metadata", F.col("capture")), "Content-Type": "application/warc-fields"} | joined, about
    )
    per_page = (size.b or 0) / max(1, size.n) + 1500
    a.select(F.explode(F.array(request, answer, metadata)).alias("value")).write.option("lineSep", BREAK).option(
        "compression", "gzip"
    ).option("maxRecordsPerFile", max(3, math.ceil(3 * file_bytes / per_page))).text(path)


def _headers(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of one uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split(CRLF)
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = _headers(lines)
        start = end + 4
        block = data[start : start + int(head["content-length"])]
        at = start + len(block) + 4
        yield {"head": head, "block": block}


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, one after the other: ordinary archives have one for each record, Spark's text writer makes
    one of the whole file."""
    while data:
        inflate = zlib.decompressobj(31)
        yield inflate.decompress(data)
        if not inflate.eof:
            raise ValueError("an archive ends inside a gzip member")
        data = inflate.unused_data.lstrip(b"\0")  # files may be padded


def _row(record: dict, with_payload: bool) -> dict:
    head, block = record["head"], record["block"]
    kind = head["warc-type"]
    row = {
        "type": kind,
        "record_id": head["warc-record-id"],
        "concurrent_to": head.get("warc-concurrent-to"),
        "refers_to": head.get("warc-refers-to"),
        "uri": head.get("warc-target-uri"),
        "digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "payload_bytes": None,
        "fields": None,
        "payload": None,
    }
    if kind in ("response", "revisit"):
        lines, _, payload = block.partition(b"\r\n\r\n")
        row["payload_bytes"] = int(_headers(lines.decode().split(CRLF)[1:])["content-length"])
        if kind == "response":
            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if found != row["digest"] or len(payload) != row["payload_bytes"]:
                raise ValueError(f"payload of {row['record_id']} does not match its digest")
            if with_payload:
                row["payload"] = payload.decode("utf-8", "replace")
    elif kind == "metadata":
        row["fields"] = list(_headers(block.decode().split(CRLF)).items())
    return row


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of all archives in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
    kinds = [pa.string()] * 6 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.string()]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[dict] = []
                size = 0
                for record in (r for part in members(content.as_py()) for r in parse_records(part)):
                    rows.append(_row(record, with_payload))
                    size += len(record["block"])
                    if size > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)
                        rows, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)

    return files.mapInArrow(parse, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: request, response (or revisit) and metadata that are concurrent to each other."""
    capture = F.coalesce("concurrent_to", "record_id")
    main = F.col("type").isin("response", "revisit")
    answer = F.struct("type", "record_id", "refers_to", "uri", "digest", "payload_bytes", "payload")
    rows = records.groupBy(capture.alias("capture")).agg(
        F.first(F.when(F.col("type") == "request", F.struct("record_id", "uri")), ignorenulls=True).alias("request"),
        F.first(F.when(main, answer), ignorenulls=True).alias("response"),
        F.first(F.when(F.col("type") == "metadata", F.struct("record_id", "fields")), ignorenulls=True).alias("metadata"),
        F.sum(main.cast("int")).alias("times"),
    )
    # equal rows were written under equal identifiers
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "copy")


def roundtrip(pages: DataFrame) -> DataFrame:
    """Writes the pages to archives in the shared folder, reads them back and reports every capture."""
    spark = pages.sparkSession
    path = shared_folder(spark, "warc")
    write_archives(pages, path)
    rows = assemble(read_archives(spark, path, with_payload=False)).select(
        F.nullif(F.col("metadata.fields")["pageid"], F.lit("")).cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("response.record_id").alias("record_id"),
        F.col("response.refers_to").alias("refers_id"),
    )
    rows = written(rows, "captures")
    first = rows.filter("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to")).distinct()
    # responses refer to nothing and stay out of the join
    found = rows.filter("record_type <> 'response'").join(first, "refers_id", "left")
    whole = found.unionByName(rows.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")))
    return whole.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
