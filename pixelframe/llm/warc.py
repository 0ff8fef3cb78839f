"""Legacy ARC archives and their conversion to WARC.

Pages are written as ARC files (one version for each file, URL-record version 1 or 2),
a converter parses the version-specific header lines and declared lengths and writes
WARC records with identifiers, timestamps, types and digests made from them, and a
reader parses the WARC files again.  Archives are gzipped text files that Spark writes
into the shared folder.  Pages are written by classes of their size, each with a number of records for a file, so that a
file holds about 128 MB at most (or eight of the largest pages).  Readers inflate a file bit by bit, members one
after another, and hand rows on every ``BATCH_BYTES``, so a task never holds an inflated file.

Defined results: a null html is an empty payload, a null url becomes ``urn:unknown``; a
null page id stays null, is always a response and never referred to; rows with the same
page id as the first record of their payload are responses like it; an empty table gives
empty archives.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.llm import scratch

#: Payloads of fewer bytes are never revisits.
MIN_REVISIT = 100
#: (payload bytes below which a class lies, records in a file of it).
SIZES = ((1 << 16, 2000), (1 << 20, 128), (1 << 62, 8))
#: Bytes of payloads that are handed on at once.
BATCH_BYTES = 8_000_000
#: Capture time and address that pages without any get.
CAPTURED, ADDRESS = "20240101000000", "0.0.0.0"
#: Fixed values of the formats.
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _bytes(c: Column) -> Column:
    return F.octet_length(c).cast("string")


def _classes(rows: DataFrame, size: Column) -> Iterator[tuple[str, Column, int]]:
    """(name, condition, records in a file) of each class of sizes that occurs in ``rows``; ``c0`` always."""
    least = [0, *[s for s, _ in SIZES[:-1]]]
    (seen,) = rows.agg(F.array(*[F.count(F.when((size >= a) & (size < b), 1)) for a, (b, _) in zip(least, SIZES, strict=True)])).first()
    for k, (a, (b, per_file)) in enumerate(zip(least, SIZES, strict=True)):
        if seen[k] or not k:
            yield f"c{k}", (size >= a) & (size < b), per_file


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write ARC files: a version block, then records ``header line, network document``; versions alternate by task."""
    for name, some, per_file in _classes(pages, F.coalesce(F.octet_length(F.col(html_col).cast("string")), F.lit(0))):
        _write_arc(pages.where(some), f"{path}/{name}", per_file, id_col, url_col, html_col)


def _write_arc(pages: DataFrame, path: str, per_file: int, id_col: str, url_col: str, html_col: str) -> None:
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    url = F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("urn:unknown")), r"\s", "%20")
    url = F.when(url == "", "urn:unknown").otherwise(url)
    page = F.coalesce(F.concat(F.lit("X-Page-Id: "), F.col(id_col).cast("string"), F.lit("\r\n")), F.lit(""))
    document = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"), page, F.lit("Content-Length: "), _bytes(html), F.lit("\r\n\r\n"), html)
    version = (F.spark_partition_id() % 2 + 1).cast("string")
    middle = F.when(version == "2", F.lit(f" {ADDRESS} {CAPTURED} text/html 200 - - 0 pages.arc ")).otherwise(F.lit(f" {ADDRESS} {CAPTURED} text/html "))
    rows = pages.select(url.alias("url"), document.alias("doc"), F.monotonically_increasing_id().alias("n"), version.alias("version"), middle.alias("middle"))
    record = F.concat("url", "middle", _bytes(F.col("doc")), F.lit("\n"), "doc")
    block = F.when(F.col("version") == "2", F.lit(f"2 0 pages\n{ARC_FIELDS['2']}\n")).otherwise(F.lit(f"1 0 pages\n{ARC_FIELDS['1']}\n"))
    top = F.concat(F.lit("filedesc://pages.arc"), F.regexp_replace("middle", "text/html", "text/plain"), _bytes(block), F.lit("\n"), block, F.lit("\n"))
    # Row numbers within a task start at zero, as its files do.
    first = F.col("n").bitwiseAND(F.lit((1 << 33) - 1)) % per_file == 0
    lines = rows.select(F.when(first, F.concat(top, record)).otherwise(record).alias("value"))
    lines.write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse_arc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by name, network document) of each record; the version block says which fields a line has."""
    fields = ARC_FIELDS["1"].split()
    while line := stream.readline():
        if not line.strip():
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        length = int(parts[-1])
        body = stream.read(length)
        if len(body) < length:
            raise ValueError(f"an ARC record declares {length} bytes, {len(body)} are left")
        if parts[0].startswith("filedesc:"):
            fields = ARC_FIELDS[body[:1].decode()].split()
        elif len(parts) == len(fields):
            yield dict(zip(fields, parts, strict=True)), body
        else:
            raise ValueError(f"an ARC header line has {len(parts)} fields, not {len(fields)}")


def _http(body: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    head, gap, payload = body.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    return head + gap, payload, {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content", F.substring_index("path", "/", -1).alias("file"))


def _inflated(content: pa.Scalar) -> BinaryIO:
    """A gzip file of any number of members as a stream."""
    return io.BufferedReader(gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer())), 1 << 20)


def _batches(rows: Iterator[tuple[int, tuple]], kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Record batches of (bytes, row) of about ``BATCH_BYTES``."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        # Payloads are bytes; they become strings without a copy.
        columns = [pa.array(c, pa.binary()).view(t) if any(isinstance(x, bytes) for x in c) else pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    for n, row in rows:
        held.append(row)
        size += n + 200
        if size > BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def read_arc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of ARC files: page_id, url, ip, captured, digest, payload_bytes, at (file and number) and with ``with_payload`` head and payload."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        for batch in batches:
            for content, file in zip(*batch.columns, strict=True):
                for k, (fields, body) in enumerate(parse_arc(_inflated(content))):
                    head, payload, http = _http(body)
                    page = int(http["x-page-id"]) if "x-page-id" in http else None
                    row = (page, fields["URL"], fields["IP-address"], fields["Archive-date"], hashlib.sha256(payload).hexdigest(), len(payload), f"{file} {k}")
                    yield (len(body), (*row, head, payload)) if with_payload else (0, row)

    schema = "page_id long, url string, ip string, captured string, digest string, payload_bytes long, at string" + ", head string, payload string" * with_payload
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64() if x.endswith("long") else pa.string() for x in schema.split(", ")]
    return _files(spark, path).mapInArrow(lambda batches: _batches(records(batches), kinds, names), schema)


def _record_id(page: Column, salt: Column) -> Column:
    """A version 8 UUID that carries the 64 bits of the page id and a hash."""
    h, s = F.lower(F.lpad(F.hex(page), 16, "0")), F.substring(F.sha2(salt, 256), 1, 14)
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-8"), F.substring(h, 13, 3), F.lit("-8"), F.substring(h, 16, 1), F.substring(s, 1, 2), F.lit("-"), F.substring(s, 3, 12), F.lit(">"))


def _identifier(c: Callable[[str], Column]) -> Column:
    """The identifier of the ARC record whose columns ``c`` gives; no two records of an archive share one."""
    return _record_id(F.coalesce(c("page_id"), F.lit(-1)), F.concat_ws(" ", c("url"), c("captured"), c("at")))


def _page_of(record_id: str) -> int:
    h = re.search(r"urn:uuid:([0-9a-f-]{36})", record_id)[1].replace("-", "")
    value = int(h[:12] + h[13:16] + h[17], 16)
    return value - (1 << 64) if value >> 63 else value


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Write a WARC record for each ARC record.

    The first record (smallest page id) of a payload is a response and later ones revisit
    it.  Only payloads that occur more than once are joined back, by digest.
    """
    short = scratch.table(read_arc(spark, arc_path, with_payload=False), "records")
    known = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "captured", "at"))
    firsts = short.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("digest").agg(F.min(known).alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    firsts = scratch.table(firsts, "payloads")
    n = firsts.count()
    for name, some, per_file in _classes(short, F.col("payload_bytes")):
        _write_warc(scratch.join_counted(read_arc(spark, arc_path).where(some), firsts, ["digest"], "left", n), f"{warc_path}/{name}", per_file)


def _write_warc(rows: DataFrame, path: str, per_file: int) -> None:
    again = F.coalesce(F.col("page_id") > F.col("first.page_id"), F.lit(False))
    iso = F.regexp_replace("captured", r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6Z")
    body = F.when(again, F.col("head")).otherwise(F.concat("head", "payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", _identifier(F.col)),
        line("WARC-Date", iso),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(again, F.concat(line("WARC-Refers-To", _identifier(lambda name: F.col("first")[name])), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", _bytes(body)),
        F.lit("\r\n"),
        body,
    )
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record by its declared length."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(": ")
            headers[name.lower()] = value
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"a WARC record declares {size} bytes, {len(block)} are left")
        yield headers, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, uri, warc_date of WARC files.

    A response's digest and length are computed from its payload; a revisit states its own.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        for batch in batches:
            for content in batch.column(0):
                for headers, block in parse_warc(_inflated(content)):
                    _, payload, http = _http(block)
                    stated = headers["warc-payload-digest"].removeprefix("sha256:")
                    revisit = headers["warc-type"] == "revisit"
                    digest = stated if revisit else hashlib.sha256(payload).hexdigest()
                    if digest != stated:
                        raise ValueError(f"digest of {headers['warc-record-id']} differs")
                    size = int(http["content-length"]) if revisit else len(payload)
                    page = int(http["x-page-id"]) if "x-page-id" in http else None
                    refers = _page_of(headers["warc-refers-to"]) if revisit else None
                    yield 0, (page, size, digest, headers["warc-type"], refers, headers["warc-target-uri"], headers["warc-date"])

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, warc_date string"
    names = [x.split()[0] for x in schema.split(", ")]
    return _files(spark, path).mapInArrow(lambda batches: _batches(records(batches), kinds, names), schema)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC records read back."""
    spark = pages.sparkSession
    arc, warc = scratch.new_path(spark, "arc"), scratch.new_path(spark, "warc")
    write_arc(pages, arc, id_col, url_col, html_col)
    convert(spark, arc, warc)
    return read_warc(spark, warc)
