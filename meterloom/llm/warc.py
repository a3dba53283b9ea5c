"""Legacy ARC archives to WARC (operator 7).

An ARC record is one header line, whose fields depend on the archive's version, and as many payload bytes as it declares. The
converter parses these lines and synthesises the WARC record's identifier (from where the record comes from and the payload's digest,
so a second run agrees), timestamp, type and digests. What an archived server said keeps its HTTP head; a record without one gets the
head that its status, type and location fields tell of. ``arc_to_warc`` reads a folder of ARC files, ``convert`` takes pages by way of
ARC records of both versions. Of pages with equal payloads of at least ``LEAST_SHARED`` bytes all but the smallest page_id become
revisits of that one.

Archives are written by Spark's text writer with the record separator of WARC as line separator and one row a file, so each file is a
plain WARC file and a lost task's files are never seen. A file holds a warcinfo record and others of ``FILE_BYTES`` together, or one
that is larger. They are read back as bytes and parsed by declared lengths alone; a response's payload must be what its header
says, and a revisit must agree with the response that it refers to.

Defined results: null or empty html is an empty payload, always a response; a null url is written "-"; rows alike in id and payload
are responses alike; a very long page is a record, and a file, of its own; an empty table gives an empty archive; other columns are
neither read nor changed.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import datetime
from http import HTTPStatus
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from meterloom.session import cut, scratch_path

LEAST_SHARED = 100
FILE_BYTES = 1 << 25  # of records in a file
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs (RFC 4122)
VERSION = b"WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEAD = re.compile(rb"HTTP/[0-9.]+ ([0-9]{3})[^\n]*\n(?:[^\r\n][^\n]*\n)*\r?\n")

#: The fields of a record's header line in each version of the ARC format.
ARC_FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}

#: The same fields as the version block names them.
ARC_NAMES = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}


class ArcRecord(NamedTuple):
    version: int
    offset: int
    fields: dict[str, str]
    payload: bytes


def arc_url(url: str | None) -> str:
    """A URL as an ARC header line can hold it: without spaces, controls or line ends."""
    return quote(url or "-", safe="".join(map(chr, range(0x21, 0x7F))))


def write_arc(version: int, url: str, date: str, payload: bytes, filename: str = "pages.arc") -> bytes:
    """A one-record ARC archive of the version: its version block, then the record."""
    names = " ".join(ARC_NAMES[version])
    about = f"{version} 0 archive\n{names}\n".encode()
    fill = {"ip": "0.0.0.0", "date": date, "status": "200", "checksum": "-", "location": "-", "offset": "0", "filename": filename}

    def line(values: dict[str, str]) -> bytes:
        return " ".join(values[f] for f in ARC_FIELDS[version]).encode() + b"\n"

    head = line(fill | {"url": f"filedesc://{filename}", "mime": "text/plain", "length": str(len(about))})
    return head + about + b"\n" + line(fill | {"url": url, "mime": "text/html", "length": str(len(payload))}) + payload + b"\n"


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC archive, its version block aside. Only declared lengths say where a payload ends."""
    at, version = 0, None
    while at < len(data):
        stop = data.index(b"\n", at)
        line = data[at:stop].decode("utf-8", "replace").rstrip("\r")
        if version is None:  # the version block: its own line has the fields of its version
            values = line.split(" ")
            length = int(values[-1])
            version = int(data[stop + 1 : stop + 1 + length].split(b" ", 1)[0])
            if version not in ARC_FIELDS or not values[0].startswith("filedesc://"):
                raise ValueError("no version block of a known ARC version")
        else:
            values = line.rsplit(" ", len(ARC_FIELDS[version]) - 1)  # a url may hold spaces
            if len(values) != len(ARC_FIELDS[version]):
                raise ValueError(f"a header line of version {version} has {len(ARC_FIELDS[version])} fields, this one {len(values)}")
            fields = dict(zip(ARC_FIELDS[version], values, strict=True))
            length = int(fields["length"])
            payload = data[stop + 1 : stop + 1 + length]
            if len(payload) < length:
                raise ValueError("the archive ends before the declared length")
            yield ArcRecord(version, at, fields, payload)
        at = stop + 1 + length
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1


def record_id(source: str | int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{source}:{digest}')}>"


def timestamp(date: str) -> str:
    """The WARC date of an ARC date, whose time of day may be short."""
    return datetime.strptime(date[:14] + "00000101000000"[len(date[:14]) :], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def http_parts(arc: ArcRecord, bare: bool = False) -> tuple[bytes, bytes]:
    """The HTTP head and body of an archived answer; the head of one without, or that is known to be ``bare``, is made from its fields."""
    if not bare and (m := _HEAD.match(arc.payload)):
        return m[0], arc.payload[m.end() :]
    status = arc.fields.get("status", "200")
    status = status if re.fullmatch("[1-5][0-9]{2}", status) else "200"
    mime = arc.fields["mime"] if "/" in arc.fields["mime"] else "application/octet-stream"
    lines = [f"HTTP/1.1 {status} {HTTPStatus(int(status)).phrase if int(status) in list(HTTPStatus) else 'Archived'}", f"Content-Type: {mime}"]
    if arc.fields.get("location", "-") != "-":
        lines.append(f"Location: {arc.fields['location']}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), arc.payload


def to_warc(arc: ArcRecord, source: str | int | None, refers_to: int | None = None, bare: bool = False) -> bytes:
    """The WARC record of an ARC record, without the two line ends that close it. ``source`` is a page_id, or says where it was read."""
    answered = arc.fields["url"].split(":", 1)[0].lower() in ("http", "https") or bare
    head, body = http_parts(arc, bare) if answered else (b"", arc.payload)
    digest = hashlib.sha256(body).hexdigest()
    block = head if refers_to is not None else head + body
    lines = [
        ("WARC-Type", "revisit" if refers_to is not None else "response" if answered else "resource"),
        ("WARC-Record-ID", record_id(source, digest)),
        ("WARC-Date", timestamp(arc.fields["date"])),
        ("WARC-Target-URI", arc.fields["url"]),
        ("WARC-IP-Address", arc.fields["ip"]),
        ("Content-Type", "application/http; msgtype=response" if answered else arc.fields["mime"]),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("X-Head-Length", str(len(head))),
        ("X-Payload-Length", str(len(body))),
        ("X-ARC-Version", str(arc.version)),
    ]
    if isinstance(source, int):
        lines.append(("X-Page-Id", str(source)))
    if refers_to is not None:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to))]
    lines.append(("Content-Length", str(len(block))))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block


def information(first: bytes) -> bytes:
    """The warcinfo record of a file that begins with this record."""
    block = b"software: ARC to WARC conversion\r\nformat: WARC File Format 1.1\r\n"
    date = re.search(rb"WARC-Date: ([^\r]*)", first)[1].decode()
    lines = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("info", hashlib.sha256(first).hexdigest())), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The (header, block) pairs of a WARC file, by declared lengths."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        if not re.fullmatch(r"WARC/1\.[01]", lines[0]):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        start = stop + 4
        end = start + int(head["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield head, data[start:end]
        at = end + 4


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest, first: of rows whose payload another row with a smaller id holds too. Payloads themselves are not moved."""
    told = pages.where(F.octet_length("html") >= LEAST_SHARED).select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    first = told.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return told.join(first, "digest").where("page_id > first").distinct()


def convert(pages: DataFrame, date: str = "20240101000000") -> DataFrame:
    """One WARC record (column ``value``) per row of ``pages`` (page_id, url, html), by way of an ARC record; odd ids have version 2."""
    again = cut(revisits(pages).select(F.col("page_id").alias("of_page"), F.col("digest").alias("of_digest"), "first"), "revisits")
    own = F.when(F.octet_length("html") >= LEAST_SHARED, F.sha2(F.col("html").cast("binary"), 256))
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", own.alias("digest"))
    joined = rows.join(again, (F.col("page_id") == F.col("of_page")) & (F.col("digest") == F.col("of_digest")), "left").select("page_id", "url", "html", "first")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for page_id, url, html, first in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    arc = write_arc(1 + (page_id or 0) % 2, arc_url(url), date, (html or "").encode("utf-8", "surrogatepass"))
                    out += [to_warc(record, page_id, first, bare=True) for record in parse_arc(arc)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return joined.mapInArrow(run, "value binary")


def arc_to_warc(spark, folder: str) -> DataFrame:
    """file, offset, value: the WARC record of each record of the ARC files (.arc, .arc.gz) in a folder. A file, about 100 MB by
    convention, is read by one task."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_py()
                for record in parse_arc(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    file = name.rsplit("/", 1)[-1]
                    row = to_warc(record, f"{file}:{record.offset}")
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([record.offset], pa.int64()), pa.array([row], pa.binary())], names=["file", "offset", "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{arc,arc.gz}").load(folder)
    return files.select("path", "content").mapInArrow(run, "file string, offset long, value binary")


def _filed(most: int):
    def run(batches):
        """One row for each file: a warcinfo record and others of so many bytes, or one larger, with what parts them."""
        held, size = [], 0
        for batch in batches:
            for value in batch.column(0):
                record = value.as_py()
                if held and size + len(record) > most:
                    yield row(held)
                    held, size = [], 0
                held.append(record)
                size += len(record)
        if held:
            yield row(held)

    def row(records: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([END.encode().join([information(records[0]), *records])], pa.binary())], names=["value"])

    return run


def write_records(records: DataFrame, folder: str) -> str:
    """Writes WARC records (column ``value``) as files into ``folder``, which driver and executors share."""
    files = records.select("value").mapInArrow(_filed(FILE_BYTES), "value binary").select(F.col("value").cast("string"))
    files.write.option("lineSep", END).option("maxRecordsPerFile", 1).text(folder)
    return folder


def write_warc(pages: DataFrame, folder: str) -> str:
    return write_records(convert(pages), folder)


FACTS = StructType([StructField("page_id", LongType()), StructField("payload_bytes", LongType()), StructField("payload_digest", StringType()), StructField("record_type", StringType()), StructField("refers_to", LongType()), StructField("url", StringType())])


def read_warc(spark, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every record in the archives of ``folder``, written.

    Length and digest of a response come from its stored payload and must agree with its header; those that a revisit states must be
    those of a response in the archives under the page that it refers to.
    """

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for head, block in parse_warc(data.as_py()):
                    kind = head["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    n, stated = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind != "revisit":
                        payload = block[int(head["X-Head-Length"]) :]
                        if (len(payload), hashlib.sha256(payload).hexdigest()) != (n, stated):
                            raise ValueError(f"the payload of {head['WARC-Record-ID']} is not the one its header tells of")
                    number = lambda k: int(head[k]) if k in head else None  # noqa: E731, B023
                    rows.append((number("X-Page-Id"), n, stated, kind, number("X-Refers-To-Page-Id"), head["WARC-Target-URI"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=FACTS.names)

    found = cut(spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, FACTS), "records")
    sought = found.where("record_type = 'revisit'").selectExpr("refers_to AS page_id", "payload_digest", "payload_bytes").distinct()
    lost = sought.join(found.where("record_type = 'response'"), sought.columns, "left_anti").take(1)
    if lost:
        raise ValueError(f"a revisit refers to page {lost[0]['page_id']}, which has no response with its payload")
    return found


def archived(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    return read_warc(spark, write_warc(pages, scratch_path(spark, "warc")))
