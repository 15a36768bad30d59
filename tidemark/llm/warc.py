"""WARC archives from legacy ARC records.

The converter reads ARC data of version 1 (URL, address, date, type, length) and version 2
(with result code, checksum, location, offset and file name before the length), takes as many
bytes as a header line declares, and synthesises what WARC wants: a record id derived from the
content, an ISO timestamp from the 14-digit date, the record type, and SHA-1 digests of block
and payload. A payload that was seen under a smaller id becomes a revisit of that record.

Archives are written by Spark's text writer, whose line end completes the blank lines behind a
record, as gzip files in a shared folder, and read back with the binary file source, record by
record by declared length. A file holds at most ``RECORDS`` records; pages of more than ``LARGE`` bytes
are written apart, as many to a file as fit into ``FILE`` bytes. So no file is larger than FILE bytes or
its one page, and a reader holds one file in its compressed form.

Which pages are revisits is found from ids and digests alone. Their table is broadcast up to
``shared.BROADCAST_ROWS`` counted rows; beyond it pages are shuffled once by id.

Defined results: a null payload is empty; records of equal payload refer to the smallest
page_id; rows that repeat that id and payload are responses too; null ids count as larger than
any; an empty table makes an archive without records; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpointed, shared_folder, small

RECORDS, LARGE, FILE = 1_000, 1 << 16, 1 << 26
#: Copies of a repeated payload's row, over which its pages are spread.
SALTS = 16
HTTP = b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class ArcRecord:
    url: str
    address: str
    date: str
    kind: str
    content: bytes
    status: str | None = None
    checksum: str | None = None
    location: str | None = None
    filename: str | None = None


def write_arc(records: list[ArcRecord], version: int = 1) -> bytes:
    """An ARC file: a version block, then each record behind its header line."""
    columns = "URL IP-address Archive-date Content-type Archive-length" if version == 1 else "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
    about = f"{version} 0 -\n{columns}\n".encode()
    extra = " 200 - - 0 -" if version == 2 else ""
    out = [f"filedesc://pages.arc 0.0.0.0 19960101000000 text/plain{extra} {len(about)}\n".encode(), about, b"\n"]
    at = sum(map(len, out))
    for r in records:
        extra = f" {r.status or '-'} {r.checksum or '-'} {r.location or '-'} {at} {r.filename or '-'}" if version == 2 else ""
        part = f"{r.url} {r.address} {r.date} {r.kind}{extra} {len(r.content)}\n".encode() + r.content + b"\n"
        out.append(part)
        at += len(part)
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of ARC data; the version block at its start says how header lines read."""
    at, version = 0, 1
    while at < len(data):
        if data[at : at + 1] == b"\n":  # blank lines may stand between records
            at += 1
            continue
        end = data.index(b"\n", at)
        fields = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        length = int(fields[-1])
        content = data[end + 1 : end + 1 + length]
        if len(content) < length:
            raise ValueError(f"the record at byte {at} declares {length} bytes, {len(content)} are there")
        at = end + 1 + length
        if fields[0].startswith("filedesc:"):
            version = int(content.split(b" ", 1)[0])
            if version not in (1, 2):
                raise ValueError(f"ARC version {version} is unknown")
            continue
        if len(fields) != (5 if version == 1 else 10):
            raise ValueError(f"a version-{version} header line has {len(fields)} fields")
        known = lambda s: None if s == "-" else s
        more = dict(zip(("status", "checksum", "location"), map(known, fields[4:7]))) | {"filename": known(fields[8])} if version == 2 else {}
        yield ArcRecord(*fields[:4], content, **more)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{payload_digest}')}>"


def iso(date: str) -> str:
    """A 14-digit date as WARC writes it; missing digits are filled from the start of the epoch."""
    d = (re.sub("[^0-9]", "", date) + "00000101000000"[len(re.sub("[^0-9]", "", date)) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def to_warc(arc: ArcRecord, page_id: int | None, revisit: bool, refers_to: int | None) -> bytes:
    """The WARC record of an ARC record, up to the last line feed, which the writer adds."""
    head, blank, payload = arc.content.partition(b"\r\n\r\n")
    if not blank or not head.startswith(b"HTTP/"):
        head, blank, payload = b"", b"", arc.content
    sha = digest(payload)
    block = head + blank if revisit else arc.content
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, sha)}",
        f"WARC-Date: {iso(arc.date)}",
        f"WARC-Target-URI: {arc.url}",
        f"WARC-IP-Address: {arc.address}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"X-Payload-Length: {len(payload)}",
        *([f"X-Page-ID: {page_id}"] if page_id is not None else []),
        *([f"WARC-Refers-To: {record_id(refers_to, sha)}", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"] if revisit else []),
        f"Content-Type: {'application/http; msgtype=response' if head else arc.kind}",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r"


def read_warc(data: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a stream, by declared length."""
    buffer = bytearray()
    done = False

    def fill(n: int) -> bool:
        nonlocal done
        while len(buffer) < n and not done:
            part = next(data, None)
            if part is None:
                done = True
            else:
                buffer.extend(part)
        return len(buffer) >= n

    while fill(1):
        seen = 0
        while (end := buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(buffer)
            if not fill(seen + 1):
                raise ValueError("a record's header has no end")
        lines = buffer[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins with {lines[0][:20]!r}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        stop = end + 4 + int(headers["content-length"])
        if not fill(stop + 4) or buffer[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        block = bytes(buffer[end + 4 : stop])
        del buffer[: stop + 4]
        yield headers, block


def inflate(content: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The data of one or more gzip members, in parts of bounded size."""
    while content:
        z = zlib.decompressobj(31)
        while not z.eof:
            part = z.decompress(content, size)
            content = z.unconsumed_tail
            if part:
                yield part
            elif not content and not z.eof:
                raise ValueError("a gzip member is cut off")
        content = z.unused_data


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, size = [], 0
        for page_id, url, html, revisit, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
            target = quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%-._~")
            page = ArcRecord(target, "0.0.0.0", "20240101000000", "text/html", HTTP + (html or "").encode("utf-8", "surrogatepass"), status="200")
            for arc in read_arc(write_arc([page], 1 + (page_id or 0) % 2)):
                out.append(to_warc(arc, page_id, revisit, refers_to))
                size += len(out[-1])
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


def _payload() -> Column:
    return F.encode(F.coalesce("html", F.lit("")), "UTF-8")


def revisits(facts: DataFrame) -> DataFrame:
    """page_id, sha and refers_to of pages (page_id, sha) whose payload a smaller page_id has."""
    firsts = facts.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    # One payload, such as the empty one, may be that of a third of all pages.
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = facts.select("page_id", "sha", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("salt"))
    return salted.join(firsts, ["sha", "salt"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "sha", "refers_to").distinct()


def write(pages: DataFrame, folder: str) -> None:
    """Write a WARC record for each row of ``pages`` (page_id, url, html)."""
    facts = checkpointed(pages.select("page_id", F.sha1(_payload()).alias("sha"), F.octet_length(_payload()).alias("size")))
    largest = facts.agg(F.max("size")).first()[0] or 0
    again = checkpointed(revisits(facts))
    again = small(again, again.count()).withColumnRenamed("page_id", "_id").withColumn("revisit", F.lit(True))
    plain = pages.select("page_id", "url", "html", F.sha1(_payload()).alias("_sha"))

    def save(part: DataFrame, most: int) -> None:
        joined = part.join(again, part["page_id"].eqNullSafe(again["_id"]) & (part["_sha"] == again["sha"]), "left")
        rows = joined.select("page_id", "url", "html", F.coalesce("revisit", F.lit(False)).alias("revisit"), "refers_to")
        records = rows.mapInArrow(_convert, "record binary").select(F.col("record").cast("string"))
        records.write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", most).text(folder)

    if largest <= LARGE:
        save(plain, RECORDS)
        return
    size = F.octet_length(_payload())
    save(plain.where(size <= LARGE), RECORDS)
    save(plain.where(size > LARGE), max(1, FILE // largest))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for h, block in read_warc(inflate(content.as_py())):
                sha, size, kind = h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"]), h["warc-type"]
                if kind == "response":
                    payload = block.partition(b"\r\n\r\n")[2] if h["content-type"].startswith("application/http") else block
                    if (digest(payload), len(payload)) != (sha, size):
                        raise ValueError(f"the payload of {h['warc-record-id']} doesn't match its digest")
                number = lambda k, h=h: int(h[k]) if k in h else None
                rows.append((number("x-page-id"), size, sha, kind, number("x-refers-to-page-id")))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of archived records."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInArrow(_digests, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    folder = shared_folder(pages.sparkSession, "warc")
    write(pages, folder)
    return read(pages.sparkSession, folder)
