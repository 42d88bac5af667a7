"""Web archives: ARC files of both versions, their conversion to WARC, and readers of both (operator 11).

An archive is a file of independent gzip members, one a record, of about `archive_bytes` of records. Spark's
text writer writes it as it is: a row is a file, and the byte 0 that ends a member (or pads the last one) is
the writer's line separator. Files are read with Spark's binary reader, so any store that Spark knows will do.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, portions, shared_dir, stage, table

# The header fields of URL records by ARC version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
NO_URL, PAGE = "unknown:", "X-Page-Id"
ARC_RECORDS = "path string, page_id long, tag long, digest string, payload_bytes long"
WARC_RECORDS = "record_id string, record_type string, warc_date string, uri string, page_id long, payload_bytes long, payload_digest string, refers_to_id string, refers_to long"


_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


# --- files of gzip members


def member(data: bytes, level: int = 1) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def files(items: Iterable, head: Callable[[int], bytes], record: Callable[[int, object], bytes], archive_bytes: int) -> Iterator[pa.RecordBatch]:
    """Archives as rows without their last byte, which is 0; number n holds head(n) and record(n, item) of its items."""
    held, size, n = [], 0, 0

    def row() -> pa.RecordBatch:
        content = b"".join(held)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([content.removesuffix(b"\0")], pa.binary())], ["value"])

    for item in items:
        if not held:
            held.append(member(head(n)))
        data = record(n, item)
        held.append(member(data))
        size += len(data)
        if size >= archive_bytes:
            yield row()
            size, n = 0, n + 1
            pa.default_memory_pool().release_unused()
    if held:
        yield row()


def write_files(archives: DataFrame, path: str) -> None:
    archives.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").load(path).select("path", "content")


class Records:
    """Lines and runs of bytes of an archive, plain or of gzip members, of which one at a time is held decompressed."""

    def __init__(self, content: bytes) -> None:
        self.parts = self._members(content) if content[:2] == b"\x1f\x8b" else iter([content])
        self.held, self.at = b"", 0

    @staticmethod
    def _members(content: bytes) -> Iterator[bytes]:
        view, at = memoryview(content), 0
        while at < len(content) and content[at]:  # zeros are padding
            opener, end = zlib.decompressobj(31), at
            pieces = []
            while not opener.eof:
                if end == len(content):
                    raise ValueError("an archive ends within a record")
                step = view[end : end + (1 << 16)]
                pieces.append(opener.decompress(step))
                end += len(step)
            at = end - len(opener.unused_data)
            yield b"".join(pieces)

    def _more(self) -> bool:
        part = next(self.parts, None)
        if part is None:
            return False
        self.held, self.at = self.held[self.at :] + part, 0
        return True

    def line(self) -> bytes | None:
        """The next line without its end, None after the last."""
        while (end := self.held.find(b"\n", self.at)) < 0:
            if not self._more():
                rest, self.at = self.held[self.at :], len(self.held)
                return rest or None
        found, self.at = self.held[self.at : end], end + 1
        return found

    def filled_line(self) -> bytes | None:
        """The next line that is not blank: records are set off by blank lines."""
        while (found := self.line()) is not None and not found.strip():
            pass
        return found

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            if not self._more():
                raise ValueError("a record is shorter than its declared length")
        found, self.at = self.held[self.at : self.at + n], self.at + n
        return found


# --- ARC


def arc_head(name: str, date: str, version: int) -> bytes:
    """The version block: filedesc line with the length of what follows, version line, names of the fields."""
    body = f"{version} 0 epiweave\n{ARC_FIELDS[version]}\n".encode()
    more = f" 200 - - 0 {name}" if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{more} {len(body)}\n".encode() + body + b"\n"


def arc_record(name: str, date: str, version: int, url: bytes, block: bytes) -> bytes:
    """A URL record line with the declared length, and the block. Blanks and controls in a url are escaped."""
    url = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url) or NO_URL.encode()
    more = f" 200 {hashlib.md5(block).hexdigest()} - 0 {name}" if version == 2 else ""
    return url + f" 0.0.0.0 {date} text/html{more} {len(block)}\n".encode() + block + b"\n"


def http_block(page_id: int | None, payload: bytes) -> bytes:
    own = "" if page_id is None else f"{PAGE}: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def parse_arc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of the records of an ARC file: first the version block, whose last line names the fields of the others.

    A header line is split from its right, as urls of old crawls hold blanks; blocks go by the declared length.
    """
    records = Records(content)
    first = records.filled_line()
    if first is None:
        return
    if not first.startswith(b"filedesc://"):
        raise ValueError("an ARC file starts with its filedesc record")
    body = records.take(int(first.rsplit(b" ", 1)[1]))
    version, names = (x.split() for x in body.decode().split("\n")[:2])
    if int(version[0]) not in ARC_FIELDS:
        raise ValueError(f"unknown ARC version {version[0]}")
    url, _, date = first.decode("utf-8", "replace").split(" ")[:3]
    yield {"URL": url, "Archive-date": date, "Version": version[0]}, body
    while (line := records.filled_line()) is not None:
        values = line.decode("utf-8", "replace").rstrip("\r").rsplit(" ", len(names) - 1)
        if len(values) != len(names):
            raise ValueError(f"an ARC header of {len(values)} fields instead of {len(names)}")
        fields = dict(zip(names, values, strict=True))
        yield fields, records.take(int(fields["Archive-length"]))


def parts_of(block: bytes) -> tuple[bytes, bytes]:
    """The HTTP header with its blank line, and the payload; a block that is no HTTP message is all payload."""
    end = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
    return (block[:end], block[end:]) if end > 3 else (b"", block)


def page_of(header: bytes) -> int | None:
    found = re.search(rb"\r\n%s: (-?\d+)\r\n" % PAGE.encode(), header)
    return int(found[1]) if found else None


def tag_of(path: str, number: int) -> int:
    """57 bits that tell the records of all archives apart."""
    return int.from_bytes(hashlib.sha1(f"{path.rsplit('/', 1)[-1]}#{number}".encode()).digest()[:8]) >> 7


def record_id(page_id: int | None, tag: int) -> str:
    """A UUID of version 8 that holds the page_id (or that it is null) and the tag."""
    bits = (page_id or 0) % (1 << 64) << 58 | (page_id is None) << 57 | tag  # 122 bits
    return str(uuid.UUID(int=bits >> 74 << 80 | 8 << 76 | (bits >> 62) % (1 << 12) << 64 | 2 << 62 | bits % (1 << 62)))


def page_of_id(text: str) -> int | None:
    value = uuid.UUID(text).int
    bits = value >> 80 << 74 | (value >> 64) % (1 << 12) << 62 | value % (1 << 62)
    page = bits >> 58
    return None if bits >> 57 & 1 else page - (page >> 63 << 64)


def write_arc(pages: DataFrame, path: str, date: str = "20200101000000", archive_bytes: int = 8 << 20) -> None:
    """pages(page_id, url, html) -> ARC files, of version 1 and 2 in turn; the payload of a record is the html in UTF-8.

    Null html has an empty payload, a null or empty url is written as `unknown:`, a null page_id leaves its
    header out. Repeated rows are records of their own; an empty table writes no archive.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        name = lambda n: f"pages-{part:06d}-{n:06d}.arc"
        version = lambda n: (part + n) % 2 + 1
        portion = (b.slice(at, k) for b in batches for at, k in portions(b.column("html")))
        items = (row for b in portion for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True))
        record = lambda n, row: arc_record(name(n), date, version(n), row[1] or b"", http_block(row[0], row[2] or b""))
        yield from files(items, lambda n: arc_head(name(n), date, version(n)), record, archive_bytes)

    rows = pages.select(F.col("page_id").cast("long"), *(F.col(c).cast("string").cast("binary").alias(c) for c in ("url", "html")))
    write_files(rows.mapInArrow(run, "value binary"), path)


def arc_records(archives: DataFrame) -> DataFrame:
    """archives(path, content) -> what tells equal payloads apart, a row a record: path, page_id, tag, digest (SHA-1), payload_bytes."""

    def run(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows = []
                for number, (_, block) in enumerate(parse_arc(content.as_py())):
                    if number:  # the first describes the file
                        header, payload = parts_of(block)
                        rows.append((path, page_of(header), tag_of(path, number), hashlib.sha1(payload).hexdigest(), len(payload)))
                if rows:
                    yield batch_of(rows, ARC_RECORDS)

    return archives.mapInArrow(run, ARC_RECORDS)


# --- WARC


def sha1_name(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_date(arc_date: str) -> str:
    d = (arc_date + "00000000")[:14] if len(arc_date) >= 8 else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.0", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warc_info(fields: dict[str, str], name: str) -> bytes:
    about = f"software: epiweave\r\nformat: WARC File Format 1.0\r\nconverted-from: {fields['URL']} (ARC version {fields['Version']})\r\n".encode()
    own = uuid.uuid5(uuid.NAMESPACE_URL, fields["URL"] + name)
    headers = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{own}>"), ("WARC-Date", warc_date(fields["Archive-date"])), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return warc_record(headers, about)


def converted(fields: dict[str, str], block: bytes, tag: int, target: tuple[int | None, int] | None) -> bytes:
    """The WARC record of an ARC record: a revisit of target (page_id, tag), else a response, or a resource if it is no HTTP message."""
    header, payload = parts_of(block)
    http, url = bool(header), fields["URL"]
    kind = "revisit" if target else "response" if http or url.startswith("dns:") else "resource"
    kept = header if target else block
    address = fields["IP-address"]
    headers = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id(page_of(header), tag)}>"), ("WARC-Date", warc_date(fields["Archive-date"])), ("WARC-Target-URI", url),
        ("WARC-IP-Address", None if address in ("0.0.0.0", "-") else address), ("WARC-Payload-Digest", sha1_name(payload)), ("WARC-Block-Digest", sha1_name(kept)),
        ("WARC-Profile", PROFILE if target else None), ("WARC-Refers-To", f"<urn:uuid:{record_id(*target)}>" if target else None), ("X-Payload-Length", len(payload) if target else None),
        ("Content-Type", "application/http; msgtype=response" if http else fields["Content-type"]),
    ]
    return warc_record(headers, kept)


def revisits(records: DataFrame, least: int, most: int = 1_000_000) -> DataFrame:
    """`arc_records` -> (path, revisits): of equal payloads of at least `least` bytes, all but the one of the largest page_id.

    Payloads are equal by SHA-1 and length. Ties of page_id (and records without one) go by the tag. The
    largest of each payload is found by a pre-aggregated maximum, so a payload of a third of all records is no
    burden; those that repeat meet their records by a broadcast of at most 200,000, else by a join that
    adaptive execution splits where it is skewed. A row holds an archive's revisits, at most its records;
    up to `most` of them all together (some 40 bytes each) are marked for a broadcast, which leaves the
    archives where they are, and more for a shuffled hash join, which moves archives once as they are stored.
    """
    long = records.where(F.col("payload_bytes") >= least)
    largest = long.groupBy("digest", "payload_bytes").agg(F.count("*").alias("_n"), F.max(F.struct("page_id", "tag")).alias("target"))
    again = stage(largest.where("_n > 1").drop("_n"), "repeated")
    hits = long.join(bounded(again, 200_000), ["digest", "payload_bytes"]).where("tag <> target.tag")
    hits = stage(hits.select("path", "tag", F.col("target.page_id").alias("page_id"), F.col("target.tag").alias("to")), "revisits")
    lists = hits.groupBy("path").agg(F.collect_list(F.struct("tag", "page_id", "to")).alias("revisits"))
    return F.broadcast(lists) if hits.limit(most + 1).count() <= most else lists.hint("shuffle_hash")


def convert(spark: SparkSession, arcs: str, path: str, least: int = 1000, archive_bytes: int = 8 << 20, most: int = 1_000_000) -> None:
    """Converts a folder of ARC files to WARC files: each record's block is carried over, revisits keep only its HTTP header.

    The first pass reads identities and digests; the second reads an archive beside its list of revisits.
    """
    records = stage(arc_records(read_files(spark, arcs)), "arc-records")
    lists = revisits(records, least, most)

    def run(batches):
        part, first = TaskContext.get().partitionId(), {}
        name = lambda n: f"pages-{part:06d}-{n:06d}.warc"

        def items():
            for b in batches:
                for path, content, again in zip(b.column("path").to_pylist(), b.column("content"), b.column("revisits"), strict=True):
                    targets = {r["tag"]: (r["page_id"], r["to"]) for r in again.as_py() or []}
                    for number, (fields, block) in enumerate(parse_arc(content.as_py())):
                        if not number:
                            first["fields"] = fields
                            continue
                        yield fields, block, (tag := tag_of(path, number)), targets.get(tag)

        yield from files(items(), lambda n: warc_info(first["fields"], name(n)), lambda n, item: converted(*item), archive_bytes)

    both = read_files(spark, arcs).join(lists, "path", "left")
    write_files(both.mapInArrow(run, "value binary"), path)


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of the records of a WARC file, by declared lengths."""
    records = Records(content)
    while (line := records.filled_line()) is not None:
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record starts with its version")
        headers = {}
        while (line := records.line()) and line.strip():
            name, value = line.decode("utf-8", "replace").split(":", 1)
            headers[name.strip().lower()] = value.strip()
        yield headers, records.take(int(headers["content-length"]))


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of WARC files but warcinfo: identifiers, type, date, uri, page_id, payload_bytes, payload_digest (lower-case hex),
    refers_to_id and the page_id in it, and, if asked for, the payload (null for revisits).

    Digests of payloads that are there are computed anew; a record whose own differs fails the job.
    """
    schema = WARC_RECORDS + ", payload binary" * payload

    def row(headers: dict[str, str], block: bytes) -> tuple:
        header, body = parts_of(block)
        digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
        again = headers["warc-type"] == "revisit"
        if not again and hashlib.sha1(body).hexdigest() != digest:
            raise ValueError(f"the payload of {headers['warc-record-id']} differs from its digest")
        to = headers.get("warc-refers-to", "")[10:-1] or None
        own = (headers["warc-record-id"][10:-1], headers["warc-type"], headers["warc-date"], headers.get("warc-target-uri"), page_of(header), int(headers["x-payload-length"]) if again else len(body), digest, to, page_of_id(to) if to else None)
        return (*own, None if again else body) if payload else own

    def run(batches):
        for b in batches:
            for content in b.column("content"):
                rows, size = [], 0
                for headers, block in parse_warc(content.as_py()):
                    if headers["warc-type"] != "warcinfo":
                        rows.append(row(headers, block))
                    size += len(block)
                    if rows and size > 4 << 20:
                        yield batch_of(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows, schema)

    return read_files(spark, path).select("content").mapInArrow(run, schema)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as ARC files, converted to WARC files, which are read back."""
    arcs, warcs = shared_dir(spark, "arc"), shared_dir(spark, "warc")
    write_arc(table(spark, sf_dir, "pages"), arcs)
    convert(spark, arcs, warcs)
    return read_warc(spark, warcs).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) AS r, first_value(page_id) OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) AS top FROM pages)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND r > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND r > 1 THEN top END AS refers_to FROM p"""
