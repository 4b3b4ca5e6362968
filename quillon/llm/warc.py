"""Web archives: pages to legacy ARC files, ARC files to WARC files, and WARC files to rows.

ARC headers are one line of fields that the file's version block names; WARC headers are named
lines. Both declare how many bytes follow, and readers go by that alone. Each record is a gzip
member of its own, so that a reader can start at any of them. Files are written by Spark's text
sink and read by its binary file source, so they may lie in any store that Spark reaches. The
sink ends each row by a separator, for which the zero byte serves that a member ends with. A file
holds what one task read, an input split; readers inflate it piece by piece and hold one record
at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, new_path, written

#: Fields of a record's line in version 1 and in version 2 of the ARC format. Fixed values.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "20240101000000"
#: Bytes that are inflated at once, and of records in an Arrow batch.
_PIECE, _BATCH = 1 << 16, 1 << 20


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- reading by declared lengths ----------------------------------------------


class Inflated:
    """Reads a gzip or plain file's bytes by line or by length, inflating as it goes."""

    def __init__(self, content: bytes):
        self.zip = zlib.decompressobj(31) if content[:2] == b"\x1f\x8b" else None
        self.rest, self.buffer, self.at = memoryview(content), b"", 0

    def _more(self) -> bool:
        if not len(self.rest):
            return False
        piece, self.rest = bytes(self.rest[:_PIECE]), self.rest[_PIECE:]
        if self.zip:
            out = self.zip.decompress(piece)
            while self.zip.eof and self.zip.unused_data:  # the next member
                piece, self.zip = self.zip.unused_data, zlib.decompressobj(31)
                out += self.zip.decompress(piece)
            piece = out
        self.buffer, self.at = self.buffer[self.at :] + piece, 0
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and without `mark`; None at the end of the file."""
        while (end := self.buffer.find(mark, self.at)) < 0:
            if not self._more():
                left = self.buffer[self.at :]
                if left.strip():
                    raise ValueError("the file ends within a header")
                return None
        out, self.at = self.buffer[self.at : end], end + len(mark)
        return out

    def take(self, count: int) -> bytes:
        parts, have = [], len(self.buffer) - self.at
        while have < count:
            parts.append(self.buffer[self.at :])
            self.at = len(self.buffer)
            count -= have
            if not self._more():
                raise ValueError("the file ends within a record")
            have = len(self.buffer) - self.at
        parts.append(self.buffer[self.at : self.at + count])
        self.at += count
        return b"".join(parts)


def read_arc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, body) of each record after the version block, whatever its version."""
    source, fields = Inflated(content), None
    while (line := source.until(b"\n")) is not None:
        if not line.strip():
            continue
        values = line.decode().split(" ")
        if values[0].startswith("filedesc:"):
            block = source.take(int(values[-1])).decode()
            version, names = block.split("\n")[:2]
            if int(version.split(" ")[0]) not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version: {version}")
            fields = names.split(" ")
            continue
        if fields is None:
            raise ValueError("an ARC file starts with its version block")
        if len(values) != len(fields):
            raise ValueError(f"{len(values)} values for the fields {fields}")
        head = dict(zip(fields, values))
        yield head, source.take(int(head["Archive-length"]))


def read_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header lines, block) of each record."""
    source = Inflated(content)
    while (head := source.until(b"\r\n\r\n")) is not None:
        first, *lines = head.decode().lstrip("\r\n").split("\r\n")
        if not first.startswith("WARC/1."):
            raise ValueError(f"not a WARC record: {first[:80]}")
        names = dict(line.split(": ", 1) for line in lines)
        block = source.take(int(names["Content-Length"]))
        if source.take(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield names, block


def http_parts(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(header lines, head with its blank line, payload) of an HTTP response."""
    head, blank, payload = block.partition(b"\r\n\r\n")
    return dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:]), head + blank, payload


# ---- writing ----------------------------------------------------------------


def member(record: bytes) -> bytes:
    """A gzip member of the record without its last byte, which is zero. A member ends with its length, least
    byte first; from 2**24 bytes on, where the last byte may be another, a member of nothing follows."""
    out = _gzip(record)
    return (out if out[-1] == 0 else out + _gzip(b""))[:-1]


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(wbits=31)
    return z.compress(data) + z.flush()


def _members(records: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for record in records:
        out.append(member(record))
        size += len(out[-1])
        if size > _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def _save(members: DataFrame, path: str) -> None:
    """Rows of bytes, each followed by a zero byte."""
    members.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none").text(path)


def _arc_records(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[bytes]:
    version, name = 1 + part % 2, f"pages-{part:05d}.arc"
    block = f"{version} 0 Quillon\n{' '.join(ARC_FIELDS[version])}\n"
    yield f"filedesc://{name} 0.0.0.0 {DATE} text/plain {len(block)}\n{block}\n".encode()
    for batch in batches:
        for key, url, html in zip(*(batch.column(c) for c in ("key", "url", "html"))):
            payload = (html.as_py() or "").encode()
            mark = f"X-Page-Id: {quote(key.as_py())}\r\n" if key.is_valid else ""
            body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
            uri = quote(url.as_py() or "urn:x-none", safe="/:?#[]@!$&'()*+,;=%~")
            more = f" 200 {payload_digest(payload)} - 0 {name}" if version == 2 else ""
            yield f"{uri} 0.0.0.0 {DATE} text/html{more} {len(body)}\n".encode() + body + b"\n"


def _arc_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    yield from _members(_arc_records(batches, TaskContext.get().partitionId()))


def write_arc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One ARC file per task; versions 1 and 2 in turn. Ids of any type, null too, are written as text."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("string").alias("key"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    _save(rows.mapInArrow(_arc_members, "value binary"), path)


_ARC = "key string, uri string, ip string, date string, mime string, digest string, record_id string, payload_bytes long, zipped binary"


def _schema(columns: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in map(str.split, columns.split(", "))])


def _read_arc(bodies: bool):
    """Records of whole files; with `bodies`, what they hold too, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(_ARC)
        if not bodies:
            schema = schema.remove(len(schema) - 1)
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for head, body in read_arc(content.as_py()):
                    lines, _, payload = http_parts(body)
                    key = unquote(lines["X-Page-Id"]) if "X-Page-Id" in lines else None
                    d = head["Archive-date"]
                    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
                    record = uuid.UUID(bytes=hashlib.sha1(f"{key} {head['URL']} {date}".encode()).digest()[:16], version=5)
                    row = (key, head["URL"], head["IP-address"], date, head["Content-type"], payload_digest(payload), f"<urn:uuid:{record}>", len(payload))
                    rows.append((*row, zlib.compress(body, 1)) if bodies else row)
                    size += len(rows[-1][-1]) if bodies else 256
                    if size > _BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], schema=schema)

    return run


def _warc_records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    info = b"software: quillon\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'quillon')}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
    yield head.encode() + info + b"\r\n\r\n"
    for batch in batches:
        for r in batch.to_pylist():
            body = zlib.decompress(r["zipped"])
            lines = [
                "WARC/1.1", f"WARC-Type: {'revisit' if r['revisit'] else 'response'}", f"WARC-Record-ID: {r['record_id']}", f"WARC-Date: {r['date']}",
                f"WARC-Target-URI: {r['uri']}", f"WARC-IP-Address: {r['ip']}", f"WARC-Payload-Digest: sha1:{r['digest']}", "Content-Type: application/http; msgtype=response"]
            if r["revisit"]:
                _, body, _ = http_parts(body)
                lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {r['first_record']}"]
            lines.append(f"Content-Length: {len(body)}")
            yield "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _warc_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _members(_warc_records(batches))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, *, min_bytes: int = 0, id_type: str = "string") -> None:
    """ARC files to WARC files with made-up record ids, times, types and digests.

    Of records with equal payloads of at least `min_bytes` bytes, that with the largest key, as a
    value of `id_type`, is a response and the others revisit it; a key that several records share is
    one record repeated, and all of them are responses. The files are read twice: for the digests
    alone, whose groups are written, and for the records, whose payloads travel compressed."""
    files = read_files(spark, arc_path)
    names = _ARC.rsplit(", ", 1)[0]
    heads = files.mapInArrow(_read_arc(False), names).filter(F.col("payload_bytes") >= min_bytes)
    groups = heads.groupBy(F.col("digest").alias("d")).agg(F.count("*").alias("n"), F.max(F.struct(F.col("key").cast(id_type).alias("id"), "key", "record_id")).alias("first"))
    groups = written(groups.filter("n > 1").select("d", "first"), "payloads")
    joined = files.mapInArrow(_read_arc(True), _ARC).join(groups, (F.col("digest") == F.col("d")) & (F.col("payload_bytes") >= min_bytes), "left")
    revisit = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first.key"))
    rows = joined.select("uri", "ip", "date", "digest", "record_id", "zipped", F.coalesce(revisit, F.lit(False)).alias("revisit"), F.col("first.record_id").alias("first_record"))
    _save(rows.mapInArrow(_warc_members, "value binary"), warc_path)


_ROW = "key string, payload_bytes long, payload_digest string, record_type string, record_id string, refers string"


def _read_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _schema(_ROW)
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for head, block in read_warc(content.as_py()):
                if head["WARC-Type"] not in ("response", "revisit"):
                    continue
                lines, _, payload = http_parts(block)
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                if head["WARC-Type"] == "response" and payload_digest(payload) != digest:
                    raise ValueError(f"{head['WARC-Record-ID']}: the payload does not have its digest")
                key = unquote(lines["X-Page-Id"]) if "X-Page-Id" in lines else None
                rows.append((key, int(lines["Content-Length"]), digest, head["WARC-Type"], head["WARC-Record-ID"], head.get("WARC-Refers-To")))
                if len(rows) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], schema=schema)


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, record_id, refers) of responses and revisits."""
    return read_files(spark, path).mapInArrow(_read_warc, _ROW)


def warc_round_trip(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes pages as ARC files, converts them to WARC files and reads those back.

    Returns one row per row of `pages`: the id, payload_bytes and payload_digest (bare upper-case
    base32 SHA-1) of the whole payload, record_type (response or revisit) and refers_to (the id of
    the response that a revisit names, else null). A null html is an empty payload; empty payloads
    are equal to each other. Ids are of any type that is text and back; the largest is that of their
    own order. Repeated rows that have the largest id of their payload are all responses. A null id
    is smaller than any other and stays null. Null urls get a placeholder. Pages of any length are
    one record. Other columns are not read, whatever their names. An empty table gives none.
    """
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType.simpleString()
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc, id_col=id_col, url_col=url_col, html_col=html_col)
    convert_arc(spark, arc, warc, min_bytes=min_bytes, id_type=kind)
    rows = written(read_warc_files(spark, warc), "records").withColumn("id", F.col("key").cast(kind))
    out = lambda refers: (F.col("id").alias(id_col), F.col("payload_bytes"), F.col("payload_digest"), F.col("record_type"), refers.cast(kind).alias("refers_to"))
    # only revisits look up what they refer to
    named = written(rows.filter("record_type = 'response'").groupBy(F.col("record_id").alias("r")).agg(F.max("id").alias("response")), "responses")
    revisits = rows.filter("record_type = 'revisit'").join(named, F.col("refers") == F.col("r"), "left")
    return rows.filter("record_type = 'response'").select(*out(F.lit(None))).unionByName(revisits.select(*out(F.col("response"))))
