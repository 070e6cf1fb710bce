"""Legacy ARC archives, and their conversion to WARC.

ARC files open with a version block whose first line says which of the two URL
record lines follows: version 1 has five fields, version 2 ten; both end with
the declared length of what comes after. The converter parses records by these
lines and lengths and synthesises what WARC wants besides: record identifiers,
ISO timestamps, record types, payload and block digests. HTTP responses become
response records; all else (``dns:`` and other schemes, content without a status
line) becomes resource records of the ARC content type, with the whole content as
payload. Payloads seen before in records of the same kind become revisit records,
which keep the HTTP header, if there is one, and the payload's length only.

Archives are written by Spark, so they can be in any store it reaches: each
record is a gzip member of its own, members lie back to back, and each partition is
one file, which any gzip tool reads to its end.

Defined results: a null html is an empty payload; a null url becomes
``urn:page:<page_id>``; a null page_id ranks below every other; of equal payloads
under one page_id the last in the archives is the response; only the first record
of a file can be its version block, whatever URLs begin with; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlode.llm.arrow import longs
from assetlode.llm.hot import lookup
from assetlode.plans.staging import materialize, staging_path

DATE = "20000101000000"
ADDRESS = "192.0.2.1"
LEVEL = 3
CHUNK = 1 << 20
# The field lines of the two ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
HTTP_TYPE = "application/http; msgtype=response"
STATUS_LINE = re.compile(rb"HTTP/\d")
HEAD_END = re.compile(rb"\r?\n\r?\n")
#: Schemes whose records are not HTTP responses as a rule; a page may have any URL or a bare name.
OTHER_SCHEME = re.compile(r"(?!https?:|urn:)[a-z][a-z0-9+-]*:", re.I)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def squeezed(data: bytes) -> bytes:
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def member(data: bytes) -> bytes:
    """``data`` as a gzip member whose last byte is zero.

    That byte is the highest of the data's length, so it differs from zero only
    from 16 MiB on; an empty member is put behind then.
    """
    out = squeezed(data)
    return out if out[-1] == 0 else out + squeezed(b"")


def inflate(blob: bytes) -> Iterator[bytes]:
    """What the gzip members of ``blob`` hold, in parts; a blob that is no gzip file is passed on."""
    if blob[:2] != b"\x1f\x8b":
        yield blob
        return
    rest, size = memoryview(blob), len(blob)
    at = 0
    while at < size:
        if rest[at] == 0:
            at += 1
            continue
        stream = zlib.decompressobj(31)
        while at < size and not stream.eof:
            piece = rest[at : at + CHUNK]
            part = stream.decompress(piece)
            at += len(piece) - len(stream.unused_data)
            if part:
                yield part


class Reader:
    """Lines and declared lengths from a stream of parts."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.buffer, self.at = parts, b"", 0

    def _more(self) -> bool:
        part = next(self.parts, None)
        if part is None:
            return False
        self.buffer, self.at = self.buffer[self.at :] + part, 0
        return True

    def line(self) -> bytes | None:
        while (end := self.buffer.find(b"\n", self.at)) < 0:
            if not self._more():
                left, self.at = self.buffer[self.at :], len(self.buffer)
                return left or None
        out, self.at = self.buffer[self.at : end], end + 1
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.at < n:
            if not self._more():
                raise ValueError(f"an archive ends {n - len(self.buffer) + self.at} bytes too early")
        out, self.at = self.buffer[self.at : self.at + n], self.at + n
        return out


# ARC


def arc_line(version: int, url: str, mime: str, length: int, status: int = 200, checksum: str = "-", offset: int = 0, name: str = "-") -> bytes:
    url = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url)
    fields = [url, ADDRESS, DATE, mime]
    if version == 2:
        fields += [status, checksum, "-", offset, name]
    return " ".join(map(str, [*fields, length])).encode() + b"\n"


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 assetlode\n{ARC_FIELDS[version]}\n".encode()
    return f"filedesc://{name} 0.0.0.0 {DATE} text/plain {len(body)}\n".encode() + body + b"\n"


def arc_records(parts: Iterator[bytes]) -> Iterator[dict]:
    """The records of an ARC file by its own version line."""
    reader, version, first = Reader(parts), 1, True
    while (line := reader.line()) is not None:
        if not line.strip():
            continue
        fields = line.decode("utf-8", "replace").split(" ")
        opening, first = first and fields[0].startswith("filedesc://"), False
        if opening:
            block = reader.take(int(fields[-1]))
            version = int(block.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is unknown")
            continue
        names = ARC_FIELDS[version].lower().split(" ")
        yield dict(zip(names, fields)) | {"version": version, "content": reader.take(int(fields[-1]))}


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """Head and body; heads may end with bare line feeds, and one without an end has no body."""
    end = HEAD_END.search(content)
    at = end.end() if end else len(content)
    return content[:at], content[at:]


def header_fields(head: bytes) -> dict[str, str]:
    pairs = (x.partition(":") for x in head.decode("utf-8", "replace").split("\n")[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def media_type(value: str) -> str:
    return value.partition(";")[0].strip().lower()


def payload_of(url: str, mime: str, content: bytes) -> tuple[dict[str, str], bytes, str | None]:
    """HTTP fields, payload and, where the content is no HTTP response, its media type.

    Under other schemes than HTTP's, content with a status line is a response only
    if it declares the type that the ARC record has.
    """
    if STATUS_LINE.match(content):
        head, body = split_http(content)
        http = header_fields(head)
        if not OTHER_SCHEME.match(url) or media_type(http.get("content-type", "")) == media_type(mime):
            return http, body, None
    return {}, content, mime if "/" in mime else "application/octet-stream"


def number(value: str | None) -> int | None:
    return int(value) if value else None


def write_members(members: DataFrame, path: str) -> str:
    """One binary column of ``member``s as archive files, back to back, a file for each partition.

    Spark's text files end each row with a separator. The last byte of a member
    is always zero, so it is left to that separator.
    """
    blob = F.col(members.columns[0])
    members.select(F.substring(blob, F.lit(1), F.octet_length(blob) - 1).cast("string").alias("value")).write.option("lineSep", "\0").text(path)
    return path


def write_arc(pages: DataFrame, path: str) -> str:
    """Each page as an HTTP response in an ARC record; even partitions write version 1, odd ones version 2."""

    def run(batches):
        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"part-{part:05d}.arc.gz"
        head = member(arc_version_block(version, name))
        offset, out = len(head), [head]
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                payload = (html or "").encode()
                http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
                        f"X-Page-Id: {'' if page_id is None else page_id}\r\n\r\n").encode() + payload
                line = arc_line(version, f"urn:page:{page_id}" if url is None else url, "text/html", len(http), 200, "-", offset, name)
                out.append(member(line + http + b"\n"))
                offset += len(out[-1])
                if len(out) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    return write_members(pages.select("page_id", "url", "html").mapInArrow(run, "member binary"), path)


# Conversion


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def record_id(url: str, date: str, page_id: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {page_id} {digest}')}"


def iso(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def parse_arc(archives: DataFrame, payloads: bool) -> DataFrame:
    """One row per ARC record: archive, place, page_id, url, date, ip, mime (null for HTTP), bytes, digest, and the content if ``payloads``."""
    names = ["archive", "place", "page_id", "url", "date", "ip", "mime", "bytes", "digest"] + ["content"] * payloads
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * payloads

    def run(batches):
        for batch in batches:
            for path, blob in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = []
                for place, r in enumerate(arc_records(inflate(blob.as_py()))):
                    http, body, mime = payload_of(r["url"], r["content-type"], r["content"])
                    row = [path.rpartition("/")[2], place, number(http.get("x-page-id")), r["url"], r["archive-date"], r["ip-address"], mime, len(body), sha1(body)]
                    rows.append(row + [r["content"]] * payloads)
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return archives.mapInArrow(run, "archive string, place long, page_id long, url string, date string, ip string, mime string, bytes long, digest string" + ", content binary" * payloads)


def revisits(records: DataFrame, least: int) -> DataFrame:
    """The records (archive, place) that repeat a payload, with the response they refer to."""
    total = records.count()
    big = records.where(F.col("bytes") >= least).withColumn("digest", F.concat(F.coalesce("mime", F.lit("")), "digest"))
    key = F.struct("page_id", "archive", "place", "url", "date")
    groups = materialize(big.groupBy("digest").agg(F.max(key).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "payload-groups")
    hits = lookup(big.select("digest", "archive", "place"), groups, "digest", "copies", total)
    again = ~((F.col("archive") == F.col("first.archive")) & (F.col("place") == F.col("first.place")))
    return hits.where(again).select("archive", "place", F.lit(True).alias("again"), F.col("first.page_id").alias("to_page"),
                                    F.col("first.url").alias("to_url"), F.col("first.date").alias("to_date"))


def warc_record(row: dict) -> bytes:
    mime, block = row["mime"], row["content"]
    if row["again"]:
        block = split_http(block)[0] if mime is None else b""
    fields = {
        "WARC-Type": "revisit" if row["again"] else "response" if mime is None else "resource",
        "WARC-Record-ID": f"<{record_id(row['url'], row['date'], row['page_id'], row['digest'])}>",
        "WARC-Date": iso(row["date"]),
        "WARC-Target-URI": row["url"],
        "WARC-IP-Address": row["ip"],
        "WARC-Payload-Digest": f"sha1:{row['digest']}",
        "WARC-Block-Digest": f"sha1:{sha1(block)}",
    }
    if row["again"]:
        fields |= {
            "WARC-Profile": REVISIT_PROFILE,
            "WARC-Refers-To": f"<{record_id(row['to_url'], row['to_date'], row['to_page'], row['digest'])}>",
            "WARC-Refers-To-Target-URI": row["to_url"],
            "WARC-Refers-To-Date": iso(row["to_date"]),
            "X-Payload-Length": row["bytes"],
            "X-Refers-To-Page": "" if row["to_page"] is None else row["to_page"],
        }
    fields |= {"Content-Type": HTTP_TYPE if mime is None else mime, "Content-Length": len(block)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = 0) -> str:
    """Convert the ARC files under ``arc_path``; payloads of at least ``least`` bytes are stored once."""
    archives = read_archives(spark, arc_path)
    known = materialize(parse_arc(archives, payloads=False), "arc-records")
    again = materialize(revisits(known, least), "revisits")

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for at in range(0, len(rows), 500):
                yield pa.RecordBatch.from_arrays([pa.array([member(warc_record(r)) for r in rows[at : at + 500]], pa.binary())], names=["member"])

    # The list of revisits has a known size, as a file; Spark broadcasts it only below its own limit.
    full = parse_arc(archives, payloads=True).join(again, ["archive", "place"], "left")
    return write_members(full.withColumn("again", F.coalesce("again", F.lit(False))).mapInArrow(run, "member binary"), warc_path)


# Reading WARC


def warc_records(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    reader = Reader(parts)
    while (line := reader.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := reader.line()) is not None and line.strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, reader.take(int(fields["content-length"]))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and the block of each record under ``path``.

    Lengths and digests of responses and resources are taken from what is stored; a
    revisit has them in its own header. Revisits of other writers may tell the
    length in their HTTP header only, or not at all (null).
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "block"]

    def run(batches):
        for batch in batches:
            for blob in batch.column("content"):
                rows = []
                for fields, block in warc_records(inflate(blob.as_py())):
                    head, body = split_http(block) if media_type(fields.get("content-type", "")) == "application/http" else (b"", block)
                    http, kind = header_fields(head), fields["warc-type"]
                    stored = kind != "revisit"
                    told = fields.get("x-payload-length") or http.get("content-length", "")
                    rows.append((
                        number(http.get("x-page-id")), fields["warc-target-uri"], len(body) if stored else int(told) if told.isdecimal() else None,
                        sha1(body) if stored else fields["warc-payload-digest"].removeprefix("sha1:"), kind, number(fields.get("x-refers-to-page")), block,
                    ))
                    if len(rows) >= 500:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    def batch_of(rows):
        ids, urls, sizes, digests, kinds, refers, blocks = zip(*rows)
        columns = [longs(ids), pa.array(urls, pa.string()), longs(sizes), pa.array(digests, pa.string()), pa.array(kinds, pa.string()), longs(refers), pa.array(blocks, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return read_archives(spark, path).mapInArrow(
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, block binary")


def archive_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages`` through ARC and WARC files in the shared folder, as read back."""
    spark = pages.sparkSession
    arc = write_arc(pages, staging_path(spark, "arc"))
    return read_warc(spark, convert(spark, arc, staging_path(spark, "warc"), least))
