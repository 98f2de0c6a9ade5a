"""Legacy ARC archives and their conversion to WARC.

An ARC file starts with a version block, which says how many fields the header line of each record has (version 1: five,
version 2: ten) and ends with its declared length; records follow one after the other. The converter reads them by these
lengths, never by looking for marks in the content, and gives each a WARC record: an identifier made from its place in the
archive (file and number), which no other record has, the time in ISO form, a type and digests of block and payload. Of records with equal payloads of at least `least` bytes, that with the
smallest key is the response and the others are revisits of it, which keep the HTTP header only.

Archives are written and read by Spark's own writers and readers in the session's shared folder: a value of the text writer is
a whole file of at most `FILE` bytes (or of one record), however much a partition holds, and files are read whole as binary and
unpacked as a stream. So a task holds one packed file, and of its content one record at a time. Files are packed as a whole,
not record by record.

Which record is the first of its payload is found over digests alone. What follows from it is gathered by file, and meets the
packed files; payloads are not shuffled.

Nulls: a null html is the empty payload. A null url becomes `unknown:` and the key. A row without a key is always a response.
Rows that repeat a key get a record each, and of the first key all are responses. Empty tables give archives without records.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import batch_of, kept, rows, shared_folder

# Fixed values of the formats.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The HTTP header that holds a record's key.
KEY = "X-Page-Id"
LEAST = 100
#: Bytes of a file before packing.
FILE = 24_000_000


def _time(key: int | None) -> datetime:
    return datetime.fromtimestamp(946_684_800 + (key or 0) % 700_000_000, UTC)


def safe_url(url: str | None, key: int | None) -> str:
    """A url that fits in one field of a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"unknown:{'' if key is None else key}"


# ---- ARC ----


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 archive\n{' '.join(ARC_FIELDS[version])}\n".encode()
    fields = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": "20000101000000", "Content-type": "text/plain", "Archive-length": str(len(body))}
    return " ".join(fields.get(f, "-") for f in ARC_FIELDS[version]).encode() + b"\n" + body


def arc_record(version: int, url: str | None, key: int | None, payload: bytes, name: str = "-") -> bytes:
    head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", *([] if key is None else [f"{KEY}: {key}"])]
    body = "\r\n".join([*head, "", ""]).encode() + payload
    fields = {"URL": safe_url(url, key), "IP-address": "192.0.2.1", "Archive-date": _time(key).strftime("%Y%m%d%H%M%S"), "Content-type": "text/html", "Result-code": "200", "Checksum": hashlib.md5(body).hexdigest(), "Filename": name, "Archive-length": str(len(body))}
    return " ".join(fields.get(f, "-") for f in ARC_FIELDS[version]).encode() + b"\n" + body


class Stream:
    """Reads lines and stretches of a packed file, unpacking as little as needed at a time."""

    def __init__(self, packed: bytes, step: int = 1 << 16):
        self.parts = self._unpack(memoryview(packed), step)
        self.held, self.at = b"", 0

    @staticmethod
    def _unpack(packed, step):
        if bytes(packed[:2]) != b"\x1f\x8b":
            yield from (bytes(packed[k : k + step]) for k in range(0, len(packed), step))
            return
        at = 0
        while at < len(packed):  # members of a file one after the other
            inner = zlib.decompressobj(31)
            while not inner.eof and at < len(packed):
                piece = packed[at : at + step]
                yield inner.decompress(piece)
                at += len(piece) - len(inner.unused_data)

    def _more(self) -> bool:
        part = next(self.parts, None)
        if part is None:
            return False
        self.held, self.at = self.held[self.at :] + part, 0
        return True

    def line(self) -> bytes | None:
        """The next line with its end, or None at the end of the file."""
        seen = self.at
        while (end := self.held.find(b"\n", seen)) < 0:
            rest = len(self.held) - self.at
            if not self._more():
                out, self.held, self.at = self.held[self.at :], b"", 0
                return out or None
            seen = rest
        out, self.at = self.held[self.at : end + 1], end + 1
        return out

    def take(self, n: int) -> bytes:
        parts, got = [], 0
        while got < n:
            if self.at == len(self.held) and not self._more():
                raise ValueError("a record is shorter than its declared length")
            part = self.held[self.at : self.at + n - got]
            parts.append(part)
            got += len(part)
            self.at += len(part)
        return b"".join(parts)


def arc_records(packed: bytes):
    """(header by field name, content) of each record after the version block."""
    stream, fields = Stream(packed), None
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        values = line.rstrip(b"\r\n").decode("utf-8", "replace").split(" ")
        try:
            content = stream.take(int(values[-1]))
        except ValueError as e:
            raise ValueError(f"not an ARC header: {line[:200]!r}") from e
        if fields is None:
            version = int(content.split(maxsplit=1)[0])
            fields = ARC_FIELDS.get(version)
            if not values[0].startswith("filedesc://") or fields is None:
                raise ValueError("an ARC file starts with a version block")
        elif len(values) != len(fields):
            raise ValueError(f"a header of {len(values)} fields where there are {len(fields)}")
        else:
            yield dict(zip(fields, values, strict=True)), content


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its empty line, and payload. What has no header is all payload."""
    if block.startswith(b"HTTP/"):
        end = re.search(rb"\r?\n\r?\n", block)
        if end:
            return block[: end.end()], block[end.end() :]
    return b"", block


def http_field(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*(.*?)\r?$", head)
    return m[1].decode() if m else None


# ---- WARC ----


def record_id(file: str, number: int) -> str:
    """The identifier of the record that stands at this place of the archive it comes from."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{file} {number}'.encode()).digest()[:16], version=5)}>"


def iso_time(arc_date: str) -> str:
    """ARC dates have up to fourteen digits; what is missing is the start of the period."""
    digits = (arc_date + "00000101000000"[len(arc_date) :])[:14]
    return datetime.strptime(digits, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def warc_record(header: dict[str, str], content: bytes, own_id: str, first: int | None = None, first_id: str | None = None) -> bytes:
    """The WARC record of an ARC record; a revisit of the record with key `first` and identifier `first_id` if these are given."""
    head, payload = http_parts(content)
    block, time = (content, iso_time(header["Archive-date"])) if first is None else (head, iso_time(header["Archive-date"]))
    fields = {
        "WARC-Type": "response" if first is None else "revisit",
        "WARC-Record-ID": own_id,
        "WARC-Date": time,
        "WARC-Target-URI": header["URL"],
        "WARC-IP-Address": header["IP-address"],
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "WARC-Payload-Digest": f"sha256:{hashlib.sha256(payload).hexdigest()}",
    }
    if first is not None:
        fields |= {"WARC-Refers-To": first_id, "WARC-Profile": REVISIT, "X-Refers-To-Key": str(first)}
    fields |= {"Content-Type": "application/http;msgtype=response" if head else header["Content-type"], "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block


def warc_records(packed: bytes):
    """(header by field name, block) of each record."""
    stream = Stream(packed)
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:200]!r}")
        header = {}
        while (line := stream.line()) is not None and line.strip():
            name, _, value = line.decode().partition(":")
            header[name] = value.strip()
        yield header, stream.take(int(header["Content-Length"]))


# ---- jobs ----


def _write(files: DataFrame, folder: str) -> None:
    """Writes each value as a file of its own, packed."""
    files.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").option("compression", "gzip").text(folder)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select(F.substring_index("path", "/", -1).alias("file"), "content")


def _some(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/archives/{uuid.uuid4().hex}/{name}"


_VALUE = pa.schema([("value", pa.binary())])


def _bundled(records, separator: bytes, most: int, begin=lambda n: b""):
    """A row for each file: what `begin` says for its number, and records, each followed by the separator."""
    held, size, number = [], 0, 0
    for record in records:
        if held and size + len(record) > most:
            yield batch_of(_VALUE, [b"".join(held)])
            held, size, number = [], 0, number + 1
        if not held:
            held.append(begin(number))
        held += (record, separator)
        size += len(record)
    if held:
        yield batch_of(_VALUE, [b"".join(held)])


def write_arc(pages: DataFrame, folder: str, file_bytes: int = FILE) -> None:
    """Writes a record for each row (page_id, url, html); partitions by turns in version 1 and 2."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"pages-{part:05d}"
        records = (arc_record(version, url, key, (html or "").encode(), name) for key, url, html in rows(batches, "page_id", "url", "html"))
        yield from _bundled(records, b"\n", file_bytes, lambda n: arc_version_block(version, f"{name}-{n:05d}.arc") + b"\n")

    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    _write(plain.mapInArrow(run, "value binary"), folder)


_PARSED = pa.schema([("file", pa.string()), ("number", pa.int64()), ("key", pa.int64()), ("digest", pa.string()), ("n_bytes", pa.int64())])


def _of_arc(packed: bytes):
    """(number, key, payload, header, content) of each record of an ARC file."""
    for number, (header, content) in enumerate(arc_records(packed)):
        head, payload = http_parts(content)
        key = http_field(head, KEY)
        yield number, None if key is None else int(key), payload, header, content


def read_arc(spark: SparkSession, folder: str) -> DataFrame:
    """(file, number in it, key, digest and n_bytes of the payload) of each record."""

    def run(batches):
        for file, packed in rows(batches, "file", "content"):
            out = []
            for number, key, payload, *_ in _of_arc(packed):
                out.append((file, number, key, hashlib.sha256(payload).hexdigest(), len(payload)))
            if out:
                yield batch_of(_PARSED, *zip(*out, strict=True))

    return _files(spark, folder).mapInArrow(run, "file string, number long, key long, digest string, n_bytes long")


def convert(spark: SparkSession, arc_folder: str, warc_folder: str, least: int = LEAST, file_bytes: int = FILE) -> None:
    """Converts a folder of ARC files to one of WARC files."""
    large = kept(read_arc(spark, arc_folder).where((F.col("n_bytes") >= least) & F.col("key").isNotNull()))
    # grouped by more than the later join's key, so that the join gets its own exchange and can split a hot digest
    first = large.groupBy("digest", "n_bytes").agg(F.min(F.struct("key", "file", "number")).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    again = large.join(first, "digest").where("key > first.key").select("file", F.struct("number", "first").alias("one"))
    decided = again.groupBy("file").agg(F.collect_list("one").alias("again"))  # as many as the file has records

    def run(batches):
        def out():
            for file, packed, again in rows(batches, "file", "content", "again"):
                firsts = {x["number"]: x["first"] for x in again or ()}
                for number, _, _, header, content in _of_arc(packed):
                    first = firsts.get(number)
                    yield warc_record(header, content, record_id(file, number), *((first["key"], record_id(first["file"], first["number"])) if first else ()))

        yield from _bundled(out(), b"\r\n\r\n", file_bytes)

    files = _files(spark, arc_folder).join(decided, "file", "left").select("file", "content", "again")
    _write(files.mapInArrow(run, "value binary"), warc_folder)


_BACK = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string())])


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record. Blocks and payloads are checked against the digests in their headers."""

    def run(batches):
        for (packed,) in rows(batches, "content"):
            out = []
            for header, block in warc_records(packed):
                head, payload = http_parts(block)
                digest = header["WARC-Payload-Digest"].removeprefix("sha256:")
                revisit = header["WARC-Type"] == "revisit"
                if hashlib.sha256(block).hexdigest() != header["WARC-Block-Digest"].removeprefix("sha256:") or not revisit and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"digests differ in {header['WARC-Record-ID']}")
                key, first = http_field(head, KEY), header.get("X-Refers-To-Key")
                n = int(http_field(head, "Content-Length")) if revisit else len(payload)
                out.append((None if key is None else int(key), n, digest, header["WARC-Type"], None if first is None else int(first), header["WARC-Record-ID"], header["WARC-Target-URI"], header["WARC-Date"]))
            if out:
                yield batch_of(_BACK, *zip(*out, strict=True))

    return _files(spark, folder).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string, date string")


def archived(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes pages as ARC, converts the archive to WARC, and returns what reading that back gives, a row for each page."""
    spark = pages.sparkSession
    arc, warc = _some(spark, "arc"), _some(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc, least)
    return read_warc(spark, warc)
