"""Legacy archives (ARC 1 and 2) to WARC.

An ARC file is a version block followed by records; each record is one header
line, whose fields depend on the version and whose last field declares the
length of what follows.  The converter parses those, and makes up what WARC
wants and ARC lacks: record identifiers, ISO timestamps, types and digests.
Archives are written and read with Spark, one file of bounded size per task.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestlake.llm.joins import null_safe
from contestlake.session import run_dir

# The header lines that the two ARC versions declare.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
#: Payloads shorter than this are never replaced by a revisit.
REVISIT_FROM = 0
EPOCH = "20200101000000"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122: names that are URLs


def payload_digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def http_message(page_id: int | None, payload: bytes) -> bytes:
    """The payload as an HTTP response; the page's number is one of its headers."""
    number = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n%s" % (number, len(payload), payload)


def split_http(message: bytes) -> tuple[int | None, bytes]:
    """(page number, payload) of what ``http_message`` wrote."""
    head, _, payload = message.partition(b"\r\n\r\n")
    number = re.search(rb"\r\nX-Page-Id: (-?\d+)", head)
    return (int(number[1]) if number else None), payload


def arc_url(url: str | None) -> str:
    """A url as one field of a header line: white space and controls are percent-encoded; nothing at all is ``-``."""
    return re.sub(r"[\x00-\x20\x7f]|\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "-"


def arc_record(version: int, url: str | None, message: bytes, date: str = EPOCH) -> bytes:
    """Header line and body of one record, and the line feed that closes it."""
    values = {"URL": arc_url(url), "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html",
              "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": "-", "Archive-length": str(len(message))}
    return " ".join(values[f] for f in ARC_FIELDS[version]).encode() + b"\n" + message + b"\n"


def arc_opening(version: int) -> bytes:
    """The version block: file name, version, and the names of the header fields."""
    body = f"{version} 0 converter\n{' '.join(ARC_FIELDS[version])}\n".encode()
    head = {1: "filedesc://pages.arc 0.0.0.0 {d} text/plain {n}\n", 2: "filedesc://pages.arc 0.0.0.0 {d} text/plain 200 - - 0 pages.arc {n}\n"}
    return head[version].format(d=EPOCH, n=len(body)).encode() + body + b"\n"


class Stream:
    """Reads lines and counted bytes from chunks; holds no more than what was asked for and one chunk."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, bytearray()

    def _more(self) -> bool:
        chunk = next(self.chunks, None)
        if chunk is None:
            return False
        self.held += chunk
        return True

    def line(self) -> bytes | None:
        seen = 0
        while (at := self.held.find(b"\n", seen)) < 0:
            seen = len(self.held)
            if not self._more():
                out, self.held = bytes(self.held), bytearray()
                return out or None
        out = bytes(self.held[:at])
        del self.held[: at + 1]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        if len(self.held) < n:
            raise ValueError("the archive ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def inflated(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """Pieces of a gzip file with any number of members; of a plain file as it is."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:
        member = zlib.decompressobj(31)
        data = content
        while data and not member.eof:
            out = member.decompress(data, step)
            data = member.unconsumed_tail
            if out:
                yield out
        content = member.unused_data


def read_arc(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, body) of each record behind the version block, by the fields that block declares.

    Empty lines between records are passed over.  A header line with another
    number of fields than declared, or a length that is no number, is an
    error: the rest of the file could not be told apart.
    """
    stream = Stream(chunks)
    fields: list[str] = []
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        parts = line.decode("utf-8").split(" ")
        if parts[0].startswith("filedesc://"):
            body = stream.take(int(parts[-1])).decode("utf-8").split("\n")
            version = int(body[0].split(" ")[0])
            fields = body[1].split(" ") if len(body) > 1 and body[1] else ARC_FIELDS[version]
            continue
        if len(parts) != len(fields):
            raise ValueError(f"{len(parts)} fields where {len(fields)} are declared")
        header = dict(zip(fields, parts))
        yield header, stream.take(int(header["Archive-length"]))


def warc_date(date: str) -> str:
    """14 digits (12 or 8 in old files) as an ISO timestamp."""
    d = (date + "000000")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*parts: object) -> str:
    """The same parts give the same identifier, so a task that runs again writes the same archive."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, ' '.join(map(str, parts)))}>"


def warc_record(url: str, date: str, page_id: int | None, digest: str, payload: bytes, refers_to: int | None) -> bytes:
    """A response with the full message, or a revisit with the message's head alone."""
    message = http_message(page_id, payload)
    first = refers_to is None
    body = message if first else message[: len(message) - len(payload)]
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {warc_date(date)}",
        *([f"WARC-Target-URI: {url}"] if url != "-" else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{payload_digest(body)}",
        f"X-Payload-Length: {len(payload)}",
        *([] if first else [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}",
                            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def read_warc(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record."""
    stream = Stream(chunks)
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no record starts here")
        header = {}
        while (line := stream.line()) not in (b"\r", None):
            name, _, value = line.decode("utf-8").rstrip("\r").partition(": ")
            header[name] = value
        yield header, stream.take(int(header["Content-Length"]))


def write_arc(pages: DataFrame, path: str, version: int = 1) -> None:
    """ARC files of (page_id, url, html), where a null html is empty; each record follows its version block.

    Every record carries the version block in front of it, which readers of
    joined archives accept, so that any row may come first in its file.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opening = arc_opening(version)
        for b in batches:
            out = []
            for page, url, html in zip(*(b.column(i).to_pylist() for i in range(3))):
                record = opening + arc_record(version, url, http_message(page, (html or "").encode()))
                out.append(record[:-1].decode())
            yield pa.record_batch([pa.array(out, pa.string())], names=["value"])

    pages.select("page_id", "url", "html").mapInArrow(rows, "value string").write.option("compression", "gzip").text(path)


ARC_ROWS = "page_id long, url string, date string, payload_bytes long, payload_digest string, payload binary"


def convert_arc(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of ARC files (the rows of a ``binaryFile`` read) as rows."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("payload", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                out, size = [], 0
                for header, message in read_arc(inflated(content.as_py())):
                    page, payload = split_http(message)
                    out.append((page, header["URL"], header["Archive-date"], len(payload), payload_digest(payload), payload if with_payload else None))
                    size += len(payload)
                    if size > 1 << 22 or len(out) == 10_000:
                        yield _arrow(out, schema)
                        out, size = [], 0
                yield _arrow(out, schema)

    return files.select("content").mapInArrow(rows, ARC_ROWS)


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in schema]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files, one per partition, of rows with page_id, url, date, payload, payload_digest and refers_to.

    The text writer ends each row with the line feed that the row leaves out,
    so a file is the plain run of its records, byte for byte.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page, url, date, payload, digest, refers in zip(*(b.column(i).to_pylist() for i in range(6))):
                out.append(warc_record(url, date, page, digest, payload, refers)[:-1])
            data = pa.array(out, pa.binary()).buffers()
            yield pa.record_batch([pa.StringArray.from_buffers(len(out), data[1], data[2])], names=["value"])

    chosen = records.select("page_id", "url", "date", "payload", "payload_digest", "refers_to")
    chosen.mapInArrow(rows, "value string").write.option("compression", "gzip").text(path)


def read_archives(files: DataFrame) -> DataFrame:
    """Records of WARC files as rows; digests of responses are taken from what was read, not from the header."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("warc_date", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                out = []
                for header, block in read_warc(inflated(content.as_py())):
                    page, payload = split_http(block)
                    full = header["WARC-Type"] == "response"
                    refers = header.get("X-Refers-To-Page")
                    out.append((page, len(payload) if full else int(header["X-Payload-Length"]),
                                payload_digest(payload) if full else header["WARC-Payload-Digest"].removeprefix("sha1:"),
                                header["WARC-Type"], None if refers is None else int(refers), header["WARC-Record-ID"], header["WARC-Date"]))
                yield _arrow(out, schema)

    return files.select("content").mapInArrow(
        rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string"
    )


def files_in(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def with_revisits(records: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Add ``refers_to``: the smallest page_id with the same payload, for all but the records of that page.

    Rows without a page_id are never referred to.  Only digests and numbers are
    grouped; payloads are not moved for it.
    """
    key = ["payload_digest", "payload_bytes"]
    first = records.where(F.col("payload_bytes") >= revisit_from).groupBy(*key).agg(F.min("page_id").alias("first_page"))
    first = first.where("first_page is not null")
    joined = null_safe(records, first, key)
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first_page")), None).otherwise(F.col("first_page"))
    return joined.withColumn("refers_to", refers.cast("long")).drop("first_page")


def archive_pages(pages: DataFrame, version: int = 2) -> str:
    """Write pages as ARC, convert them, and write the WARC archives; returns their folder.

    A null html is an empty payload; repeated rows give repeated records; a
    null url is left out of the record; an empty table gives an empty folder.
    """
    spark = pages.sparkSession
    folder = run_dir(spark, "warc")
    write_arc(pages, f"{folder}/arc", version)
    arc = files_in(spark, f"{folder}/arc")
    marked = with_revisits(convert_arc(arc, with_payload=False).drop("payload")).where("refers_to is not null")
    marked = marked.select("page_id", "payload_digest", "refers_to").distinct()
    write_warc(null_safe(convert_arc(arc), marked, ["page_id", "payload_digest"]), f"{folder}/warc")
    return f"{folder}/warc"
