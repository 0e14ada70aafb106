"""WARC archives: one gzip member per record, written once and read back record by record.

Writing: pages are dealt by page_id; each task writes its own files to a shared folder and
returns their names, which are saved by Spark. A file of a failed or repeated attempt is in no
list, so it is never read. Reading: files are dealt to tasks; each is read front to back in
pieces of CHUNK bytes, and only one record is in memory at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from gridsight.functions.scale import saved, shared_folder

CHUNK = 1 << 16
FILE_BYTES = 256 << 20
LEVEL = 6
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"

RECORD = ("record_type string, record_id string, target_uri string, refers_to string, payload_bytes bigint, payload_digest string, "
          "payload binary, file string, offset bigint")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record as a gzip member of its own."""
    lines = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {_clean(value)}\r\n" for name, value in lines) + "\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + _END) + packer.flush()


def _clean(value: str) -> str:
    """A header value stays on its line."""
    return " ".join(value.replace("\0", " ").split("\n")).replace("\r", " ").strip()


def page_record(page: str | None, url: str | None, payload: bytes, first: str | None) -> bytes:
    """The response record of a page or, if another page holds the same payload, its revisit record."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Record-ID", f"<urn:page:{page or ''}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
               ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if url is not None:
        headers.append(("WARC-Target-URI", url))
    if first is None:
        return record("response", headers, head + payload)
    return record("revisit", [*headers, ("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:page:{first}>")], head)


class Damaged(ValueError):
    """An archive that breaks off, or a record whose frame or digest is wrong."""


class Members:
    """The gzip members of a stream, decompressed piece by piece."""

    def __init__(self, stream, chunk: int = CHUNK):
        self.stream, self.chunk, self.rest, self.offset = stream, chunk, b"", 0

    def start(self) -> bool:
        """Begin the next member; False at the end of the file."""
        if not self.rest:
            self.rest = self.stream.read(self.chunk)
        self.inflate = zlib.decompressobj(31)
        self.begin, self.buffer = self.offset, b""
        return bool(self.rest)

    def _more(self) -> bool:
        if self.inflate.eof:
            return False
        if not self.rest:
            self.rest = self.stream.read(self.chunk)
        given = len(self.rest)
        try:
            data = self.inflate.decompress(self.rest, self.chunk)
        except zlib.error as error:
            raise Damaged(f"member at {self.begin}: {error}") from error
        if not data and not given and not self.inflate.eof:
            raise Damaged(f"member at {self.begin} breaks off")
        self.rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        self.offset += given - len(self.rest)
        self.buffer += data
        return True

    def line(self) -> bytes:
        while b"\r\n" not in self.buffer:
            if not self._more():
                raise Damaged(f"record at {self.begin} has no whole header")
        line, self.buffer = self.buffer.split(b"\r\n", 1)
        return line

    def take(self, count: int) -> Iterator[bytes]:
        """Exactly ``count`` bytes, in pieces."""
        while count:
            if not self.buffer and not self._more():
                raise Damaged(f"record at {self.begin} is shorter than its Content-Length")
            part, self.buffer = self.buffer[:count], self.buffer[count:]
            count -= len(part)
            if part:
                yield part

    def end(self) -> None:
        """A record ends with two line ends, and so does its member."""
        while self._more():
            if len(self.buffer) > len(_END):
                break
        if self.buffer != _END:
            raise Damaged(f"record at {self.begin} is longer than its Content-Length")


def records(stream, chunk: int = CHUNK) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """``(offset, headers, block)`` of every record of an archive, in order, digests verified.

    Raises ``Damaged`` where a member breaks off, a record's frame is not its Content-Length, or the
    block digest (for responses the payload digest too) is another. Header names are in lower case.
    """
    members = Members(stream, chunk)
    while members.start():
        version = members.line()
        if not version.startswith(b"WARC/"):
            raise Damaged(f"no record at {members.begin}")
        headers: dict[str, str] = {}
        while line := members.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        if not headers.get("content-length", "").isdigit():
            raise Damaged(f"record at {members.begin} has no Content-Length")
        block, sums = bytearray(), hashlib.sha1()
        for part in members.take(int(headers["content-length"])):
            block += part
            sums.update(part)
        members.end()
        named = headers.get("warc-block-digest")
        if named and named != f"sha1:{base64.b32encode(sums.digest()).decode()}":
            raise Damaged(f"record at {members.begin}: block digest differs")
        yield members.begin, headers, bytes(block)


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", html: str = "html",
          least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per page and return the ``(file, records)`` list of the archives.

    Of equal payloads of at least ``least_bytes`` bytes the one with the smallest key is a response
    and the others revisit it; shorter ones are all responses. The text travels once, dealt by key
    and payload, so equal payloads are spread; who is first is found on digests alone.
    Null html is an empty payload; rows without key are responses unless a keyed row has their payload;
    repeats of the first key with the same payload are responses too. ``folder`` must be reachable
    from all executors; by default it is a new one in the shared folder.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/gridsight/warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").cast("string").alias("url"),
                        F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("html")).withColumn("sum", F.sha1(F.col("html").cast("binary")))
    sums = saved(rows.filter(F.octet_length("html") >= least_bytes).select("key", "sum"))
    first = saved(sums.filter("key is not null").groupBy("sum").agg(F.min("key").alias("first")))
    again = saved(sums.join(first, "sum").filter("key is null or key <> first").select("key", "sum", "first").distinct())
    dealt = rows.join(again, rows["key"].eqNullSafe(again["key"]) & (rows["sum"] == again["sum"]), "left").select(
        rows["key"].cast("string").alias("key"), "url", "html", again["first"].cast("string").alias("first"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root)
        out, count, size, name = None, 0, 0, ""
        done = []
        for batch in batches:
            for page, link, text, earlier in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, count, size = store.open_output_stream(name, compression=None), 0, 0
                    out.write(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
                                                  ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                member = page_record(page, link, text.encode(), earlier)
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= file_bytes:
                    out.close()
                    done.append((name, count))
                    out = None
        if out is not None:
            out.close()
            done.append((name, count))
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64())], ["file", "records"])

    return saved(dealt.mapInArrow(archive, "file string, records bigint")).withColumn("folder", F.lit(folder))


def read(files: DataFrame, payloads: bool = True) -> DataFrame:
    """The page records of listed archives, in order within a file; digests and frames are verified.

    ``payload_bytes`` and ``payload_digest`` are those of the whole payload, for revisits too; the
    payload of a revisit is null. A damaged archive raises an error.
    """
    spark = files.sparkSession
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, _ = _store(folder)
                with store.open_input_stream(name, compression=None) as stream:
                    rows, size = [], 0
                    for offset, headers, block in records(stream):
                        if headers["warc-type"] not in ("response", "revisit"):
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:] if b": " in line)
                        named, whole = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"] == "response"
                        if whole and digest(payload) != named:
                            raise Damaged(f"{name}: payload digest at {offset} differs")
                        rows.append((headers["warc-type"], headers["warc-record-id"], headers.get("warc-target-uri"), headers.get("warc-refers-to"),
                                     int(fields[b"Content-Length"]), named, payload if whole and payloads else None, name, offset))
                        size += len(payload)
                        if size > 4_000_000:
                            yield _rows(rows)
                            rows, size = [], 0
                    yield _rows(rows)

    return files.select("file", "folder").repartition(tasks).mapInArrow(scan, RECORD)


_KINDS = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64()]
_NAMES = ["record_type", "record_id", "target_uri", "refers_to", "payload_bytes", "payload_digest", "payload", "file", "offset"]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], _NAMES)


def page_of(record_id: str):
    """The page a record id names, as text; null for a row without key."""
    return F.nullif(F.regexp_extract(record_id, "^<urn:page:(.*)>$", 1), F.lit(""))
