"""WARC archives: written by tasks, read back sequentially.

*Writing.* Each task rolls its rows into archives of about ``archive_bytes``,
one gzip member per record, in a folder all executors share. Names are unique
to the attempt and the manifest lists what finished attempts wrote, so files of
lost attempts are never read. Pages with equal payloads are stored once: the
record with the smallest id is the response, the others are revisits that name
it and hold only the HTTP header.

*Reading.* One task streams one archive: the file is read in pieces, a new
``zlib`` decompressor starts at each member, and a record is cut out by its
Content-Length. A payload is held only while its record is being read. Digests
of the block and of the payload are computed anew and compared; ``valid`` says
whether both agree. A truncated archive or broken framing raises.

A null payload is the empty one. A null id is written as absent and reads back
as null; it never is the smallest. Rows that repeat the smallest id are all
responses. A null url is an absent header, and control characters in a url are
percent-encoded. Further columns are ignored. An empty table makes no archive.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from parasol.llm.common import ship_by_value
from parasol.session import materialized, scratch_path

# Fixed values of the format.
VERSION = b"WARC/1.1"
RECORD_ID = "urn:x-page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 32 << 20  # of payload, before compression
READ_TASKS = 20_000  # at most so many; beyond, a task streams several archives one after another
PIECE = 1 << 18
BATCH_BYTES = 8 << 20
UNKNOWN_DATE = "1970-01-01T00:00:00Z"

ship_by_value(__name__)

READ_SCHEMA = ("page_id bigint, url string, record_type string, refers_to bigint, payload binary, "
               "payload_bytes bigint, payload_digest string, valid boolean")


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One uncompressed record. A revisit holds the HTTP header alone, which tells the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{RECORD_ID}{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{_sha(block)}"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        safe = "".join(quote(c) if c < " " or c == "\x7f" else c for c in url)
        head.append(("WARC-Target-URI", safe))
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<{RECORD_ID}{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    lines = b"".join(f"{k}: {v}\r\n".encode("utf-8", "surrogatepass") for k, v in head)
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def plan_records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """Rows to write: id, url, payload, digest and, for revisits, the id of the response.

    Digests are grouped without their payloads; a payload moves only to the task that writes it.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"),
                        payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    shared = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(
        F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    refers = F.when(F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return rows.join(shared.drop("n"), "digest", "left").select("id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str = UNKNOWN_DATE) -> DataFrame:
    """Writes one record per row under ``folder`` and returns the manifest: path, n_records, n_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = _filesystem(folder)
        files.create_dir(top, recursive=True)
        done, out, name, held, n = [], None, "", 0, 0

        def close():
            out.close()
            done.append((f"{folder}/{name}", n, files.get_file_info(f"{top}/{name}").size))

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (batch[k][i].as_py() for k in range(5))
                if out is None:
                    name, held, n = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{top}/{name}", compression=None)
                out.write(gzip.compress(record(page_id, url, payload, digest, refers_to, date), 6, mtime=0))
                held, n = held + len(payload), n + 1
                if held >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "n_records", "n_bytes"), d)) for d in done], pa.schema(
            [("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    planned = plan_records(pages, id_col, url_col, payload_col, min_bytes)
    return materialized(planned.mapInArrow(run, "path string, n_records bigint, n_bytes bigint"), "warc-manifest")


class Members:
    """The gzip members of a stream as one byte stream that knows where each member ends."""

    def __init__(self, stream):
        self.stream, self.ahead, self.inflate, self.buffer, self.ended = stream, b"", None, bytearray(), False

    def next_member(self) -> bool:
        if self.inflate is not None and not self.ended:
            raise ValueError("the record before ends within its gzip member")
        if not self.ahead:
            self.ahead = self.stream.read(PIECE)
        self.inflate, self.buffer, self.ended = zlib.decompressobj(31), bytearray(), False
        return bool(self.ahead)

    def _more(self) -> bool:
        if self.ended:
            return False
        if not self.ahead:
            self.ahead = self.stream.read(PIECE)
            if not self.ahead:
                raise ValueError("the archive ends within a gzip member")
        self.buffer += self.inflate.decompress(self.ahead, PIECE)
        self.ended = self.inflate.eof
        self.ahead = self.inflate.unused_data if self.ended else self.inflate.unconsumed_tail
        return True

    def line(self) -> bytes:
        at = 0
        while (end := self.buffer.find(b"\r\n", at)) < 0:
            at = max(0, len(self.buffer) - 1)
            if not self._more():
                raise ValueError("a header line does not end")
        found = bytes(self.buffer[:end])
        del self.buffer[:end + 2]
        return found

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("a record is shorter than its Content-Length")
        found = bytes(self.buffer[:n])
        del self.buffer[:n]
        return found

    def drain(self) -> bytes:
        while self._more():
            pass
        return bytes(self.buffer)


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (x.decode("utf-8", "surrogatepass").partition(":") for x in lines)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def read_records(stream) -> Iterator[dict]:
    """Every record of one archive, in order."""
    members = Members(stream)

    def header() -> list[bytes]:
        lines = []
        while line := members.line():
            lines.append(line)
        return lines

    def page(value: str | None) -> int | None:
        number = (value or "").strip("<>").removeprefix(RECORD_ID)
        return int(number) if number else None

    while members.next_member():
        first, *lines = header()
        if not first.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        head = _fields(lines)
        block = members.take(int(head["content-length"]))
        if members.drain() != b"\r\n\r\n":
            raise ValueError("a record is longer than its Content-Length")
        http, _, body = block.partition(b"\r\n\r\n")
        length = int(_fields(http.split(b"\r\n")[1:])["content-length"])
        digest = head["warc-payload-digest"].removeprefix("sha256:")
        whole = head["warc-type"] == "revisit" or (len(body) == length and _sha(body) == digest)
        yield {
            "page_id": page(head["warc-record-id"]), "url": head.get("warc-target-uri"),
            "record_type": head["warc-type"], "refers_to": page(head.get("warc-refers-to")),
            "payload": body if head["warc-type"] == "response" else None,
            "payload_bytes": length, "payload_digest": digest,
            "valid": whole and f"sha256:{_sha(block)}" == head["warc-block-digest"],
        }


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives a manifest lists, one task streaming one archive at a time."""
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("valid", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                files, at = _filesystem(path)
                rows, held = [], 0
                with files.open_input_stream(at, compression=None) as stream:
                    for row in read_records(stream):
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        held += 500 + len(row["payload"] or b"")
                        if held >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    # An explicit number: rows this short would else be merged into one task, however large the archives.
    tasks = max(1, min(manifest.count(), READ_TASKS))
    return manifest.select("path").repartition(tasks).mapInArrow(run, READ_SCHEMA)


def round_trip(spark: SparkSession, pages: DataFrame, with_payload: bool = True, **columns) -> DataFrame:
    """Writes the archives of ``pages`` to a new shared folder and reads them back."""
    return read_archives(write_archives(pages, scratch_path(spark, "warc"), **columns), with_payload)
