"""WARC archives: writing with revisit records, reading back as a chunked record table.

Payloads travel as rows (record, chunk number, bytes) of at most ``CHUNK_BYTES``, into and
out of the archives; a writing or reading task holds one chunk, never a whole record. Rows
of a record carry the length and SHA-1 up to their end, so the last row has the digest of the
whole payload.

Every record is its own gzip member. A response holds HTTP headers and payload; a revisit
holds the HTTP headers (with the Content-Length of the full payload) and names the record it
refers to. Tasks write below the folder named by ``spark.checkpoint.dir`` through pyarrow's
file systems, each attempt under a new name; the manifest lists the files of tasks that
ended well, so repeated or lost attempts leave nothing that is read.

Defined cases: null payload is empty. Payloads shorter than ``least_bytes`` are never
revisits. A null page_id is written as an empty identifier and read back as null; with an
equal payload of a known page it is a revisit. Repeated rows are records each. Line breaks
and other control characters in URLs are percent-encoded; a null URL has no header line.
Extra columns are not read. No pages: no archives, no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nocturne.llm.tables import counted_broadcast, stored
from nocturne.runtime import scratch_path

CHUNK_BYTES = 1 << 20
#: A task opens a new archive beyond this many bytes.
ARCHIVE_BYTES = 256 << 20
LEAST_BYTES = 1000

_READ = 1 << 18
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def with_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``page_id, url, payload, n_bytes, digest, record_type, refers_to`` of ``pages(page_id, url, html)``.

    Of equal payloads of ``least_bytes`` or more, the largest page_id is the response.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    digested = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("n_bytes"), F.sha1(payload).alias("digest"))
    groups = digested.filter(F.col("n_bytes") >= least_bytes).groupBy("digest", "n_bytes")
    repeated = stored(groups.agg(F.max("page_id").alias("first_id"), F.count("*").alias("held")).filter("held > 1 and first_id is not null"), "repeated")
    joined = digested.join(counted_broadcast(repeated.drop("held")), ["digest", "n_bytes"], "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "page_id",
        "url",
        "payload",
        "n_bytes",
        "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def chunked(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Payloads as rows: ``chunk_no, chunk`` in place of ``payload``; a revisit has one empty chunk."""
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    count = F.greatest(F.lit(1), F.ceil(F.octet_length(body) / chunk_bytes)).cast("int")
    cut = records.withColumn("body", body).select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_no"))
    chunk = F.substring("body", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))
    return cut.select("page_id", "url", "n_bytes", "digest", "record_type", "refers_to", "chunk_no", chunk.alias("chunk"))


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)


def _name(page_id: object) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _head(page_id, url, n_bytes, digest, kind, refers_to, day: str) -> bytes:
    http = _HTTP.format(n_bytes)
    length = len(http) + (n_bytes if kind == "response" else 0)
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {day}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


def write_archives(records: DataFrame, folder: str | None = None, day: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write chunk rows of ``with_revisits`` records; the manifest ``path, n_records, n_bytes``."""
    folder = folder or scratch_path(records.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pa.fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        out, path, n_records, packed = None, None, 0, None

        def manifest() -> pa.RecordBatch:
            out.write(packed.compress(b"\r\n\r\n") + packed.flush())
            size = out.tell()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n_records], pa.int64()), pa.array([size], pa.int64())], names=["path", "n_records", "n_bytes"])

        for batch in batches:
            *heads, numbers, chunks = batch.columns
            for k, number in enumerate(numbers.to_pylist()):
                if number == 0:
                    if out is not None and out.tell() > ARCHIVE_BYTES:
                        yield manifest()
                        out, n_records, packed = None, 0, None
                    if packed is not None:
                        out.write(packed.compress(b"\r\n\r\n") + packed.flush())
                    if out is None:
                        path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                        out = system.open_output_stream(f"{base}/{path.rpartition('/')[2]}", compression=None)
                    packed = zlib.compressobj(4, zlib.DEFLATED, 31)
                    out.write(packed.compress(_head(*(h[k].as_py() for h in heads), day)))
                    n_records += 1
                out.write(packed.compress(chunks[k].as_buffer()))
        if out is not None:
            yield manifest()

    return stored(chunked(records).mapInArrow(write, "path string, n_records long, n_bytes long"), "manifest")


class _Stream:
    """Bytes of an archive's members one after the other, decompressed a block at a time."""

    def __init__(self, source):
        self.source, self.member, self.held, self.raw = source, zlib.decompressobj(31), b"", b""

    def _more(self) -> bool:
        if self.member.eof:
            self.raw, self.member = self.member.unused_data, zlib.decompressobj(31)
        if not self.raw:
            self.raw = self.source.read(_READ)
            if not self.raw:
                return False
        self.held += self.member.decompress(self.raw, CHUNK_BYTES)
        self.raw = b"" if self.member.eof else self.member.unconsumed_tail
        return True

    def ended(self) -> bool:
        while not self.held and self._more():
            pass
        return not self.held

    def block(self, most: int) -> bytes:
        """Up to ``most`` bytes, at least one unless the archive has ended."""
        self.ended()
        out, self.held = self.held[:most], self.held[most:]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        if len(self.held) < n:
            raise ValueError("archive ends inside a record")
        return self.block(n) if n else b""

    def lines(self) -> list[str]:
        """Header lines up to an empty line."""
        while b"\r\n\r\n" not in self.held and self._more():
            pass
        head, found, self.held = self.held.partition(b"\r\n\r\n")
        if not found:
            raise ValueError("archive ends inside a header")
        return head.decode().split("\r\n")


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}


_ROW = "page_id long, record_type string, refers_to long, chunk_no int, chunk binary, bytes_so_far long, sha1_so_far string, is_last boolean, full_bytes long, full_digest string"


def read_archives(manifest: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives in ``manifest(path)``.

    ``bytes_so_far`` and ``sha1_so_far`` run over the payload as it is read; ``full_bytes`` and
    ``full_digest`` are what the record's headers say of the full payload.
    """

    def number(text: str | None) -> int | None:
        digits = (text or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def records(stream: _Stream) -> Iterator[tuple]:
        while not stream.ended():
            head = _fields(stream.lines())
            left = int(head["content-length"])
            before = stream.lines()
            left -= sum(len(x.encode()) + 2 for x in before) + 2
            full = int(_fields(before)["content-length"])
            fixed = (number(head["warc-record-id"]), head["warc-type"], number(head.get("warc-refers-to")))
            said = (full, head["warc-payload-digest"].removeprefix("sha1:"))
            digest, seen, chunk_no = hashlib.sha1(), 0, 0
            while True:
                part = stream.block(min(left, CHUNK_BYTES)) if left else b""
                if left and not part:
                    raise ValueError("archive ends inside a payload")
                digest.update(part)
                seen, left = seen + len(part), left - len(part)
                yield (*fixed, chunk_no, part if with_data else None, seen, digest.hexdigest(), not left, *said)
                chunk_no += 1
                if not left:
                    break
            stream.exactly(4)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string()]
        names = [x.split()[0] for x in _ROW.split(", ")]

        def packed(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = pa.fs.FileSystem.from_uri(uri)
                rows, size = [], 0
                with system.open_input_stream(path, compression=None) as source:
                    for row in records(_Stream(source)):
                        rows.append(row)
                        size += len(row[4] or b"") + 200
                        if size > CHUNK_BYTES:
                            yield packed(rows)
                            rows, size = [], 0
                if rows:
                    yield packed(rows)

    parts = max(1, manifest.count())
    return manifest.select("path").repartition(parts).mapInArrow(read, _ROW)


def payloads(chunks: DataFrame) -> DataFrame:
    """One row a record: ``page_id, payload_bytes, payload_digest, record_type, refers_to, intact``.

    Length and digest of a response are those of the bytes read; a revisit has those of the
    full payload from its headers.
    """
    revisit = F.col("record_type") == "revisit"
    return chunks.filter("is_last").select(
        "page_id",
        F.when(revisit, F.col("full_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, F.col("full_digest")).otherwise(F.col("sha1_so_far")).alias("payload_digest"),
        "record_type",
        "refers_to",
        (revisit | ((F.col("full_bytes") == F.col("bytes_so_far")) & (F.col("full_digest") == F.col("sha1_so_far")))).alias("intact"),
    )
