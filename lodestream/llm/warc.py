"""WARC (operator 4): archives of one gzip member per record, written by tasks and read back sequentially.

Writing. The payload of a page is its html in UTF-8 (null: empty). Records whose
payload of at least ``least`` bytes occurs before are revisits of the record with
the largest page id; which one that is follows from narrow rows (digest, length,
id). The digests that occur twice are broadcast to the payloads while their counted
number allows it; beyond that each payload is shuffled once. Each task writes archives of about ``ROLL`` bytes
under a name of its own and reports them in a manifest, which is written as a
table; files of attempts that failed are in no manifest and are never read.
Files go through Arrow's file systems, so any store that both Spark and Arrow
know will do.

Reading. A task opens an archive as a stream, feeds it to an incremental zlib
decompressor (at each member's end a new one starts with what is left), reads
headers up to the blank line and then as many bytes as ``Content-Length`` says,
and verifies block and payload digests. Memory is bounded by one record.

Repeated rows are records of their own: all that carry the largest id of a
payload are responses. Rows with a null page id are kept with a null id; they
are revisits of the largest id if there is one. A page id stands in the record
id, line breaks of a url are percent-encoded, a null url is left out.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.store import BROADCAST_KEYS, bounded_batches, materialize, new_path

#: Bytes after which a task begins its next archive, and bytes read at once.
ROLL, CHUNK = 64 << 20, 1 << 16
#: The date of all records: archives of equal rows are equal.
DATE = "2024-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit keeps the response's head, which tells the payload's length, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def plan(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages(page_id, url, html)`` with the digest, the length and ``refers_to`` (null for responses)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    firsts = materialize(
        rows.where(F.col("size") >= least).groupBy("sha", "size").agg(F.max("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1"), "warc-firsts"
    ).select("sha", "size", "first_id")
    firsts = F.broadcast(firsts) if firsts.count() <= BROADCAST_KEYS // 8 else firsts  # about 100 bytes a row
    return rows.join(firsts, ["sha", "size"], "left").select(
        "page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to")
    )


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write all pages below ``folder``; returns the manifest (path, records, bytes) as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        done, out, name, records, size = [], None, "", 0, 0
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")], strict=True):
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                data = record(*row, row[3] is not None)
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= ROLL:
                    out.close()
                    done.append((name, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, records, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{d[0]}" for d in done]), *[pa.array([d[k] for d in done], pa.int64()) for k in (1, 2)]], ["path", "records", "bytes"])

    bounded_batches(pages.sparkSession)
    return materialize(plan(pages, least).mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


class Members:
    """Bytes of a stream of gzip members, decompressed step by step."""

    def __init__(self, stream) -> None:
        self.stream, self.held, self.raw, self.zip = stream, bytearray(), b"", None

    def _more(self) -> bool:
        if not self.raw:
            self.raw = bytes(self.stream.read(CHUNK))
            if not self.raw:
                if self.zip is not None:
                    raise ValueError("the archive ends inside a member")
                return False
        if self.zip is None:
            self.zip = zlib.decompressobj(31)
        self.held += self.zip.decompress(self.raw, 4 * CHUNK)
        self.raw = self.zip.unconsumed_tail or self.zip.unused_data
        if self.zip.eof:
            self.zip = None
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end of the stream."""
        seen = 0
        while (at := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if not self._more():
                if self.held:
                    raise ValueError("the archive ends inside a header")
                return None
        out = bytes(self.held[: at + len(mark)])
        del self.held[: at + len(mark)]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("the archive ends inside a block")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:] if line)}


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def records(stream) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(header fields, HTTP head, payload) of each record; digests that do not hold raise."""
    members = Members(stream)
    while (head := members.until(b"\r\n\r\n")) is not None:
        if not head.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        fields = _fields(head)
        block = members.exactly(int(fields["content-length"]))
        if members.exactly(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        if "sha1:" + digest(block) != fields.get("warc-block-digest", "sha1:" + digest(block)):
            raise ValueError(f"block digest of {fields.get('warc-record-id')} does not hold")
        http, _, payload = block.partition(b"\r\n\r\n")
        if fields["warc-type"] == "response" and fields.get("warc-payload-digest") not in (None, "sha1:" + digest(payload)):
            raise ValueError(f"payload digest of {fields.get('warc-record-id')} does not hold")
        yield fields, http, payload


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """``manifest(path, ...)`` -> one row per record: (page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, at = _open(path)
                rows, held = [], 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for fields, http, payload in records(stream):
                        revisit = fields["warc-type"] == "revisit"
                        row = (_page(fields.get("warc-record-id")), fields.get("warc-target-uri"), int(_fields(http)["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"], _page(fields.get("warc-refers-to")))
                        rows.append(row + ((None if revisit else payload,) if payloads else ()))
                        held += len(payload) if payloads else 0
                        if len(rows) >= 5000 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    # As many partitions as archives: a count of its own keeps Spark from joining a few small rows into one task.
    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(run, kinds)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back: the digest columns of every record."""
    manifest = write_archives(pages, new_path(pages.sparkSession, "warc"), least)
    return read_archives(manifest).drop("url")
