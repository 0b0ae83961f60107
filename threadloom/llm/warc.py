"""WARC archives: one gzip member per record, written by tasks and read back sequentially.

Tasks write to the folder all executors share, each file under a name of its own attempt; only the files whose
manifest row was committed are read, so that a retried or lost task leaves no record twice. The reader inflates a
stream piece by piece, frames records by Content-Length and verifies each payload digest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import BROADCAST_ROWS, map_rows, work_path, work_table

PIECE = 1 << 18
ROLL_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A payload shared by more pages than SALTS can be joined by as many tasks.
SALTS = 16

RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, verified boolean"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record as a gzip member of its own; revisits hold the HTTP head but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    uri = "".join((url or "about:blank").split())
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def read_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each member of a record-wise compressed archive, in order; memory holds one record.

    A member that is cut off, or whose block is not as long as Content-Length says, raises ValueError.
    """
    rest = b""
    while True:
        rest = rest or stream.read(PIECE)
        if not rest:
            return
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            rest = rest or stream.read(PIECE)
            if not rest:
                raise ValueError("the last member is cut off")
            parts.append(unpacker.decompress(rest))
            rest = unpacker.unused_data
        head, _, body = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        if not lines[0].startswith("WARC/") or body[size:] != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('WARC-Record-ID')} is not framed by its Content-Length")
        yield fields, body[:size]


def parsed(fields: dict[str, str], block: bytes) -> dict:
    """One row of RECORDS: a response's payload is measured and hashed, a revisit's figures are as it states them."""
    number = lambda s: int(s) if (s := s.removeprefix("<urn:page:").rstrip(">")) else None
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    length = int(http.rsplit(b"Content-Length: ", 1)[1])
    revisit = fields["WARC-Type"] == "revisit"
    digest = stated if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if digest != stated or not revisit and len(payload) != length:
        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    refers = fields.get("WARC-Refers-To")
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number(refers) if refers else None,
        "verified": not revisit,
    }


def with_response(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Add payload, digest (hex) and refers_to: the smallest page_id of the same payload, for all other pages.

    Payloads below min_bytes are never shared. A null html is an empty payload; a null page_id is never referred to, and
    rows that repeat the smallest page_id are all responses. Digests alone are shuffled: the repeated ones are
    broadcast when counted to be few, so that pages stay where they are read; beyond that pages are dealt by digest.
    """
    hashed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    seen = hashed.filter(F.length("payload") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = work_table(seen.filter("n > 1 and first is not null").select("digest", "first"), "warc-firsts")
    refers = F.expr("case when page_id is null or page_id <> first then first end").alias("refers_to")
    if firsts.count() <= BROADCAST_ROWS // 2:
        joined = hashed.join(F.broadcast(firsts), "digest", "left")
    else:
        salted = hashed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        joined = salted.join(firsts.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))), ["digest", "salt"], "left")
    return joined.select("page_id", "url", "payload", "digest", refers)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write a record for every page into folder, dated by the time of the call; returns the manifest (path, records) of the committed files."""
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, path, n, size = None, "", 0, 0
        for b in batches:
            for page_id, url, payload, digest, refers in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, n, size = fs.open_output_stream(path, compression=None), 0, 0
                member = record(page_id, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), refers, date)
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= ROLL_BYTES:
                    out.close()
                    out = None
                    yield {"path": [path], "records": [n]}
        if out is not None:
            out.close()
            yield {"path": [path], "records": [n]}

    return work_table(map_rows(with_response(pages, min_bytes), rows, "path string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Rows of RECORDS from the files of a manifest; a file with another number of records than stated raises."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for b in batches:
            for path, n in zip(*(c.to_pylist() for c in b.columns)):
                seen, held = 0, []
                with fs.open_input_stream(path, compression=None) as stream:
                    for fields, block in read_records(stream):
                        held.append(parsed(fields, block))
                        seen += 1
                        if len(held) == 2000:
                            yield {k: [x[k] for x in held] for k in held[0]}
                            held = []
                if seen != n:
                    raise ValueError(f"{path} has {seen} records, not {n}")
                if held:
                    yield {k: [x[k] for x in held] for k in held[0]}

    files = manifest.select("path", "records")
    return map_rows(files.repartition(max(1, min(files.count(), 4096)), "path"), rows, RECORDS)


def verify_revisits(records: DataFrame) -> DataFrame:
    """records with verified also for revisits: whether a response with the page_id they name has their digest and length."""
    own = records.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes", F.lit(True).alias("_held")).distinct()
    found = records.join(own, ["refers_to", "payload_digest", "payload_bytes"], "left")
    return found.select(*[F.coalesce("_held", "verified").alias(c) if c == "verified" else c for c in records.columns])


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages as archives in the shared folder, then read them back."""
    folder = work_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, min_bytes), folder)
