"""WARC archives: a writer with a gzip member a record, and a sequential reader.

An archive is a table of segments in the shared folder, each the bytes of some whole members: put together in order
they are one .warc.gz file, and each segment is one as well; export writes them as such files. The reader takes archives
of other writers too: records of any type and id, with or without HTTP heads and digests (SHA-1 or SHA-256).
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wegloom.llm import common

LEAST = 100  # bytes of payload from which on equal payloads are revisits
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:page:"
PAGE_ID = re.compile(f"<?{PAGE}(-?[0-9]+)>?")
SEGMENT = 4 << 20


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = "1970-01-01T00:00:00Z", level: int = 1) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    page_id = "none" if page_id is None else page_id
    uri = (url or f"{PAGE}{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{PAGE}{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{PAGE}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def members(chunks: Iterable[bytes], most: int = 1 << 20) -> Iterator[bytes]:
    """The contents of the gzip members, one after another; a member cut short is an error."""
    z, out, begun = zlib.decompressobj(31), [], False
    for data in chunks:
        while data:
            begun = True
            out.append(z.decompress(data, most))
            if z.eof:
                yield b"".join(out)
                data, z, out, begun = z.unused_data, zlib.decompressobj(31), [], False
            else:
                data = z.unconsumed_tail
    if begun:
        raise ValueError("the last gzip member is cut short")


def head_of(data: bytes, at: int = 0) -> tuple[str, dict[str, str], int]:
    """First line, fields by lower-case name, and where the block begins."""
    end = data.index(b"\r\n\r\n", at)
    first, *rest = data[at:end].decode("utf-8", "replace").split("\r\n")
    fields = {}
    for line in rest:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return first, fields, end + 4


def digest_ok(data: bytes, stated: str | None) -> bool:
    """Whether a labelled digest (hexadecimal or base 32) is that of data; unknown algorithms and no digest pass."""
    name, _, value = (stated or "").partition(":")
    kind = {"sha1": hashlib.sha1, "sha256": hashlib.sha256, "md5": hashlib.md5}.get(name.lower().replace("-", ""))
    if kind is None:
        return True
    own = kind(data)
    return value.lower() == own.hexdigest() or value.upper().rstrip("=") == base64.b32encode(own.digest()).decode().rstrip("=")


def parse(data: bytes) -> dict:
    """One record: framed by its content length, its digests verified.

    page_id and refers_to are the numbers of this writer's URNs, null for other ids; payload is what follows the HTTP
    head of a response or request, the block for records without one, null for a revisit.
    """
    version, fields, start = head_of(data)
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    size = int(fields["content-length"])
    block = data[start : start + size]
    if len(block) != size or data[start + size :] != b"\r\n\r\n":
        raise ValueError("the block doesn't have the length that the record gives")
    if not digest_ok(block, fields.get("warc-block-digest")):
        raise ValueError("the block isn't that of the record's digest")
    kind, stated, length = fields["warc-type"], fields.get("warc-payload-digest"), None
    payload = block
    if fields.get("content-type", "").startswith("application/http") and b"\r\n\r\n" in block:
        _, http, body = head_of(block)
        payload = block[body:]
        length = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
    if kind != "revisit":
        if length is not None and kind == "response" and len(payload) != length and "warc-truncated" not in fields:
            raise ValueError("the payload doesn't have the length that its head gives")
        if not digest_ok(payload, stated):
            raise ValueError("the payload isn't that of the record's digest")
        length = len(payload)
    if stated and stated.lower().startswith("sha256:"):
        digest = stated[7:].lower()
    else:
        digest = stated or (hashlib.sha256(payload).hexdigest() if kind != "revisit" else None)
    own = lambda name: int(m[1]) if (m := PAGE_ID.fullmatch(fields.get(name, ""))) else None
    return {"page_id": own("warc-record-id"), "url": fields.get("warc-target-uri"), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": own("warc-refers-to"), "record_id": fields.get("warc-record-id"), "payload": payload if kind != "revisit" else None}


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null: empty), digest, refers_to: of equal payloads of LEAST bytes on, the smallest page_id's
    is kept and the others refer to it."""
    p = pages.select("page_id", "url", common.empty_if_null("html").alias("html"))
    p = p.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    keys = p.select("page_id", "digest", F.octet_length("html").alias("size"))
    first = keys.where(F.col("size") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = keys.where(F.col("size") >= LEAST).join(first, "digest").where("page_id > first").groupBy("page_id", "digest").agg(F.min("first").alias("refers_to"))
    return p.join(later, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")


def write(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write a record for each page and return the table of segments (archive, n_records, data)."""

    def run(batches):
        for batch in common.slices(batches, "html", SEGMENT):
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")))
            out = [record(i, u, h.encode(), d, r) for i, u, h, d, r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([len(out)], pa.int64()), pa.array([b"".join(out)], pa.binary())], ["n_records", "data"])

    return common.materialize(revisits(pages).mapInArrow(run, "n_records bigint, data binary"), "warc", path)


FIELDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string"


def read(segments: DataFrame, payload: bool = False, column: str = "data", chunk: int = 1 << 16) -> DataFrame:
    """A row for each record of the archives in `column`, read in sequence in chunks."""
    kind = FIELDS + (", payload binary" if payload else "")
    names = [x.split()[0] for x in kind.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: len(names)]

    def run(batches):
        for batch in batches:
            for data in batch.column(column):
                whole = memoryview(data.as_buffer() or b"")
                found, held = [], 0
                for member in members(bytes(whole[i : i + chunk]) for i in range(0, len(whole), chunk)):
                    found.append(parse(member))
                    held += len(member) if payload else 200
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in zip(names, types)], names)
                        found, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in zip(names, types)], names)

    return segments.select(column).mapInArrow(run, kind)


def read_files(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Records of .warc.gz files at path, a file a task; Spark reads a file whole, so one holds 2 GB at most."""
    return read(spark.read.format("binaryFile").load(path), payload, "content")


def export(segments: DataFrame, folder: str) -> DataFrame:
    """Write each segment as a .warc.gz file in a folder that all executors have mounted; returns file, n_records.

    A file is named by its bytes and put in place at once, so a task that runs again writes the same file.
    """

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            names = []
            for data in batch.column("data").to_pylist():
                name = f"{folder}/{hashlib.sha256(data).hexdigest()[:24]}.warc.gz"
                own = f"{name}.{os.getpid()}"
                with open(own, "wb") as f:
                    f.write(data)
                os.replace(own, name)
                names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), batch.column("n_records")], ["file", "n_records"])

    return segments.select("n_records", "data").mapInArrow(run, "file string, n_records bigint")


def unmet(records: DataFrame) -> DataFrame:
    """refers_to, payload_digest of revisits without a response of that page and digest."""
    later = records.where("record_type = 'revisit'").select("refers_to", "payload_digest").distinct()
    first = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest").distinct()
    return later.join(first, ["refers_to", "payload_digest"], "left_anti")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages (page_id, url, html) as records and read them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to.

    A null html is an empty payload, a null url becomes a URN of the page_id, payloads below LEAST bytes are never
    revisits, an empty table gives no rows; other columns are not read. Rows of a repeated page_id are judged each by
    its own payload; with the same payload all rows of the smallest page_id are responses. A row without page_id is a response of its own (its record has
    the id urn:page:none) and no other row refers to it. A revisit whose response isn't there is an error.
    """
    records = common.materialize(read(write(pages)).drop("url", "record_id"), "records")
    if bad := unmet(records).take(1):
        raise ValueError(f"a revisit refers to page {bad[0]['refers_to']}, which has no such response")
    return records
