"""WARC archives: records written by tasks with an index of offsets, and coalesced byte-range reads of selected records."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import materialize, scratch_path

LEAST_BYTES = 1000  # smaller payloads are always stored as responses
GAP, LARGEST_READ = 64 << 10, 8 << 20
PAGE_ID = "urn:page:"
INDEX = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, file string, offset long, length long"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def with_record_types(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """pages as (page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to).

    Of rows with equal payloads of at least least_bytes bytes the one with the largest page_id is
    the response and the others revisit it; all smaller ones are responses. A null html is the empty
    payload. Null page_ids count as smallest; rows that share their group's largest page_id are all
    responses. Digests of groups are aggregated before they are joined to the pages.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    facts = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    groups = facts.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = facts.join(groups, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("keeper")).alias("refers_to"))


def _named(page_id: int | None) -> str:
    return f"<{PAGE_ID}{'none' if page_id is None else page_id}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes | None, n_bytes: int, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member of its own; a revisit has the HTTP head only."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode() + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_named(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20%]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_named(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse_record(data: bytes) -> dict:
    """The record that a gzip member holds; a response's payload must have the digest that its head states."""
    head, _, rest = zlib.decompress(data, 31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n_bytes = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    number = lambda x: None if x is None or x.endswith(":none>") else int(x[len(PAGE_ID) + 1 : -1])
    kind = fields["WARC-Type"]
    if kind == "response":
        n_bytes = len(payload)
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"record {fields['WARC-Record-ID']}: payload and digest differ")
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": url and re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url), "record_type": kind, "payload_bytes": n_bytes,
        "payload_digest": digest, "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload if kind == "response" else None,
    }


def _opened(uri: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(uri)


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write the rows of with_record_types() as .warc.gz files below folder; returns their index.

    Each task attempt writes a file of its own and only the attempts that succeed are in the index,
    which is stored once, so lost or repeated tasks neither lose nor double records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _opened(folder)
        out, at, name = None, 0, f"{folder}/{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            rows, places = batch.to_pylist(), []
            if rows and out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name.rpartition('/')[2]}", compression=None)
            for r in rows:
                data = record_bytes(r["page_id"], r["url"], r["payload"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
                out.write(data)
                places.append((at, len(data)))
                at += len(data)
            kept = [batch.column(c) for c in ("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to")]
            kept += [pa.array([name] * len(rows), pa.string()), pa.array([p[0] for p in places], pa.int64()), pa.array([p[1] for p in places], pa.int64())]
            yield pa.RecordBatch.from_arrays(kept, names=[x.split()[0] for x in INDEX.split(", ")])
        if out is not None:
            out.close()

    return materialize(records.mapInArrow(run, INDEX), "warc-index")


def read_warc(index: DataFrame, gap: int = GAP, largest: int = LARGEST_READ) -> DataFrame:
    """The records that the index rows (file, offset, length) point to, with payloads.

    Rows are dealt by ranges of (file, offset), so a large file is read by several tasks; within a
    task neighbouring records at most gap bytes apart are fetched with one read of at most
    `largest` bytes (a longer record has its own).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

        def fetched(spans: list[tuple[str, int, int]]) -> pa.RecordBatch:
            file, start, end = spans[0][0], spans[0][1], max(o + n for _, o, n in spans)
            fs, path = _opened(file)
            with fs.open_input_file(path) as source:
                data = source.read_at(end - start, start)
            return pa.RecordBatch.from_pylist([parse_record(data[o - start : o - start + n]) for _, o, n in spans], schema)

        held: list[tuple[str, int, int]] = []
        for batch in batches:
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if held and (file != held[0][0] or offset > held[-1][1] + held[-1][2] + gap or offset + length - held[0][1] > largest):
                    yield fetched(held)
                    held = []
                held.append((file, offset, length))
        if held:
            yield fetched(held)

    dealt = index.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, RECORD)


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages to WARC files in the shared folder (or `folder`) and return the index.

    An empty table writes no file and gives an empty index; columns other than page_id, url and
    html are not stored.
    """
    return write_warc(with_record_types(pages), folder or scratch_path(pages.sparkSession, "warc"))
