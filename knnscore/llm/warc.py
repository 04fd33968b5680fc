"""WARC archives: writing records with revisit de-duplication, and a sequential reader.

Writing: one gzip member per record. Records are dealt by page id; each task writes archives of a bounded size
under names of its own attempt, and tells their paths as its rows. These rows, written as a table, are the
manifest: it holds the archives of the attempts that Spark counts, so a repeated or speculative task, or one that
died, adds no record. Reading: each archive of a manifest is opened in a task and inflated as it is read, chunk by
chunk and member by member, framed by Content-Length; its digests are verified.

Defined results: null html is an empty payload; a null page id is kept; repeated rows that tie for the
smallest page id of a payload are all responses; an empty table gives no archive and no row; a very long page is
one record, held whole by a task; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import new_path, stored

ARCHIVE_BYTES, READERS = 16 << 20, 20_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "uri string, n_records long, n_bytes long"
RECORD = "page_id long, record_type string, refers_to long, target_uri string, payload_bytes long, payload_digest string, payload binary, digest_ok boolean"


def digest32(data: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to (the response's page id for revisits, else null).

    Only (digest, page id) pairs are shuffled to find revisits, pre-aggregated by digest; payloads move once, by page id.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    records = pages.select("page_id", "url", payload.alias("payload"))
    ids = records.where(F.length("payload") >= least_bytes).select("page_id", F.unhex(F.sha1("payload")).alias("sha"))
    firsts = ids.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = stored(firsts.select("sha", "first"), "payloads")  # a join of two scans: adaptive execution splits a very common payload
    again = ids.join(firsts, "sha").where("NOT page_id <=> first").select(F.col("page_id").alias("again"), F.col("sha").alias("seen"), F.col("first").alias("refers_to")).distinct()
    joined = records.withColumn("sha", F.unhex(F.sha1("payload"))).join(
        again, F.expr("page_id <=> again AND sha = seen"), "left"
    )
    return joined.select("page_id", "url", "payload", "refers_to")


def _head(lines: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as one gzip member."""
    revisit = refers_to is not None
    target = quote(url, safe="%:/?#[]@!$&'()*+,;=~") if url else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest32(block)}"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        lines += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(_head(lines)) + squeeze.compress(block + b"\r\n\r\n") + squeeze.flush()


def write_archives(records: DataFrame, uri: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes page_id, url, payload, refers_to rows below ``uri``; gives uri and n_records, n_bytes of each archive when run. To be run once, as the manifest's table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(uri)
        task = TaskContext.get()
        held: list[bytes] = []
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):05d}.warc.gz"
            store.create_dir(top, recursive=True)
            with store.open_output_stream(posixpath.join(top, name), compression=None) as out:
                for record in held:
                    out.write(record)
            done.append((f"{uri}/{name}", len(held), sum(map(len, held))))
            held.clear()

        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(4)), strict=True):
                held.append(record_bytes(*(x.as_py() for x in row)))
                size += len(held[-1])
                if size >= archive_bytes:
                    close()
                    size = 0
        if held:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["uri", "n_records", "n_bytes"])

    return records.select("page_id", "url", "payload", "refers_to").mapInArrow(write, MANIFEST)


def members(source: BinaryIO, chunk: int = 1 << 16) -> Iterator[bytes]:
    """Inflates one gzip member after the other as the source is read."""
    data = source.read(chunk)
    while data:
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            if not data:
                raise ValueError("the archive ends inside a gzip member")
            out.append(inflate.decompress(data))
            data = inflate.unused_data or source.read(chunk)
        yield b"".join(out)


def parse_record(record: bytes) -> tuple:
    """One uncompressed record as a row of ``RECORD``."""
    head, found, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not found or not first.startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {record[:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    length = int(fields["content-length"])
    block, end = rest[:length], rest[length:]
    if len(block) != length or end != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')}: its length isn't its Content-Length")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.lower() == b"content-length")
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    good = fields["warc-block-digest"] == f"sha1:{digest32(block)}" and (kind == "revisit" or (digest == digest32(payload) and size == len(payload)))
    number = lambda x: None if x in (None, "<urn:page:None>") else int(x.removeprefix("<urn:page:").removesuffix(">"))
    return number(fields["warc-record-id"]), kind, number(fields.get("warc-refers-to")), fields["warc-target-uri"], size, digest, payload if kind == "response" else None, good


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Rows of ``RECORD`` of every archive (uri); a damaged frame raises, a wrong digest gives digest_ok = false. A task an archive, up to ``READERS`` tasks, which then read several one after the other."""
    schema = RECORD if with_payload else RECORD.replace("payload binary, ", "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[x.split()[1]] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_stream(path, compression=None) as source:
                    for record in members(source):
                        row = parse_record(record)
                        rows.append(row if with_payload else row[:6] + row[7:])
                        held += len(record) if with_payload else 64
                        if held > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return archives.select("uri").repartition(max(1, min(archives.count(), READERS))).mapInArrow(read, schema)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes an archive record per page, then reads the archives back: one row per page."""
    archives = stored(write_archives(with_revisits(pages), new_path(spark, "warc")), "manifest")
    return read_archives(archives, with_payload=False)
