from __future__ import annotations

import gzip
import io
import hashlib

import pytest
from knnscore.llm import warc

ROWS = [(3, "http://a/3", "<p>x"), (1, "http://a/1", "<p>x"), (2, "http://ü.example/2?q=a b\r\nX: y", "<p>y\r\n\r\nz"), (4, None, None), (5, "u", ""), (6, "u", "é" * 400_000), (7, "u", "é" * 400_000), (8, "u", "<p>x"), (8, "u", "<p>x"), (None, "u", "w"), (9, "u", "w")]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "e", 1) for r in rows], "page_id long, url string, html string, payload string, sha int")


def test_round_trip(spark):
    got = warc.round_trip(spark, pages(spark)).collect()
    assert len(got) == len(ROWS) and all(r.digest_ok for r in got)
    first = {}
    for i, _, h in ROWS:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    for r in got:
        texts = {h or "" for i, _, h in ROWS if i == r.page_id}
        assert r.payload_bytes in {len(t.encode()) for t in texts} and r.payload_digest in {warc.digest32(t.encode()) for t in texts}
        kept = {first[t] for t in texts}
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id in kept else ("revisit", kept.pop()))
    assert warc.round_trip(spark, pages(spark, [])).count() == 0


def test_archives_are_cut_and_payloads_come_back(spark, tmp_path):
    records = warc.with_revisits(pages(spark))
    manifest = warc.write_archives(records, f"file://{tmp_path}/out", archive_bytes=300).collect()
    assert len(manifest) > 4 and sum(r.n_records for r in manifest) == len(ROWS)
    read = lambda names: warc.read_archives(spark.createDataFrame([(n,) for n in names], "uri string"))
    got = read([r.uri for r in manifest]).collect()
    assert sorted(bytes(r.payload).decode() for r in got if r.page_id == 2) == ["<p>y\r\n\r\nz"]
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    for path in (tmp_path / "out").glob("*.gz"):  # any gzip reader reads the members
        assert gzip.decompress(path.read_bytes()).startswith(b"WARC/1.1\r\n")


def test_a_repeated_task_adds_no_record(spark, tmp_path):
    """The manifest names the archives of one attempt; those of others lie beside them unread."""
    write = lambda: warc.write_archives(warc.with_revisits(pages(spark)), f"file://{tmp_path}/out", archive_bytes=300).collect()
    first, second = write(), write()
    assert not {r.uri for r in first} & {r.uri for r in second}
    assert len(list((tmp_path / "out").glob("*.gz"))) == len(first) + len(second)
    got = warc.read_archives(spark.createDataFrame([(r.uri,) for r in second], "uri string"), with_payload=False).collect()
    assert len(got) == len(ROWS)
    assert all(r.digest_ok for r in got)


def test_damage_is_found():
    record = warc.record_bytes(1, "http://a", b"payload", None)
    plain = gzip.decompress(record)
    assert next(warc.members(io.BytesIO(record + record), chunk=7)) == plain
    assert len(list(warc.members(io.BytesIO(record + record), chunk=7))) == 2
    assert warc.parse_record(plain)[-1] and not warc.parse_record(plain.replace(b"payload\r", b"Payload\r"))[-1]
    for spoiled in (plain[:-3], b"x" + plain, plain.replace(b"Content-Length: ", b"Content-Length: 9", 1)):
        with pytest.raises(ValueError):
            warc.parse_record(spoiled)
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(record[:-9])))
    assert warc.digest32(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and hashlib.sha1(b"").hexdigest().startswith("da39")
