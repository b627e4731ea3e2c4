"""Archives: long records in linear time, members of other writers, ranges of any size, awkward pages."""

import base64
import gzip
import hashlib
import time

import numpy as np
import pyarrow.fs as pafs

from evidentia.llm import common, warc


def member(kind, headers, block):
    head = [b"WARC/1.0", b"WARC-Type: " + kind, *headers, b"Content-Length: %d" % len(block)]
    return gzip.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_a_long_record_takes_linear_time(tmp_path):
    took = []
    for mb in (20, 160):
        body = b"<p>" + b"page " * (mb * 209_715) + b"</p>"
        path = tmp_path / f"{mb}.warc.gz"
        path.write_bytes(warc.record(1, "u", body, None, False))
        began = time.perf_counter()
        ((_, block),) = warc.members(pafs.LocalFileSystem(), str(path), 0, path.stat().st_size)
        took.append(time.perf_counter() - began)
        assert block.endswith(body) and len(body) > mb * 1_000_000
    assert took[1] < 24 * max(took[0], 0.02)


def test_archives_of_other_writers(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\nhello"
    parts = [
        member(b"warcinfo", [b"WARC-Record-ID: <urn:uuid:1>", b"Content-Type: application/warc-fields"], b"software: other\r\n\r\nmore"),
        member(b"request", [b"WARC-Record-ID: <urn:uuid:2>", b"Content-Type: application/http; msgtype=request"], b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        member(b"response", [b"WARC-Record-ID: <urn:uuid:3>", b"Content-Type: application/http; msgtype=response"], http),
        member(b"metadata", [], b""),
        member(b"conversion", [b"Content-Type: text/plain"], "naïve".encode()),
        member(b"revisit", [b"WARC-Record-ID: <urn:uuid:4>", b"WARC-Refers-To: <urn:uuid:3>", b"Content-Type: application/http", b"WARC-Payload-Digest: sha1:ABC"], b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\n"),
        b"\x1f\x8b\x08 not a member" + warc.MAGIC * 3,
        gzip.compress(b"no record at all"),
        warc.record(7, "u", b"own", None, False),
    ]
    (tmp_path / "other.warc.gz").write_bytes(b"".join(parts))
    for step in (1 << 20, 64):
        rows = {r["record_type"] + str(r["page_id"] or ""): r for r in warc.read(spark, f"file://{tmp_path}", step).collect()}
        assert len(rows) == 7
        assert bytes(rows["response"]["payload"]) == b"hello" and rows["response"]["payload_bytes"] == 5 and rows["response"]["page_id"] is None
        assert rows["response"]["payload_digest"] == base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
        assert bytes(rows["warcinfo"]["payload"]).startswith(b"software") and bytes(rows["request"]["payload"]) == b"" and bytes(rows["metadata"]["payload"]) == b""
        assert bytes(rows["conversion"]["payload"]).decode() == "naïve" and rows["revisit"]["payload"] is None and rows["revisit"]["payload_bytes"] == 5 and rows["revisit"]["payload_digest"] == "ABC"
        assert bytes(rows["response7"]["payload"]) == b"own"


def test_a_cut_archive_gives_the_whole_records(spark, tmp_path):
    whole = b"".join(warc.record(i, "u", b"x" * 999 + b"%d" % i, None, False) for i in range(9))
    (tmp_path / "cut.warc.gz").write_bytes(whole[:-7])
    (tmp_path / "none.warc.gz").write_bytes(b"")
    assert {r["page_id"] for r in warc.read(spark, f"file://{tmp_path}", 100).collect()} == set(range(8))


def test_pages_of_many_megabytes_go_round_and_the_archives_go_with_clear(spark):
    rng = np.random.default_rng(1)
    big = rng.integers(97, 123, 5 << 20, dtype=np.uint8).tobytes().decode()
    pages = spark.createDataFrame([(1, "a", big), (2, "b", big), (3, "c", big[:-1]), (4, None, None), (4, None, None)], "page_id long, url string, html string").selectExpr("*", "page_id AS digest", "url AS salt", "html AS PAYLOAD")
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.round_trip(pages).drop("payload").collect()}
    assert got == {(1, "response", None, len(big)), (2, "revisit", 1, len(big)), (3, "response", None, len(big) - 1), (4, "response", None, 0)}
    folder = spark._jvm.org.apache.hadoop.fs.Path(common.settled_dir(spark))
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    assert any("warc-" in str(x.getPath()) for x in store.listStatus(folder))
    common.clear(spark)
    assert not store.exists(folder)


def test_only_pages_that_may_have_an_equal_are_joined(spark, monkeypatch):
    rows = [(i, f"u{i}", f"<p>{i if i % 3 else i % 6}</p>") for i in range(1, 400)] + [(None, "n", "<p>0</p>"), (500, "e", None), (501, "e", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    n = {}
    for _, _, html in rows:
        n[html or ""] = n.get(html or "", 0) + 1
    want = sorted((i or -1, first[h or ""] if n[h or ""] > 1 else -1, n[h or ""] > 1 and i != first[h or ""]) for i, _, h in rows)
    for bits in (warc.BITS, 1, 64):  # one bit for all: every page is joined
        monkeypatch.setattr(warc, "BITS", bits)
        got = warc.first_of_equals(pages, 0).collect()
        assert sorted((r["page_id"] or -1, -1 if r["refers_to"] is None else r["refers_to"], r["duplicate"]) for r in got) == want
        assert all(bytes(r["payload"]) == (dict((i, h) for i, _, h in rows)[r["page_id"]] or "").encode() for r in got)
