import gzip
import hashlib

import pytest

from duecall.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"


def test_query_semantics(spark, tmp_path):
    big, other = "x" * 100, "é" * 50
    rows = [(3, "http://a/3", big), (1, "http://a/1", big), (2, "http://a/2", "short"), (4, "u\r\nv", "short"), (5, None, None), (6, "http://a/6", ""), (7, "http://a/7", other), (8, "http://a/8", other), (1, "http://a/1", big)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    manifest = warc.write(df, f"file://{tmp_path}/w")
    got = warc.read(manifest).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(x[2] for x in rows if x[0] == r.page_id) or ""
        assert (r.payload_bytes, r.payload_digest) == (len(text.encode()), hashlib.sha256(text.encode()).hexdigest())
    kind = {r.page_id: (r.record_type, r.refers_to) for r in got}
    assert kind == {1: ("response", None), 2: ("response", None), 3: ("revisit", 1), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None), 8: ("revisit", 7)}
    path = manifest.first().archive.removeprefix("file://")
    data = open(path, "rb").read()
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == manifest.first().records
    pieces = [data[k : k + 7] for k in range(0, len(data), 7)]
    assert sum(1 for _ in warc.read_stream(pieces)) == manifest.first().records
    with pytest.raises(ValueError):
        list(warc.read_stream([data[:-3]]))


def test_wrong_digests_and_lengths():
    good = warc.record(1, "http://a", b"payload", hashlib.sha256(b"payload").hexdigest(), None, None)
    (r,) = warc.read_stream([good])
    assert r.payload == b"payload" and r.headers["x-page-id"] == "1"
    plain = gzip.decompress(good)
    for bad in (plain.replace(b"payload\r\n\r\n", b"paYload\r\n\r\n"), plain[:-2], plain.replace(b"WARC/1.1", b"HTTP/1.1", 1)):
        with pytest.raises(ValueError):
            list(warc.read_stream([gzip.compress(bad)]))


def test_empty_table(spark, tmp_path):
    assert warc.read(warc.write(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/e")).count() == 0


def test_null_page_id_and_very_long_cells(spark, tmp_path):
    rows = [(None, "http://a/" + "x" * 2_000_000, "y" * 3_000_000), (9, "http://a/9", "y" * 3_000_000), (None, None, None)]
    got = warc.read(warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/n")).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in got) == [("9", 3_000_000, "response", None), ("None", 0, "response", None), ("None", 3_000_000, "revisit", 9)]


def member(head, block):
    return gzip.compress("\r\n".join(["WARC/1.0", *head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_archives_of_others(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\nhello"
    sha1 = warc.base32_sha1(b"hello")
    kind = "Content-Type: application/http; msgtype=response"
    records = [
        member(["WARC-Type: warcinfo", "Content-Type: application/warc-fields"], b"software: x\r\n\r\nmore"),
        member(["WARC-Type: request", "WARC-Target-URI: http://a/", "Content-Type: application/http; msgtype=request"], b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        member(["WARC-Type: response", "WARC-Target-URI: http://a/", kind, f"WARC-Payload-Digest: {sha1}"], http),
        member(["WARC-Type: response", "WARC-Target-URI: http://b/", kind, f"WARC-Payload-Digest: sha1:{hashlib.sha1(b'hello').hexdigest()}"], http),
        member(["WARC-Type: response", kind], http),
        member(["WARC-Type: revisit", kind, f"WARC-Payload-Digest: {sha1}"], b"HTTP/1.1 304 Not Modified\r\n\r\n"),
        member(["WARC-Type: revisit", "X-Page-ID: none"], b""),
        member(["WARC-Type: metadata", "WARC-Payload-Digest: other:1"], b"via: y"),
        member([], b""),
    ]
    path = tmp_path / "other.warc.gz"
    path.write_bytes(b"".join(records))
    got = warc.read(spark.createDataFrame([(f"file://{path}",)], "archive string")).collect()
    own = hashlib.sha256(b"hello").hexdigest()
    assert sorted((str(r.record_type), str(r.uri), str(r.payload_bytes), r.payload_digest or "") for r in got) == sorted([
        ("warcinfo", "None", "19", hashlib.sha256(b"software: x\r\n\r\nmore").hexdigest()), ("request", "http://a/", "0", hashlib.sha256(b"").hexdigest()),
        ("response", "http://a/", "5", sha1[5:]), ("response", "http://b/", "5", hashlib.sha1(b"hello").hexdigest()), ("response", "None", "5", own),
        ("revisit", "None", "None", sha1[5:]), ("revisit", "None", "None", ""), ("metadata", "None", "6", "1"), ("None", "None", "0", hashlib.sha256(b"").hexdigest()),
    ])
    with pytest.raises(ValueError, match="payload"):
        list(warc.read_stream([member(["WARC-Type: response", kind, f"WARC-Payload-Digest: {warc.base32_sha1(b'x')}"], http)]))


def test_a_record_beyond_the_bound(monkeypatch):
    monkeypatch.setattr(warc, "MOST_BYTES", 1000)
    data = member(["WARC-Type: metadata"], b"x" * 5000)
    with pytest.raises(ValueError, match="more than"):
        list(warc.read_stream([data[k : k + 5] for k in range(0, len(data), 5)]))
