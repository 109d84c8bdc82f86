import hashlib
import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from duecall.llm import media


@settings(deadline=None, max_examples=60)
@given(st.binary(max_size=5000))
def test_round_trip(data):
    payload = media.padded(data)
    assert len(payload) % media.FRAME == 0 and payload.startswith(data) and len(payload) > 0
    stored = media.container(payload)
    assert stored == media.container(payload)
    (t,) = media.tracks(stored)
    assert media.samples(stored, t) == payload
    assert t.codec == "raw " and (t.width, t.height) == (24, 24) and t.duration == len(payload) // media.FRAME


def test_many_chunks_and_keyframes():
    payload = b"".join(bytes([k % 256]) * media.FRAME for k in range(180))
    stored = media.container(payload)
    (t,) = media.tracks(stored)
    ranges = t.keyframes()
    assert len(ranges) == 8
    for k, (at, n) in enumerate(ranges):
        assert stored[at : at + n] == bytes([k * media.GOP % 256]) * media.FRAME


def test_varying_sizes_scattered_chunks_and_no_sync_table():
    parts = [b"a" * 3, b"b" * 5, b"c" * 2]
    head = 8
    offsets = [head + 10, head]  # the second chunk lies first
    data = box_mdat = media.box(b"mdat", parts[2] + b"........" + parts[0] + parts[1])
    stbl = media.box(
        b"stbl",
        media.full_box(b"stsd", 0, struct.pack(">I", 1), media.box(b"abcd", bytes(8))),
        media.full_box(b"stts", 0, struct.pack(">III", 1, 3, 7)),
        media.full_box(b"stsc", 0, struct.pack(">I", 2), struct.pack(">III", 1, 2, 1), struct.pack(">III", 2, 1, 1)),
        media.full_box(b"stsz", 0, struct.pack(">II", 0, 3), struct.pack(">III", 3, 5, 2)),
        media.full_box(b"co64", 0, struct.pack(">I", 2), struct.pack(">QQ", *offsets)),
    )
    data += media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.box(b"minf", stbl))))
    (t,) = media.tracks(data)
    assert media.samples(data, t) == b"".join(parts) and t.duration == 21 and t.codec == "abcd"
    assert [data[a : a + n] for a, n in t.keyframes()] == parts
    assert box_mdat


def test_broken_containers():
    good = media.container(media.padded(b"x"))
    for bad in (b"", b"junk", good[:50], good[:-600], good.replace(b"stsz", b"stsy")):
        with pytest.raises(ValueError):
            media.samples(bad, media.tracks(bad)[0])


def test_columns(spark):
    rows = [(1, "é" * 700, "x"), (2, None, "x"), (3, "", "x"), (1, "é" * 700, "x"), (None, "t", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = media.probe(media.store(df)).collect()
    assert len(got) == 5 and all(r.error is None for r in got)
    r = next(r for r in got if r.doc_id == 1)
    assert (r.n_bytes, r.payload_bytes) == (1400, 1728)
    assert r.payload_sha256 == hashlib.sha256(media.padded(("é" * 700).encode())).hexdigest()
    assert media.probe(media.store(df.limit(0))).count() == 0
    bad = spark.createDataFrame([(1, 2, None), (2, 2, bytearray(b"junk"))], "doc_id long, n_bytes long, media binary")
    assert sorted(bool(r.error) for r in media.probe(bad).collect()) == [True, True]


def test_false_tables_give_errors():
    good = media.container(media.padded(b"x"))
    at = good.index(b"stsz") + 8
    huge = good[:at] + struct.pack(">II", 8, 2**32 - 1) + good[at + 8 :]
    sync = good.index(b"stss") + 12
    zero = good[:sync] + struct.pack(">I", 0) + good[sync + 4 :]
    deep = b"x"
    for _ in range(3000):
        deep = media.box(b"moov", deep)
    for bad in (huge, zero, deep, good + media.box(b"moof")):
        assert media._probe(1, bad)[-1]


def test_damaged_bytes_never_raise():
    rng = random.Random(4)
    good = media.container(media.padded(b"some text " * 200))
    for _ in range(3000):
        bad = bytearray(good[: rng.randrange(len(good))] if rng.random() < 0.2 else good)
        for _ in range(rng.randint(1, 6)):
            if bad:
                bad[rng.randrange(min(len(bad), 720))] = rng.randrange(256)
        assert len(media._probe(1, bytes(bad))) == 8


def test_query_as_brute_force(spark, tmp_path):
    """The query's columns from the text alone, and from the stored bytes by what its ranges say."""
    texts = ["", None, "short", "é" * 700, "word " * 40_000, "short"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in media.query(spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
        r, stored = got[k], media.container(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        frames = len(payload) // 576
        assert r.n_samples == frames and r.duration == frames / 25 and r.codec == "raw "
        pieces = [tuple(map(int, x.split("+"))) for x in r.keyframes.split(",")]
        assert [stored[a : a + n] for a, n in pieces] == [payload[576 * j : 576 * j + 576] for j in range(0, frames, 25)]
    assert got[2].feature == got[5].feature
