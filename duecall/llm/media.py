"""Media columns: ISO base media containers in a binary column.

``store`` wraps bytes into a container of raw 8-bit 24 x 24 frames. ``probe``
walks the nested boxes, decodes the sample tables and gives codec, duration and
keyframe byte ranges of every track; it never decodes a sample. A null or broken container
gives a row of nulls with the reason in ``error``; empty bytes and fragmented
containers (moof) give an error too. What a container says of itself is held against
its bytes before anything of that size is made. An empty text is one frame of padding, a null one
likewise, a very long one many. Rows stay apart: repeated rows, ties and extra columns
don't matter, as only the key and the bytes are read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duecall.llm.common import documents, small_batches, written

SIDE = 24
FRAME = SIDE * SIDE
RATE = 25
GOP = 25
PER_CHUNK = 50
PAD = b"\xff"
#: Boxes that hold boxes.
DEEPEST = 16
NESTS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta")


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    if size >> 32:
        return b"".join([struct.pack(">I4sQ", 1, kind, size + 8), *parts])
    return b"".join([struct.pack(">I4s", size, kind), *parts])


def full_box(kind: bytes, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def padded(data: bytes, unit: int = FRAME) -> bytes:
    """data with bytes 255 up to a positive multiple of unit."""
    return data + PAD * (max(1, -(-len(data) // unit)) * unit - len(data))


def container(payload: bytes) -> bytes:
    """payload, a positive multiple of FRAME bytes, as frames of a one-track movie; the same bytes each time."""
    frames = len(payload) // FRAME
    chunks = -(-frames // PER_CHUNK)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    runs = [(1, PER_CHUNK, 1)] if frames >= PER_CHUNK else []
    if last := frames % PER_CHUNK:
        runs.append((chunks, last, 1))
    syncs = np.arange(1, frames + 1, GOP, dtype=">u4")

    def movie(start: int) -> bytes:
        offsets = start + np.arange(chunks, dtype=np.uint64) * (PER_CHUNK * FRAME)
        wide = start + len(payload) >> 32
        tables = box(
            b"stbl",
            full_box(b"stsd", 0, struct.pack(">I", 1), entry),
            full_box(b"stts", 0, struct.pack(">III", 1, frames, 1)),
            full_box(b"stss", 0, struct.pack(">I", len(syncs)), syncs.tobytes()),
            full_box(b"stsc", 0, struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *r) for r in runs)),
            full_box(b"stsz", 0, struct.pack(">II", FRAME, frames)),
            full_box(b"co64" if wide else b"stco", 0, struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        minf = box(b"minf", full_box(b"vmhd", 1, bytes(8)), box(b"dinf", full_box(b"dref", 0, struct.pack(">I", 1), full_box(b"url ", 1))), tables)
        mdia = box(b"mdia", full_box(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, RATE, frames, 0x55C4, 0)), full_box(b"hdlr", 0, bytes(4), b"vide", bytes(13)), minf)
        tkhd = full_box(b"tkhd", 7, struct.pack(">IIIII", 0, 0, 1, 0, frames), bytes(16), matrix, struct.pack(">II", SIDE << 16, SIDE << 16))
        mvhd = full_box(b"mvhd", 0, struct.pack(">IIIIIH", 0, 0, RATE, frames, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
    at = len(head) + len(movie(0)) + (16 if len(payload) + 8 >> 32 else 8)
    return b"".join([head, movie(at), box(b"mdat", payload)])


def walk(data: memoryview, start: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path of box types, first and last byte of the content) of each box, parents first."""
    at, end = start, len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} at {at} has size {size}")
        if kind == b"moof" or len(path) > DEEPEST:
            raise ValueError("fragments aren't read" if kind == b"moof" else "boxes are nested too deep")
        yield (*path, kind), at + head, at + size
        if kind in NESTS:
            yield from walk(data, at + head, at + size, (*path, kind))
        at += size


@dataclass
class Track:
    """One track's tables; offsets and sizes hold for each sample."""

    codec: str = ""
    handler: str = ""
    width: int = 0
    height: int = 0
    timescale: int = 1
    duration: int = 0
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    syncs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def keyframes(self) -> list[tuple[int, int]]:
        """(first byte, bytes) of each sample from which decoding can start."""
        return list(zip(self.offsets[self.syncs].tolist(), self.sizes[self.syncs].tolist(), strict=True))


def _table(data: memoryview, at: int, end: int, kind: str, columns: int, start: int = 8) -> np.ndarray:
    n = struct.unpack_from(">I", data, at + start - 4)[0]
    width = np.dtype(kind).itemsize * columns
    if at + start + n * width > end:
        raise ValueError("a table is cut short")
    return np.frombuffer(data, kind, n * columns, at + start).astype(np.int64).reshape(n, columns)


def _track(data: memoryview, boxes: dict[bytes, tuple[int, int]]) -> Track:
    t = Track()
    if b"hdlr" in boxes:
        t.handler = bytes(data[boxes[b"hdlr"][0] + 8 : boxes[b"hdlr"][0] + 12]).decode("latin-1")
    if b"mdhd" in boxes:
        at = boxes[b"mdhd"][0]
        t.timescale, t.duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
    at, end = boxes[b"stsd"]
    if at + 16 <= end:
        t.codec = bytes(data[at + 12 : at + 16]).decode("latin-1")
        if t.handler == "vide" and at + 44 <= end:
            t.width, t.height = struct.unpack_from(">HH", data, at + 40)
    at, end = boxes[b"stsz"]
    fixed, n = struct.unpack_from(">II", data, at + 4)
    if fixed * n > len(data):
        raise ValueError("samples beyond the end")
    t.sizes = np.full(n, fixed, np.int64) if fixed else _table(data, at, end, ">u4", 1, 12)[:, 0]
    chunks = _table(data, *boxes[b"co64"], ">u8", 1)[:, 0] if b"co64" in boxes else _table(data, *boxes[b"stco"], ">u4", 1)[:, 0]
    runs = _table(data, *boxes[b"stsc"], ">u4", 3)
    if len(chunks) and len(runs):
        firsts = runs[:, 0] - 1
        per_chunk = np.repeat(runs[:, 1], np.diff(np.append(firsts, len(chunks))))
        if firsts[0] != 0 or (per_chunk < 0).any() or per_chunk.sum() != n:
            raise ValueError("chunks and samples don't agree")
        before = np.concatenate([[0], np.cumsum(t.sizes)])[:-1]
        first_sample = np.concatenate([[0], np.cumsum(per_chunk)])[:-1]
        full = per_chunk > 0
        t.offsets = before + np.repeat(chunks[full] - before[first_sample[full]], per_chunk[full])
    elif n:
        raise ValueError("samples without chunks")
    t.syncs = _table(data, *boxes[b"stss"], ">u4", 1)[:, 0] - 1 if b"stss" in boxes else np.arange(n)
    if len(t.syncs) and not (0 <= t.syncs.min() and t.syncs.max() < n):
        raise ValueError("a keyframe that is no sample")
    if b"stts" in boxes and not t.duration:
        times = _table(data, *boxes[b"stts"], ">u4", 2)
        t.duration = int((times[:, 0] * times[:, 1]).sum())
    return t


def tracks(data: bytes) -> list[Track]:
    """The tracks of a container, by order in the file; ValueError where it is broken."""
    view, found = memoryview(data), []
    current: dict[bytes, tuple[int, int]] = {}
    try:
        for path, at, end in walk(view):
            if path[-1] == b"trak":
                found.append(current := {})
            elif b"trak" in path:
                current.setdefault(path[-1], (at, end))
        out = [_track(view, boxes) for boxes in found]
    except (struct.error, KeyError, IndexError) as e:
        raise ValueError(f"broken container: {e}") from e
    if not out:
        raise ValueError("no track")
    return out


def samples(data: bytes, track: Track) -> bytes:
    """All samples of a track in order: neighbours in the file are cut as one piece."""
    if not len(track.sizes):
        return b""
    ends = track.offsets + track.sizes
    breaks = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    starts, stops = track.offsets[np.append(0, breaks)], ends[np.append(breaks - 1, len(ends) - 1)]
    if starts.min() < 0 or (stops < starts).any() or stops.max() > len(data):
        raise ValueError("samples beyond the end")
    return b"".join(data[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True))


STORED = "doc_id long, n_bytes long, media binary"
#: The first track's payload is digested; all tracks' tables are kept.
RANGES = "array<struct<first:long,bytes:long>>"
TRACKS = f"array<struct<codec:string,handler:string,width:int,height:int,duration:double,n_samples:long,keyframes:{RANGES}>>"
PROBED = f"doc_id long, n_bytes long, media_bytes long, tracks {TRACKS}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, error string"
_RANGES = pa.list_(pa.struct([("first", pa.int64()), ("bytes", pa.int64())]))
_TRACKS = pa.list_(pa.struct([("codec", pa.string()), ("handler", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("duration", pa.float64()), ("n_samples", pa.int64()), ("keyframes", _RANGES)]))


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_bytes, media): the padded UTF-8 of the text in a container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(x or "").encode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(map(len, raw), pa.int64()), pa.array([container(padded(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, STORED)


def _probe(n_bytes: int | None, data: bytes | None) -> tuple:
    if data is None:
        return (n_bytes, *[None] * 6, "null")
    sha = hashlib.sha256(data).hexdigest()
    try:
        found = tracks(data)
        payload = samples(data, found[0])
        rows = [{"codec": t.codec, "handler": t.handler, "width": t.width, "height": t.height, "duration": t.duration / t.timescale if t.timescale else None, "n_samples": len(t.sizes), "keyframes": [{"first": a, "bytes": n} for a, n in t.keyframes()]} for t in found]
    except (ValueError, IndexError) as e:
        return (n_bytes, len(data), *[None] * 4, sha, str(e)[:200])
    return (n_bytes, len(data), rows, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), sha, None)


def probe(stored: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) -> what the tracks' tables say, and the first track's digests."""
    names = ["doc_id", "n_bytes", "media_bytes", "tracks", "payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "error"]
    kinds = [pa.int64(), pa.int64(), _TRACKS, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_probe(n, m) for n, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, PROBED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The containers are written as a binary column and read back, and the features come from what was read."""
    probed = probe(written(store(documents(spark, sf_dir)), "media", "zstd"))
    t = F.get("tracks", F.lit(0))
    ranges = F.array_join(F.transform(t["keyframes"], lambda k: F.format_string("%d+%d", k["first"], k["bytes"])), ",")
    out = probed.select("*", t["codec"].alias("codec"), t["width"].alias("width"), t["height"].alias("height"), t["duration"].alias("duration"), t["n_samples"].alias("n_samples"), F.size(t["keyframes"]).alias("n_keyframes"), ranges.alias("keyframes"))
    feature = F.format_string("%s;%dx%d;%.2f s;%d frames;%d keyframes;ranges %08x", "codec", "width", "height", "duration", "n_samples", "n_keyframes", F.crc32(F.col("keyframes").cast("binary")))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "codec", "duration", "n_samples", "keyframes")
