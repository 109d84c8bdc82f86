"""WARC archives: writing records, and a sequential reader.

One gzip member per record. The reader takes a byte stream piece by piece through an
incremental zlib decompressor, frames each record by its Content-Length and checks
its digests; it never holds more than one record. Records whose payload another
record already has are revisits: they carry the payload's digest and HTTP headers, and
refer to that record.

A null payload is an empty one. Payloads under ``MIN_REVISIT`` bytes are always
responses. Archives of others are read too: any type of record, digests in any usual form or none; what
a record doesn't say is null. Where several rows hold the smallest page_id of an equal payload, all of
them are responses. A null page_id sorts last and is written without a number. Broken
archives raise ValueError. An empty table gives no archive and no rows. Only page_id, url
and html are read, so extra columns, whatever their names, don't matter; a url may be of any length.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duecall.llm.common import shared_path, small_batches, written

MIN_REVISIT = 100
#: Bytes of an archive after which a writer begins the next one, and bytes that the reader takes at once.
ARCHIVE_BYTES, PIECE = 64 << 20, 1 << 18
#: A record that unpacks to more is refused.
MOST_BYTES = 1 << 30
#: Archives carry this one date, so that equal rows give equal bytes.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = uuid.UUID("5f3b9f0c-4a53-4b0e-9d9b-0a1d7c1d9b11")


def base32_sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, uri: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_ID, f'{page_id} {uri}')}>"


def clean(value: str | None) -> str:
    """A header's value: no line ends."""
    return re.sub(r"[\r\n]+", " ", value or "")


def record(page_id: int | None, uri: str | None, payload: bytes, digest: str, first: int | None, first_uri: str | None) -> bytes:
    """One record as a gzip member; first is the page_id of the response that a revisit refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = first is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, uri)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean(uri)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first, first_uri)}", f"WARC-Refers-To-Target-URI: {clean(first_uri)}", f"X-Refers-To-Page-ID: {first}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: {base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def is_http(self) -> bool:
        return self.headers.get("content-type", "").startswith("application/http")

    @property
    def http(self) -> dict[str, str]:
        lines = self.block.split(b"\r\n\r\n", 1)[0].decode("latin-1").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}

    @property
    def payload(self) -> bytes:
        """Of an HTTP message what follows its headers, else the whole block."""
        return self.block.partition(b"\r\n\r\n")[2] if self.is_http else self.block


def agrees(data: bytes, digest: str | None) -> bool:
    """Whether data has a labelled digest, in base 32 or hexadecimal. An unknown algorithm, or none, can't be held against it."""
    name, _, value = (digest or "").partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha512") or not value:
        return True
    found = hashlib.new(name, data, usedforsecurity=False)
    return value.lower() == found.hexdigest() or value.upper().rstrip("=") == base64.b32encode(found.digest()).decode().rstrip("=")


def members(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The uncompressed bytes of each gzip member of a stream, one after another."""
    z, out, fed, held = zlib.decompressobj(31), [], False, 0
    for piece in pieces:
        while piece:
            fed = True
            out.append(z.decompress(piece, MOST_BYTES + 1 - held))
            held += len(out[-1])
            if held > MOST_BYTES:
                raise ValueError(f"a record has more than {MOST_BYTES} bytes")
            if not z.eof:
                break
            yield b"".join(out)
            piece, z, out, fed, held = z.unused_data, zlib.decompressobj(31), [], False, 0
    if fed:
        raise ValueError("the archive ends within a member")


def parsed(data: bytes) -> Record:
    """The record of one member: framed by its Content-Length, its digests checked."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/1.") or end < 0:
        raise ValueError("no WARC header")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[:end].decode().split("\r\n")[1:])}
    length = int(headers["content-length"])
    block = data[end + 4 : end + 4 + length]
    if len(block) != length or data[end + 4 + length :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    if not agrees(block, headers.get("warc-block-digest")):
        raise ValueError("a block's digest is wrong")
    out = Record(headers, block)
    if headers.get("warc-type") in ("response", "resource") and not agrees(out.payload, headers.get("warc-payload-digest")):
        raise ValueError("a payload's digest is wrong")
    return out


def read_stream(pieces: Iterable[bytes]) -> Iterator[Record]:
    for member in members(pieces):
        yield parsed(member)


def read_file(uri: str) -> Iterator[Record]:
    """The records of an archive at a local path or a URI that pyarrow opens (file, hdfs, s3, gs)."""
    fs, path = pa.fs.FileSystem.from_uri(uri) if ":" in uri else (pa.fs.LocalFileSystem(), uri)
    with fs.open_input_stream(path, compression=None) as f:
        yield from read_stream(iter(lambda: f.read(PIECE), b""))


def resolved(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, first, first_url): first is null for responses.

    Only digests that occur twice or more are looked up; they are written first, so that
    the join plans with their size and can split a very common digest.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = rows.filter(F.octet_length("payload") >= MIN_REVISIT)
    firsts = long.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull(), "page_id", "url")).alias("_f"), F.count("*").alias("_n")).filter("_n > 1")
    firsts = written(firsts.select("digest", F.col("_f.page_id").alias("first"), F.col("_f.url").alias("first_url")), "firsts")
    out = rows.join(firsts, "digest", "left")
    again = ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select("page_id", "url", "payload", "digest", F.when(again, F.col("first")).alias("first"), F.when(again, F.col("first_url")).alias("first_url"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes archives of pages (page_id, url, html) into a folder that all executors share;
    returns the manifest (archive, records, bytes), one row for each archive.

    A task writes under names of its own. Only archives in the manifest count: what a
    lost or repeated task left behind isn't in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, name, done, n = None, "", [], 0

        def close() -> None:
            nonlocal out
            size = out.tell()
            out.close()
            done.append((f"{folder}/{name}", n, size))
            out = None

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name, n = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                out.write(record(*row))
                n += 1
                if out.tell() >= ARCHIVE_BYTES:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "records", "bytes"])

    small_batches(pages.sparkSession)
    return written(resolved(pages).mapInArrow(run, "archive string, records long, bytes long"), "manifest")


def number(x: str | None) -> int | None:
    return int(x) if x and re.fullmatch(r"\d{1,18}", x) else None


def row(r: Record) -> tuple:
    """A record's line in READ. A digest that isn't named is computed; a revisit's payload isn't there, so
    its size is what its HTTP headers say, and is null without them."""
    h = r.headers
    again = h.get("warc-type") == "revisit"
    size = number(r.http.get("content-length")) if again else len(r.payload)
    digest = h.get("warc-payload-digest", "").rpartition(":")[2] or (None if again else hashlib.sha256(r.payload).hexdigest())
    return number(h.get("x-page-id")), h.get("warc-target-uri"), size, digest, h.get("warc-type"), number(h.get("x-refers-to-page-id"))


READ = "page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(manifest: DataFrame) -> DataFrame:
    """The records of the archives that a frame's column ``archive`` names; one archive goes to one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = [x.split()[0] for x in READ.split(", ")]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
        rows: list[tuple] = []
        for b in batches:
            for archive in b.column(0).to_pylist():
                for r in read_file(archive):
                    rows.append(row(r))
                    if len(rows) >= 1000:
                        yield batch(rows)
                        rows = []
        yield batch(rows)

    tasks = max(1, min(manifest.count(), 10_000))
    return manifest.select("archive").repartition(tasks).mapInArrow(run, READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    if "://" not in folder:
        folder = folder.replace("file:/", "file:///") if folder.startswith("file:/") else f"file://{folder}"
    return read(write(pages, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (digest)
"""
