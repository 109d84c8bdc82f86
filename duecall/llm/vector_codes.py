"""Vector code compression: product codes whose nearest entries a VA-file filter finds.

Each component x becomes the integer floor(4096 x), and a vector is cut into ``PARTS`` equal parts. A
part position's codebook starts as that part of the ``ENTRIES`` vectors of smallest
vec_id. Each round assigns every part to its nearest entry and moves the entries
to the floored mean of their parts; an entry without parts stays.

Search: a codebook's coordinates are quantised to ``BITS`` bits, dimension by dimension, into
cells between the coordinates' least and greatest value. For a batch of parts a lookup table holds, for each
dimension and cell, the least and greatest squared distance of the part's coordinate to the coordinates in
the cell. Summed by the entries' cells they bound each entry's distance from below and above;
only entries whose lower bound doesn't exceed the least upper bound are refined by the exact
integer distance, the lower index first if tied. Sums stay whole numbers below 2^53, exact in 64-bit
floats; where components are so large that they might not, the batch is worked in Python's integers.

Each round reads all vectors and sends ``PARTS`` * ``ENTRIES`` sums a task to a shuffle; the driver
holds only the codebooks (their size is that of ``ENTRIES`` vectors). Sums are added as decimals of
38 digits, in limbs. Nothing is sampled.

Vectors that are null or hold a null, NaN or infinity are dropped. A vector whose length isn't that of
the kept vector of smallest vec_id, or no multiple of ``PARTS``, has null code and errors and takes no
part. Fewer vectors than ``ENTRIES`` make smaller codebooks. Equal vec_ids are ordered by their
vectors, null ones are last. Repeated rows count each. An error beyond 64 bits is given as 2^63 - 1. An
empty table gives no rows. Extra columns pass through, whatever their names; code, error and label_error are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duecall.llm.common import packed, small_batches, unpacked, written

PARTS, ENTRIES, ROUNDS, SCALE, BITS = 8, 16, 6, 4096, 2
LIMIT = 2**63 - 1

Codebook = list[list[list[int]]]


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce(~F.exists(vector, bad), F.lit(False))


def integers(rows: np.ndarray) -> np.ndarray:
    """floor(4096 x) as whole 64-bit floats where these are exact, else as Python's integers."""
    out = np.floor(rows.astype(np.float64) * SCALE)
    return out if np.abs(out).max(initial=0) < 2**53 else np.array([[int(x) for x in r] for r in out.tolist()], object)


class Filter:
    """One part position's codebook, its entries quantised into cells."""

    def __init__(self, entries: list[list[int]]) -> None:
        self.top = max((abs(x) for e in entries for x in e), default=0)
        self.whole = np.array(entries, object)
        self.near = np.array(entries, np.float64) if self.top < 2**53 else None
        if self.near is not None:
            low, high = self.near.min(0), self.near.max(0)
            wide = np.maximum(high - low, 1)
            n = 1 << BITS
            self.cells = np.minimum((self.near - low) * n // wide, n - 1).astype(np.int64)
            members = self.cells[:, :, None] == np.arange(n)
            self.lows = np.where(members, self.near[:, :, None], np.inf).min(0)
            self.highs = np.where(members, self.near[:, :, None], -np.inf).max(0)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest entry, the lower index if tied."""
        dims = rows.shape[1]
        most = max(self.top, int(np.abs(rows).max(initial=0)))
        if self.near is None or rows.dtype == object or 4 * dims * most * most >= 2**53:
            far = [[sum((a - b) ** 2 for a, b in zip(map(int, r), e, strict=True)) for e in self.whole.tolist()] for r in rows.tolist()]
            return np.array([x.index(min(x)) for x in far], np.int64), np.array([min(x) for x in far], object)
        q = rows[:, :, None]
        empty = np.isinf(self.lows)
        lows, highs = np.where(empty, 0, self.lows), np.where(empty, 0, self.highs)
        least = np.maximum(np.maximum(lows - q, q - highs), 0) ** 2
        most_ = np.maximum(np.abs(q - lows), np.abs(q - highs)) ** 2
        lower, upper = np.zeros((len(rows), len(self.near))), np.zeros((len(rows), len(self.near)))
        for d in range(dims):
            lower += least[:, d, self.cells[:, d]]
            upper += most_[:, d, self.cells[:, d]]
        row, entry = np.nonzero(lower <= upper.min(1, initial=np.inf, keepdims=True))
        exact = np.full(lower.shape, np.inf)
        exact[row, entry] = ((rows[row] - self.near[entry]) ** 2).sum(1)
        best = exact.argmin(1)
        return best, exact[np.arange(len(rows)), best]


def searched(books: Codebook, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, its rows, nearest entries, distances) of a batch of vectors of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    rows = integers(flat.reshape(len(column), -1))
    width = rows.shape[1] // PARTS
    for p, entries in enumerate(books):
        own = rows[:, p * width : (p + 1) * width]
        yield p, own, *Filter(entries).nearest(own)


def first_books(fit: DataFrame) -> Codebook:
    """The parts of the vectors of smallest vec_id."""
    first = [r[0] for r in fit.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").collect()]
    rows = integers(np.array(first, np.float64)).tolist() if first else []
    width = len(rows[0]) // PARTS if rows else 0
    return [[[int(x) for x in r[p * width : (p + 1) * width]] for r in rows] for p in range(PARTS)] if rows else []


#: A sum is sent in limbs of 60 bits, whatever its size.
SUMS = "part int, entry int, at int, limb int, total decimal(38,0), n long"


def limbs(x: int) -> Iterator[tuple[int, Decimal]]:
    sign, x, k = (-1 if x < 0 else 1), abs(x), 0
    while x or not k:
        yield k, Decimal(sign * (x & (1 << 60) - 1))
        x, k = x >> 60, k + 1


def moved(fit: DataFrame, books: Codebook) -> Codebook:
    """The codebooks after one round over all vectors."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for b in batches:
            for p, rows, best, _ in searched(books, b.column(0)):
                for e in np.unique(best).tolist():
                    own = rows[best == e]
                    kept = sums.setdefault((p, e), [0, [0] * rows.shape[1]])
                    kept[0] += len(own)
                    kept[1] = [x + y for x, y in zip(kept[1], whole_sums(own), strict=True)]
        out = [(p, e, d, k, x, 0 if k else n) for (p, e), (n, total) in sums.items() for d, y in enumerate(total) for k, x in limbs(y)]
        columns = zip(*out, strict=True) if out else [[]] * 6
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "entry", "at", "limb", "total", "n"])

    summed = fit.select("vector").mapInArrow(of, SUMS).groupBy("part", "entry", "at", "limb").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    sums: dict[tuple[int, int, int], list[int]] = {}
    for p, e, d, limb, total, n in summed.collect():  # a few rows for each coordinate of the codebooks
        kept = sums.setdefault((p, e, d), [0, 0])
        kept[0] += int(total) << 60 * limb
        kept[1] += n
    new = [[list(e) for e in book] for book in books]
    for (p, e, d), (total, n) in sums.items():
        new[p][e][d] = total // n
    return new


def whole_sums(rows: np.ndarray) -> list[int]:
    """The columns' exact sums."""
    if rows.dtype == object or np.abs(rows).max(initial=0) * len(rows) >= 2**53:
        return [sum(map(int, c)) for c in rows.T.tolist()]
    return [int(x) for x in rows.sum(0).tolist()]


def digest(books: Codebook) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()


def fitted(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[Codebook, int]:
    """The codebooks of (vec_id, vector) after all rounds, and the vectors' length."""
    head = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select(F.size("vector")).first()
    length = head[0] if head else 0
    if not length or length % PARTS:
        return [], length
    fit = vectors.filter(F.size("vector") == length)
    books = first_books(fit)
    for _ in range(rounds):
        books = moved(fit, books)
    return books, length


def coded(vectors: DataFrame, books: Codebook, length: int) -> DataFrame:
    """vectors, a frame with a column vector, with code and error; both null for vectors of another length."""
    names = [f for f in vectors.columns if f != "vector"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vector = b.column(b.schema.get_field_index("vector"))
            fits = np.array([bool(books) and x == length for x in pc.list_value_length(vector).to_pylist()], bool)
            codes, errors = np.full(len(fits), None, object), np.full(len(fits), None, object)
            if fits.any():
                code, error = np.zeros((fits.sum(), PARTS), np.int64), np.zeros(fits.sum(), object)
                for p, _, best, far in searched(books, vector.filter(pa.array(fits))):
                    code[:, p] = best
                    error = error + np.array([int(x) for x in far.tolist()], object)
                codes[fits] = ["".join(f"{x:02x}" for x in r) for r in code.tolist()]
                errors[fits] = [min(x, LIMIT) for x in error.tolist()]
            kept = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(codes.tolist(), pa.string()), pa.array(errors.tolist(), pa.int64())], [*names, "code", "error"])

    out = vectors.select(*names).schema
    return vectors.select(*names, "vector").mapInArrow(of, out.add("code", "string").add("error", "long"))


def compressed(rows: DataFrame, vector: str = "embedding", rounds: int = ROUNDS) -> tuple[DataFrame, Codebook]:
    """(rows of usable vectors with code, error and label_error, the codebooks)."""
    small_batches(rows.sparkSession)
    full = packed(rows, vec_id=F.col("vec_id"), label=F.col("label"), vector=F.col(vector)).filter(usable(F.col("vector")))
    books, length = fitted(full.select("vec_id", "vector"), rounds)
    found = written(coded(full, books, length), "coded")
    by_label = found.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LIMIT)).cast("long").alias("label_error"))
    by_label = written(by_label.withColumnRenamed("label", "_label"), "label-errors")
    out = found.join(by_label, F.col("label").eqNullSafe(F.col("_label")), "left")
    names = [c for c in rows.columns if c not in ("code", "error", "label_error")]
    return unpacked(out, names, code=F.col("code"), error=F.col("error"), label_error=F.col("label_error")), books


def decoded(codes: DataFrame, books: Codebook) -> DataFrame:
    """codes with a column ``decoded``: the entries that each code names, as the components they stand for."""
    flat = F.array(*(F.array(*(F.array(*(F.lit(x / SCALE) for x in e)) for e in book)) for book in books))
    entry = lambda p: F.get(F.get(flat, F.lit(p)), F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int"))
    return codes.withColumn("decoded", F.flatten(F.array(*(entry(p) for p in range(len(books))))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(rounds: int = ROUNDS) -> str:
    """The rounds one after another, every distance in full."""
    near = """SELECT v.id, v.part, arg_min(e.entry, (d, e.entry)) AS entry, min(d) AS d FROM (
  SELECT v.id, v.part, e.entry, list_sum(list_transform(list_zip(v.x, e.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v JOIN e{k} e ON v.part = e.part) v JOIN (SELECT DISTINCT entry FROM e{k}) e ON v.entry = e.entry GROUP BY v.id, v.part"""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED ({near.format(k=k)})")
        if k < rounds:
            steps.append(
                f"m{k} AS (SELECT part, entry, list(x ORDER BY at_) AS x FROM (SELECT part, entry, at_, (sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM (SELECT a.part, a.entry, unnest(v.x)::HUGEINT AS c, unnest(range(len(v.x))) AS at_ FROM a{k} a JOIN v USING (id, part)) GROUP BY part, entry, at_) GROUP BY part, entry)"
            )
            steps.append(f"e{k + 1} AS MATERIALIZED (SELECT e.part, e.entry, coalesce(m.x::BIGINT[], e.x) AS x FROM e{k} e LEFT JOIN m{k} m ON m.part = e.part AND m.entry = e.entry)")
    return f"""
WITH r AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS id, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT id, part, x[part * len(x) // 8 + 1:(part + 1) * len(x) // 8] AS x FROM r, (SELECT unnest(range(8)) AS part)),
e0 AS MATERIALIZED (SELECT part, id AS entry, x FROM v WHERE id < 16),
{", ".join(steps)},
o AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY id),
s AS (SELECT sha256(string_agg(c, ',' ORDER BY part, entry, at_)) AS sha FROM (SELECT part, entry, unnest(x)::VARCHAR AS c, unnest(range(len(x))) AS at_ FROM e{rounds}))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, sha AS codebooks_sha256 FROM r JOIN o USING (id), s
"""
