"""Exact nearest vectors by cosine: blocks of vectors against blocks of queries, one matrix product for each pair of blocks.

Both sides are packed into blocks of up to BLOCK vectors, and each pair of blocks meets once, in whichever way
Spark joins them; a task keeps the best of each query over the blocks that it has seen, for KEPT queries at most,
and a window takes the best of all tasks. Cosines are rounded to six digits first; ties go to the smallest id.

A null vector, or one that holds a null or has another length than the query's, has a null cosine, which comes last;
a vector of length zero has NaN, which comes first, as in DuckDB. A null id is no vector's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block; a row that crosses to Python holds two blocks.
BLOCK = 256
#: Queries whose best a task keeps before it gives them out.
KEPT = 200_000


def blocks(rows: DataFrame, prefix: str) -> DataFrame:
    """(id, v) as blocks of vectors of one width: ids and components as bytes; width -1 for vectors that are null or hold a null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by_width: dict[int, tuple[list, list]] = {}
            for key, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                bad = v is None or None in v
                ids, vs = by_width.setdefault(-1 if bad else len(v), ([], []))
                ids.append(key)
                vs.append([] if bad else v)
            for width, (ids, vs) in by_width.items():
                for k in range(0, len(ids), BLOCK):
                    yield pa.RecordBatch.from_pydict({f"{prefix}w": [width], f"{prefix}ids": [np.array(ids[k : k + BLOCK], np.int64).tobytes()], f"{prefix}vs": [np.array(vs[k : k + BLOCK], np.float64).tobytes()]})

    return rows.mapInArrow(run, f"{prefix}w long, {prefix}ids binary, {prefix}vs binary")


def unit(ids: bytes, vs: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's ids, vectors and squared lengths."""
    key = np.frombuffer(ids, np.int64)
    v = np.frombuffer(vs, np.float64).reshape(len(key), max(width, 0))
    return key, v, np.einsum("ij,ij->i", v, v)


def best(row: np.ndarray, value: np.ndarray, key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first most entries of each row: by value, descending, then by key."""
    order = np.lexsort((key, -value, row))
    row, value, key = row[order], value[order], key[order]
    start = np.searchsorted(row, row, "left")
    keep = np.arange(len(row)) - start < most
    return row[keep], value[keep], key[keep]


def nearest(vectors: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """(q, vec_id, cosine): the most nearest of vectors (id, v) of each of queries (id, v), but for those of its own id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple, tuple] = {}
        kept = 0

        def given() -> Iterator[pa.RecordBatch]:
            for q, row, value, key in state.values():
                cosine = np.where(value == np.inf, np.nan, value)
                yield pa.RecordBatch.from_pydict({"q": pa.array(q[row]), "vec_id": pa.array(key), "cosine": pa.array(cosine, mask=value == -np.inf)})
            state.clear()

        for b in batches:
            for x in b.to_pylist():
                q, e, ee = unit(x["qids"], x["qvs"], x["qw"])
                d, v, vv = unit(x["ids"], x["vs"], x["w"])
                if x["w"] != x["qw"] or x["w"] < 0:
                    s = np.full((len(q), len(d)), -np.inf)
                else:
                    with np.errstate(all="ignore"):
                        s = (e @ v.T) / np.sqrt(ee[:, None] * vv[None, :])
                    s[np.isnan(s)] = np.inf
                own = q[:, None] == d[None, :]
                low = np.where(own, -np.inf, s)
                tag = (x["qids"], x["qvs"])
                _, row, value, key = state.get(tag, (q, np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)))
                floor = np.full(len(q), -np.inf)
                if len(row) == most * len(q):
                    floor = value[most - 1 :: most] - 1e-6
                elif len(d) > most:
                    floor = np.partition(low, len(d) - most, axis=1)[:, len(d) - most] - 1e-6
                r, c = np.nonzero((low >= floor[:, None]) & ~own)
                found = s[r, c]
                found = np.where(np.isfinite(found), np.copysign(np.floor(np.abs(found) * 1e6 + 0.5) / 1e6, found), found)
                if tag not in state:
                    kept += len(q)
                state[tag] = (q, *best(np.concatenate([row, r]), np.concatenate([value, found]), np.concatenate([key, d[c]]), most))
                if kept > KEPT:
                    yield from given()
                    kept = 0
        yield from given()

    both = blocks(vectors.filter("id is not null"), "").crossJoin(blocks(queries, "q"))
    out = both.mapInArrow(run, "q long, vec_id long, cosine double")
    w = Window.partitionBy("q").orderBy(F.desc("cosine"), "vec_id")
    return out.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")
