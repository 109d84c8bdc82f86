import hashlib
import math
import random

import numpy as np
import pytest

from duecall.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, rounds=vc.ROUNDS):
    """{(vec_id, vector): (code, error, label_error)}, digest, in Python's integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 8
    parts = [[[math.floor(4096 * x) if abs(x) < 1e300 else int(x) * 4096 for x in r[1][p * width : (p + 1) * width]] for p in range(8)] for r in kept]
    books = [[parts[k][p] for k in range(min(16, len(parts)))] for p in range(8)]

    def assign():
        far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
        return [[min((far(v[p], e), k) for k, e in enumerate(books[p])) for p in range(8)] for v in parts]

    for _ in range(rounds):
        best = assign()
        for p in range(8):
            for k in range(len(books[p])):
                own = [v[p] for v, b in zip(parts, best, strict=True) if b[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    best = assign()
    errors = [sum(d for d, _ in b) for b in best]
    labels = {}
    for r, e in zip(kept, errors, strict=True):
        labels[r[2]] = labels.get(r[2], 0) + e
    out = [(r[0], "".join(f"{k:02x}" for _, k in b), e, labels[r[2]]) for r, b, e in zip(kept, best, errors, strict=True)]
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest(), books


def check(spark, rows):
    out, books = vc.compressed(spark.createDataFrame(rows, SCHEMA))
    want, sha, theirs = brute(rows)
    want = [(i, code, min(e, vc.LIMIT), min(s, vc.LIMIT)) for i, code, e, s in want]
    order = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in out.select("vec_id", "code", "error", "label_error").collect()), key=order) == sorted(want, key=order)
    assert vc.digest(books) == sha and books == theirs
    return out, books


def test_as_brute_force(spark):
    rng = random.Random(4)
    rows = [(k, [rng.gauss(0, 0.2) for _ in range(24)], rng.choice([1, 1, 2, None])) for k in range(200)]
    rows += [(300 + k, rows[k % 3][1], 7) for k in range(40)] + [(None, rows[5][1], 1), (5, rows[9][1], 1), (5, rows[5][1], 1)]
    rows += [(400, None, 1), (401, [None] * 24, 1), (402, [math.nan] * 24, 1), (403, [math.inf] * 24, 1), (404, [], 1)][:4]
    out, books = check(spark, rows)
    back = {r.vec_id: r.decoded for r in vc.decoded(out, books).collect()}
    assert len(back[0]) == 24 and max(abs(a - b) for a, b in zip(back[0], rows[0][1], strict=True)) < 1


@pytest.mark.parametrize("scale", [1, 50, 1e4])
def test_whole_coordinates_and_ties(spark, scale):
    rng = random.Random(5)
    check(spark, [(k, [float(scale * rng.randrange(-2, 3)) for _ in range(16)], k % 3) for k in range(120)])


def test_large_components_are_exact(spark):
    rng = random.Random(6)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)], 1) for k in range(30)]
    rows += [(100 + k, [1e9 + k / 4096, *(rng.gauss(0, 1) for _ in range(7))], 2) for k in range(20)] + [(200, [1e8] * 8, 3)]
    check(spark, rows)
    check(spark, [(k, [1e300 * (-1) ** k] * 8, 1) for k in range(40)] + [(50, [0.0] * 8, 1)])
    check(spark, [(k, [0.0] * 8, 1) for k in range(20)] + [(50, [1e300] * 8, 2), (51, [-1e300] * 8, 2)])


def test_few_vectors_odd_lengths_and_clashes(spark):
    check(spark, [(k, [float(k)] * 8, None) for k in range(5)])
    rows = [(1, [1.0] * 8, 1, "a"), (2, [1.0] * 16, 1, "b"), (3, [], 1, "c"), (4, None, 1, "d")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, error string").withColumnRenamed("error", "code")
    out, books = vc.compressed(df.withColumn("_label", df.code).withColumn("vector", df.code))
    assert sorted((r.vec_id, r.code, r.error, r.label_error, r._label, r.vector) for r in out.collect()) == [(1, "00" * 8, 0, 0, "a", "a"), (2, None, None, 0, "b", "b"), (3, None, None, 0, "c", "c")]
    seven = spark.createDataFrame([(1, [1.0] * 7, 1)], SCHEMA)
    assert vc.compressed(seven)[0].collect()[0].code is None
    assert vc.compressed(seven.limit(0))[0].count() == 0


def test_filter_keeps_every_nearest_entry():
    rng = np.random.default_rng(7)
    entries = rng.integers(-500, 500, (16, 8))
    entries[3] = entries[9]
    rows = np.concatenate([rng.integers(-800, 800, (500, 8)), entries]).astype(float)
    far = ((rows[:, None] - entries[None]) ** 2).sum(2)
    best, least = vc.Filter(entries.tolist()).nearest(rows)
    assert (best == far.argmin(1)).all() and (least == far.min(1)).all() and least[-16:].sum() == 0 and best[-7] == 3
