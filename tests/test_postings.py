"""The stored index against a full scan."""

import random

import pytest

from duecall.operators import postings
from pyspark.sql import functions as F


def corpus(spark, n=400, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(200)]
    pick = lambda m: [words[int(rng.random() ** 3 * len(words))] for _ in range(m)]
    rows = [(k, pick(rng.randint(0, 3)), pick(rng.randint(0, 60))) for k in range(n)]
    rows += [(n, [], []), (n + 1, [], ["hot"] * 50), (n + 2, ["hot"], [])] + [(n + 3 + k, rows[7][1], rows[7][2]) for k in range(30)]
    asked = [(q, t, 1.0) for q in range(25) for t in set(pick(rng.randint(1, 12)))] + [(90, "hot", 1.0), (91, "unknown", 1.0), (92, "w0", 0.32), (92, "hot", 1.0)]
    return rows, asked


def brute(rows, asked, k):
    import math

    tf = {i: {t: 2.4 * h.count(t) + b.count(t) for t in {*h, *b}} for i, h, b in rows}
    size = {i: 2.4 * len(h) + len(b) for i, h, b in rows}
    mean = max(1, sum(size.values()) / len(size))
    df = {t: sum(t in x for x in tf.values()) for _, t, _ in asked}
    out = []
    for q in {x[0] for x in asked}:
        scores = {}
        for _, t, w in (x for x in asked if x[0] == q):
            for i, x in tf.items():
                if t in x:
                    scores[i] = scores.get(i, 0) + w * math.log(1 + (len(tf) - df[t] + 0.5) / (df[t] + 0.5)) * x[t] * 2.2 / (x[t] + 1.2 * (0.25 + 0.75 * size[i] / mean))
        out += [(q, i, s, n + 1) for n, (i, s) in enumerate(sorted(((i, round(s, 6)) for i, s in scores.items()), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


@pytest.mark.parametrize(("slice_", "block", "k"), [(50, 4, 3), (1_000_000, 16, 10), (7, 1, 1)])
def test_as_a_full_scan(spark, monkeypatch, tmp_path, slice_, block, k):
    monkeypatch.setattr(postings, "SLICE", slice_)
    monkeypatch.setattr(postings, "BLOCK", block)
    rows, asked = corpus(spark)
    docs = spark.createDataFrame(rows, "id long, h array<string>, b array<string>")
    path = f"file://{tmp_path}/index"
    postings.build(docs, F.col("h"), F.col("b"), 2.4, path)
    index, queries = postings.read(spark, path), spark.createDataFrame(asked, "q long, term string, w double")
    got = sorted((r.q, r.id, r.score, r.ord) for r in postings.search(index, queries, k).collect())
    want = brute(rows, asked, k)
    assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want] and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want, strict=True))
    plan, blocks = postings.planned(index, queries, k)
    met = plan.join(blocks, "term").count()
    assert postings.reaching(plan, blocks).count() < (met if block > 4 else 0.8 * met)


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "id long, h array<string>, b array<string>")
    index = postings.build(docs, F.col("h"), F.col("b"), 2.4)
    assert postings.search(index, spark.createDataFrame([(1, "a", 1.0)], "q long, term string, w double")).count() == 0
