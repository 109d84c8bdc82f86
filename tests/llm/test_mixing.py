import pytest

from duecall.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string"


def filled(sizes, weights, share, most):
    """Targets by the rule as it is told: share by weight, cut, share the excess again."""
    total, target, full = share * sum(sizes), [0.0] * len(sizes), set()
    while True:
        open_ = [k for k in range(len(sizes)) if k not in full]
        rest = total - sum(target[k] for k in full)
        for k in open_:
            target[k] = rest * weights[k] / sum(weights[j] for j in open_)
        over = {k for k in open_ if target[k] > most * sizes[k]}
        if not over:
            return target
        for k in over:
            target[k] = most * sizes[k]
        full |= over


def test_targets_taken_and_reruns(spark):
    rows, n = [], 0
    for source, docs, size in (("a", 40, 3), ("b", 30, 50), ("Z", 5, 7), (None, 10, 20), ("é", 1, 1000), ("empty", 3, 0)):
        for _ in range(docs):
            rows.append((n, " ".join(["w"] * size), source, "clash"))
            n += 1
    rows += [(None, "x y", "b", "c"), (7, rows[7][1], "a", "c"), (n, None, "b", "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [r.asDict() for r in mixing.mixed(df.drop("size")).collect()]
    assert len(got) == len(rows)
    order = sorted({r[2] for r in rows if r[2]}) + [None]
    sizes = [sum(len((r[1] or "").split()) for r in rows if r[2] == s) for s in order]
    want = filled(sizes, [(3, 1, 2)[k % 3] for k in range(len(order))], 1.5, 2)
    for s, size, target in zip(order, sizes, want, strict=True):
        own = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == size and r["target"] == pytest.approx(target) for r in own)
        assert abs(sum(r["taken"] for r in own) - target) <= 1
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in own)
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"], str(r["placements"]))
    again = [r.asDict() for r in mixing.mixed(df.repartition(7).drop("size")).collect()]
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_schedules_shift_sources_in_time(spark):
    docs = [(k, "w " * 10, "ab"[k % 2]) for k in range(2000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    mix = mixing.Mixture(weights=(1,), share=1.0)
    rows = mixing.curriculum(df, mix).collect()
    places = [r.position for r in rows]
    assert places == sorted(places) and 0 <= min(places) and max(places) <= 1
    early = [r for r in rows if r.position < 0.25]
    rising = sum(r.words for r in early if r.source == "a") / sum(r.words for r in rows if r.source == "a")
    falling = sum(r.words for r in early if r.source == "b") / sum(r.words for r in rows if r.source == "b")
    assert rising == pytest.approx(0.25 * 0.5 + 0.25**2 / 2, abs=0.02) and falling == pytest.approx(0.25 * 1.5 - 0.25**2 / 2, abs=0.02)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixed(df).count() == 0 and mixing.training_order(df).count() == 0
