"""The streamed merge and the prefix-filtered join against plain Python."""

import random

from duecall.operators import fold, setjoin

SCHEMA = "key string, ord long, id long, url string, pub string, ok boolean, topics array<string>, format map<string,string>, metrics map<string,string>"
SHAPE = fold.Shape("key", "ord", "id", ["url", "pub", "ok"], ["topics"], ["format", "metrics"], ["url", "pub"], "topics", {"ok": 2.5})


def brute(rows):
    """The merge one after another, over all rows in memory."""
    unique, gone = {}, []
    rich = lambda x: (x["url"] is not None) + (x["pub"] is not None) + min(6, len(x["topics"])) / 2 + (2.5 if x["ok"] else 0)
    for r in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2])):
        x = dict(zip(("key", "ord", "id", "url", "pub", "ok", "topics", "format", "metrics"), r, strict=True)) | {"n": 1}
        x["topics"], x["format"], x["metrics"] = list(dict.fromkeys(x["topics"] or [])), dict(x["format"] or {}), dict(x["metrics"] or {})
        if x["key"] not in unique:
            unique[x["key"]] = x
            continue
        a, b = unique[x["key"]], x
        if rich(b) > rich(a):
            a, b = b, a
        gone.append((b["id"], a["id"]))
        best = dict(a)
        for c in ("url", "pub", "ok"):
            best[c] = b[c] if a[c] is None else a[c]
        best["topics"] = a["topics"] + [t for t in b["topics"] if t not in a["topics"]]
        for c in ("format", "metrics"):
            best[c] = dict(b[c])
            best[c].update(a[c])
        best["n"] = a["n"] + b["n"]
        unique[x["key"]] = best
    return unique, sorted(gone)


def made(n, rng):
    word = lambda: rng.choice("abcdefghij")
    some = lambda f: f() if rng.random() < 0.6 else None
    mapped = lambda: {word(): some(word) for _ in range(rng.randint(0, 4))}
    return [(rng.choice(["k1", "k2", "k3", None, f"own{k}"]), some(lambda: rng.randint(0, 50)), k, some(word), some(word), some(lambda: rng.random() < 0.5), some(lambda: [word() for _ in range(rng.randint(0, 5))]), some(mapped), some(mapped)) for k in range(n)]


def test_fold_as_in_memory(spark):
    rows = made(600, random.Random(8))
    unique, gone = fold.streamed(spark.createDataFrame(rows, SCHEMA).repartition(7), SHAPE)
    want, absorbed = brute(rows)
    got = {r.key: r for r in unique.collect()}
    assert got.keys() == want.keys()
    for k, x in want.items():
        r = got[k]
        assert (r.id, r.url, r.pub, r.ok, r.topics, r.format, r.metrics, r.n_merged) == (x["id"], x["url"], x["pub"], x["ok"], x["topics"], x["format"], x["metrics"], x["n"]), k
    assert sorted((r.id, r.merged_into) for r in gone.collect()) == absorbed
    assert fold.streamed(spark.createDataFrame([], SCHEMA), SHAPE)[0].count() == 0


def test_a_hot_key_is_folded_in_flat_memory(spark):
    """A third of a million rows with a null key: the worker's peak stays near that of a small key."""
    import resource

    from pyspark.sql import functions as F

    peak = lambda _: iter([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024])
    n = 330_000
    rows = spark.range(n).select(
        F.lit(None).cast("string").alias("key"), F.col("id").alias("ord"), "id", F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.lit("p").alias("pub"), F.lit(True).alias("ok"),
        F.array(F.concat(F.lit("t"), (F.col("id") % 50).cast("string"))).alias("topics"), F.create_map((F.col("id") % 20).cast("string"), F.col("id").cast("string")).alias("format"), F.lit(None).cast("map<string,string>").alias("metrics"),
    )
    unique, gone = fold.streamed(rows, SHAPE)
    r = unique.first()
    assert (r.n_merged, len(r.topics), len(r.format), r.id) == (n, 50, 20, 0)
    assert gone.count() == n - 1
    assert max(spark.sparkContext.parallelize(range(4), 4).mapPartitions(peak).collect()) < 600


def test_contained_as_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    pick = lambda m: sorted({words[int(rng.random() ** 2 * 60)] for _ in range(m)})
    short = [(k, pick(rng.randint(0, 9))) for k in range(40)] + [(90, None), (91, ["nowhere"]), (92, ["w0"])]
    texts = [(k, pick(rng.randint(0, 50))) for k in range(200)] + [(300, None), (301, []), (302, words)]
    for least in (0.6, 1.0, 0.3):
        got = setjoin.contained(spark.createDataFrame(short, "q long, words array<string>"), spark.createDataFrame(texts, "id long, words array<string>"), least).collect()
        want = {(q, i, len({*s} & {*t}) / len(s)) for q, s in short for i, t in texts if s and t and len({*s} & {*t}) / len(s) >= least}
        assert {(r.q, r.id, r.ratio) for r in got} == want and len(got) == len(want)
