import random

from duecall.llm import line_dedup

SCHEMA = "doc_id long, text string, source string, extra int"


def brute(rows, least):
    """Lines of later runs, by comparing all pairs of places."""
    docs = []
    for doc, text in sorted({(d, t) for d, t in rows if t}, key=lambda x: (x[0] is None, x[0] or 0)):
        lines = [(k, " ".join(x.lower().split()), len(x.split())) for k, x in enumerate(text.split("\n")) if x.split()]
        docs.append(((doc, text), lines))
    places = [(d, i) for d in range(len(docs)) for i in range(len(docs[d][1]))]
    gone = {key: set() for key, _ in docs}
    for n, (d, i) in enumerate(places):
        for e, j in places[:n]:
            a, b = docs[d][1][i:], docs[e][1][j:]
            run = []
            for x, y in zip(a, b, strict=False):
                if x[1] != y[1]:
                    break
                run.append(x)
            if sum(x[2] for x in run) >= least:
                gone[docs[d][0]] |= {x[0] for x in run}
    return gone


def test_runs_match_brute_force(spark):
    rng = random.Random(3)
    lines = ["a b c", "d e", "f", "g h i j k l", "x y z x y z x y z x", "", "  ", "A  b C"]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9)))) for k in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, "a b c\nd e\nf\nx y z x y z x y z x"), (103, " ".join(["long"] * 5000) + "\nend")]
    gone = brute(rows, 10)
    df = spark.createDataFrame([(d, t, "s", 1) for d, t in rows], SCHEMA)
    out = line_dedup.deduplicated(df, 10)
    assert out.columns == ["doc_id", "text", "source", "extra", "removed_lines"]
    got = {r.doc_id: (r.text, r.removed_lines) for r in out.collect()}
    assert len(got) == len(rows) and sum(n for _, n in got.values()) > 50
    for d, t in rows:
        if t is None:
            assert got[d] == (None, 0)
            continue
        drop = gone.get((d, t), set())
        assert got[d] == ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop), len(drop)), d


def test_first_position_with_other_lines_around(spark):
    """Runs that a fingerprint's first position doesn't hold are found at their own first positions."""
    rng = random.Random(8)
    lines = [f"m{k} n{k} o{k}" for k in range(6)] + ["the common line of all documents"]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randint(2, 8)))) for k in range(120)]
    gone = brute(rows, 12)
    got = {r.doc_id: r.removed_lines for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), 12).collect()}
    assert got == {d: len(gone[(d, t)]) for d, t in rows}


def test_one_long_line_and_short_lines(spark):
    passage = " ".join(f"w{k}" for k in range(51))
    df = spark.createDataFrame([(1, f"head\n{passage}\ntail"), (2, f"other\n{passage}\nend"), (3, "head\ntail")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(df).collect()}
    assert got == {1: f"head\n{passage}\ntail", 2: "other\nend", 3: "head\ntail"}


def test_repeated_rows_and_empty_table(spark):
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in line_dedup.deduplicated(df).collect()) == [(1, text), (1, text), (2, "")]
    assert line_dedup.deduplicated(df.limit(0)).count() == 0
