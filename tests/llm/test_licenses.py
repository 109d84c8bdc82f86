from duecall.llm import licenses


def test_scan(spark):
    pad = " ".join(f"w{k}" for k in range(100))
    rows = [
        (1, f"{pad} Licensed UNDER the apache License, version 2.0! {pad}"),
        (2, f"{pad}\n{licenses.TEMPLATES['mit-text'].replace(' to deal in', ' to trade in')} {pad}"),
        (3, f"{pad} released under*** the mit license"),
        (4, "All rights reserved."),
        (5, pad),
        (6, None),
        (7, ""),
        (8, "the license of the house, released under pressure"),
        (3, f"{pad} released under*** the mit license"),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, hashes int")
    got = {}
    for r in licenses.scanned(df).collect():
        got[r.doc_id] = {m.license for m in r.licenses}
    assert got == {1: {"apache-2.0"}, 2: {"mit-text"}, 3: {"mit"}, 4: {"all-rights-reserved"}, 5: set(), 6: set(), 7: set(), 8: set()}
    assert licenses.scanned(df.limit(0)).count() == 0
    assert all(r.licenses == [] for r in licenses.scanned(df, {}).collect())


def test_long_texts_ties_and_hundreds_of_templates(spark):
    """Against exact containment of every window, in plain Python."""
    import random

    rng = random.Random(2)
    words = [f"q{k}" for k in range(60)]
    texts = {f"t{n:03}": " ".join(rng.choice(words) for _ in range(rng.randint(2, 40))) for n in range(150)}
    long = " ".join(rng.choice(words) for _ in range(20_000))
    rows = [(n, " ".join([*(rng.choice(words) for _ in range(rng.randint(0, 30))), t, "end", t])) for n, t in enumerate(texts.values())]
    rows += [(900, long), (901, texts["t000"]), (901, texts["t000"])]
    got = {}
    for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string"), texts).collect():
        got.setdefault(r.doc_id, []).append([(m.license, m.at, round(m.containment, 6)) for m in r.licenses])
    by_name = {n: t.split() for n, t in texts.items()}
    for doc, text in dict(rows).items():
        w, want = text.split(), []
        for n, t in by_name.items():
            k = min(licenses.WIDTH, len(t))
            held = {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
            s, m = len(t) - k + 1, len(w) - k + 1
            h = [tuple(w[i : i + k]) for i in range(m)]
            for j in range(max(1, -(-m // s) - 1) if m > 0 else 0):
                share = len(set(h[j * s : j * s + 2 * s]) & held) * 100 / len(held)
                if share >= licenses.CONTAINED:
                    want.append((n, j * s, round(share, 6)))
        assert all(sorted(want) == x for x in got[doc]), doc
    assert len(got[901]) == 2 and any(x for x in got[5][0])


def test_license_wording_all_over_a_long_text(spark):
    full = licenses.TEMPLATES["mit-full"]
    n = 300_000 // len(full.split())
    rows = [(1, " ".join([full] * n)), (2, " ".join([f"x{k} All rights reserved." for k in range(75_000)]))]
    got = {r.doc_id: r for r in licenses.per_document(licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert "mit-full@0:100" in got[1].licenses and got[1].n_matches > n and got[2].n_matches >= 75_000


def test_windows_across_blocks(spark, monkeypatch):
    text = " ".join(f"w{k}" for k in range(300)) + " " + licenses.TEMPLATES["isc-full"] + " " + " ".join(f"v{k}" for k in range(200))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    want = sorted(licenses.scanned(df).first().licenses)
    for block in (1, 7, 50, 333):
        monkeypatch.setattr(licenses, "BLOCK", block)
        assert sorted(licenses.scanned(df).first().licenses) == want and want
