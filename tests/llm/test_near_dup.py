import random

from duecall.llm import near_dup


def brute(rows, width):
    """Components by comparing all pairs of sets."""
    sets = []
    for _, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    name = list(range(len(rows)))

    def find(k):
        while name[k] != k:
            k = name[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                name[find(i)] = find(j)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(k)] = min(least.get(find(k), doc), doc)
    return [(doc, len(sets[k]), least.get(find(k))) if sets[k] else (doc, 0, doc) for k, (doc, _) in enumerate(rows)]


def test_as_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows, n = [], 1000

    def add(text):
        nonlocal n
        n -= 1
        rows.append((n, text))

    base = [rng.choice(words) for _ in range(80)]
    for _ in range(60):  # a group of near copies, many of which aren't alike among themselves
        copy = list(base)
        for _ in range(rng.randint(1, 7)):
            copy[rng.randrange(80)] = rng.choice(words)
        add(" ".join(copy))
    chain = [rng.choice(words) for _ in range(60)]
    for _ in range(15):
        chain[rng.randrange(60)] = rng.choice(words)
        add(" ".join(chain))
    for _ in range(60):
        add("the the the " + " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))))
    for text in ("", None, " \n", "One", "one", "one two", "ONE  two", "a b c d e f", "a b c d e g", "x " * 5000, "É é"):
        add(text)
    rows += [(5, rows[0][1]), (5, rows[0][1]), (None, rows[70][1]), (None, "alone in the world")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in near_dup.grouped(df.drop("key"), 2).collect())
    want = sorted((str(a), b, c) for a, b, c in brute(rows, 2))
    assert [(a, b, str(c)) for a, b, c in got] == [(a, b, str(c)) for a, b, c in want]


def test_stage_and_empty_table(spark):
    text = " ".join(f"w{k}" for k in range(100))
    rows = [(3, text, "s"), (2, text + " tail", "s"), (2, text + " tail", "s"), (9, "other words here", "t"), (None, "no id", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = near_dup.representatives(df)
    assert got.columns == df.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["2", "9", "None"]
    assert near_dup.grouped(df.limit(0), 2).count() == 0


def test_near_copies_meet_once(spark, monkeypatch):
    """Two of a large group of near copies share most of their lists, but come out of the join once."""
    rng, texts, counts, met = random.Random(7), [], [], near_dup.met
    for _ in range(300):
        words = [f"w{k}" for k in range(120)]
        for k in rng.sample(range(120), rng.randint(2, 11)):
            words[k] = f"x{rng.random()}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    monkeypatch.setattr(near_dup, "LONG_LIST", 2)
    monkeypatch.setattr(near_dup, "met", lambda left: counts.append((met(left).count(), met(left).distinct().count())) or met(left))
    got = near_dup.grouped(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 2)
    assert counts[0][0] == counts[0][1] > 0
