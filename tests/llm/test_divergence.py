import random
import re
from collections import Counter, defaultdict

from duecall.llm import divergence as dv

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, top):
    counts, seen = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        found = WORD.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(found)
        seen[lang or ""].update(set(found))
    out = []
    for lang in {k[0] for k in counts}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        own = {s: {t: c[t] for t in kept} for (k, s), c in counts.items() if k == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        shares, q = {s: share(c) for s, c in own.items()}, share(whole)
        for s, p in shares.items():
            pairs = [(sum(abs(p[t] - o[t]) for t in kept), x) for x, o in shares.items() if x != s]
            terms = [(p[t] - q[t], t) for t in kept if own[s][t] and p[t] > q[t]]
            for part, rows, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                rows = sorted(rows, key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, s, part, x, v, k + 1) for k, (v, x) in enumerate(rows[:most])]
    return sorted(out)


def check(spark, docs, least, top):
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "text string, lang string, source string, term string, n int")
    got = sorted(tuple(r) for r in dv.divergence(df, least, top).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute(docs, least, top)
    return got


def test_as_brute_force_in_shards(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(dv, "SHARD_ROWS", 40)
    monkeypatch.setattr(dv, "PAIRS", 7)
    monkeypatch.setattr(dv, "BATCH_BYTES", 2000)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(120)] + ["É", "ñ", "Big", "BIG", "x\U0001f600"]
    docs = []
    for k in range(300):
        lang = rng.choice(["en", "en", "de", None, ""])
        n = rng.choice([0, 1, 5, 40])
        docs.append((" ".join(words[int(rng.random() ** 2 * len(words))] for _ in range(n)) + rng.choice(["", ".\n\t7x-y\x00z"]), lang, rng.choice(["a", "a", "a", "b", "c", "d é", None])))
    docs += [("lone words only here", "xx", "s1"), (None, "xx", "s2"), ("", "xx", "s3"), ("one source", "yy", "s")] + [docs[0]] * 40
    got = check(spark, docs, 10, 5)
    assert any(r[2] == "term" for r in got) and [r[4] for r in got if r[0] == "xx"] == [0] * 6 and not [r for r in got if r[0] == "yy"]


def test_ties_long_texts_and_least(spark):
    docs = [("a b c d " * 50_000, "en", "s"), ("a b", "en", "t"), ("c d", "en", "u"), ("c d", "en", "v")]
    for least in (1, 2, 3, 99):
        check(spark, docs, least, 2)


def test_empty_table(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert dv.divergence(df).count() == 0
