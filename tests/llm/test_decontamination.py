import hashlib
import random
import re

from duecall.llm import decontamination as dc

LETTERS = "abcdefgh"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute(docs, items):
    """(doc_id, n_words, n_hit, items) of each row, by comparing all windows."""
    known = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            known.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in known}:
            for i in range(len(w) - n + 1):
                if own := known.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((doc, len(w), len(hit), sorted(found)))
    return out


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def got(spark, docs, items):
    key = lambda x: (x[0] is None, *map(str, x))
    rows = dc.scanned(*frames(spark, docs, items)).collect()
    assert sorted(((r.doc_id, r.leaks.n_words, r.leaks.n_hit, r["leaks"]["items"]) for r in rows), key=key) == sorted(brute(docs, items), key=key)
    return rows


def test_as_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(300)] + ["É", "Ñandú", "A1"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([10, 11, 14, 40, 60]))) for k in range(60)]
    items += [(100, items[0][1]), (101, items[0][1].upper()), (100, items[1][1]), (102, None), (103, ""), (104, "..."), (None, items[2][1]), (105, "zz yy xx"), (106, "w1"), (107, "q " * 30)]
    docs = []
    for k in range(150):
        own = items[rng.randrange(60)][1].split()
        at = rng.randrange(max(1, len(own) - 9))
        part = own[at : at + rng.choice([8, 9, 10, 12, 60])]
        docs.append((k, f"{text(rng.randrange(40))} {', '.join(part)}\n{text(rng.randrange(1200))}"))
    docs += [(200, None), (201, ""), (202, "Zz-yy xx!"), (203, "q " * 700), (3, docs[3][1]), (3, docs[3][1]), (204, "w1"), (None, items[2][1]), (205, " ".join(i[1] or "" for i in items) * 3)]
    rows = got(spark, docs, items)
    assert sum(r.leaks.n_hit > 9 for r in rows) > 80


def test_windows_at_every_place_of_a_block(spark):
    """A passage at each place around the border of two blocks is found whole."""
    passage = [f"p{k}" for k in range(10)]
    docs = [(k, " ".join([f"x{j}" for j in range(dc.BLOCK - 15 + k)] + passage + ["end"])) for k in range(30)]
    assert {r.leaks.n_hit for r in got(spark, docs, [(1, " ".join(passage))])} == {10}


def test_long_text_full_of_items(spark):
    item = " ".join(f"a{k}" for k in range(50))
    rows = got(spark, [(1, " ".join([item] * 3000))], [(1, item)])
    assert rows[0].leaks.n_hit == 150_000


def test_shuffled_path(spark, monkeypatch):
    rng = random.Random(2)
    items = [(k, " ".join(rng.choice(LETTERS) for _ in range(30))) for k in range(20)]
    docs = [(k, items[k % 20][1] + " x " + items[k % 7][1][:50]) for k in range(60)]
    want = sorted(map(str, got(spark, docs, items)))
    monkeypatch.setattr(dc, "BROADCAST", 3)
    assert sorted(map(str, got(spark, docs, items))) == want


def test_clean_empty_and_clashes(spark):
    item = " ".join(f"a{k}" for k in range(12))
    docs = spark.createDataFrame([(1, item, "x"), (2, "b " + item[3:20], "y"), (3, None, "z")], "doc_id long, text string, leaks string")
    items = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert sorted(dc.clean(docs, items).collect()) == [(2, "b " + item[3:20], "y"), (3, None, "z")]
    assert dc.scanned(docs, items).columns == ["doc_id", "text", "leaks"]
    assert dc.scanned(docs.limit(0), items).count() == 0 and dc.clean(docs, items.limit(0)).count() == 3


def test_query_digests(spark, tmp_path):
    docs, items = frames(spark, [(1, "a b c"), (2, "x")], [(10, "a b"), (9, "b c"), (8, "c")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted(dc.query(spark, str(tmp_path)).collect()) == [(1, 3, 3, 3, sha("10,8,9"), True), (2, 1, 0, 0, sha(""), False)]
