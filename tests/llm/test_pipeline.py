import hashlib
import random
import re

import public_tokenizers
import test_line_dedup
import test_mixing
import test_near_dup
import tokenizers

import corpus_pipeline
from compare import duck, same
from duecall.llm import line_dedup, queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == COLUMNS, name
            docs = corpus_pipeline.written(out, f"test-{k}")
            counts.append(docs.count())
        else:
            assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
            assert out.count() == counts[-1]
    assert counts[1] < counts[0] and counts[3] <= counts[2] <= counts[1] and counts[4] > 0


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_oracles(spark):
    con = duck(SF)
    for name, sql in queries.oracle_sql().items():
        same(queries.queries()[name](spark, SF), con, sql)


# The stages in plain Python.
SPLIT = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPLIT.split(text or "") if w]


def ruled(rows):
    """The documents that the quality rules keep, without their boilerplate lines."""
    held = {}
    normal = lambda x: SPLIT.sub(" ", x).strip(" ").lower()
    for _, text, source in rows:
        for x in (text or "").split("\n"):
            if normal(x):
                held.setdefault((source, normal(x)), set()).add(text)
    out = []
    for doc, text, source in rows:
        w, lines = words(text), (text or "").split("\n")
        grams = {}
        for k in range(len(w) - 7):
            grams.setdefault(tuple(w[k : k + 8]), []).append(k)
        repeated = {k + j for at in grams.values() if len(at) > 1 for k in at for j in range(8)}
        gone = [bool(normal(x)) and len(held[source, normal(x)]) > 25 for x in lines]
        left = len(w) - sum(len(words(x)) for x, g in zip(lines, gone, strict=True) if g)
        if len(w) >= 20 and 100 * len(repeated) <= 30 * len(w) and 100 * left >= 20 * len(w):
            out.append((doc, "\n".join(x for x, g in zip(lines, gone, strict=True) if not g) if any(gone) else text, source))
    return out


def without_runs(rows):
    gone = test_line_dedup.brute([r[:2] for r in rows], line_dedup.MIN_WORDS)
    out = []
    for doc, text, source in rows:
        drop = gone.get((doc, text), set())
        new = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop) if drop else text
        if not drop or words(new):
            out.append((doc, new, source))
    return out


def one_each(rows):
    kept = [r for r, (doc, _, component) in zip(rows, test_near_dup.brute([r[:2] for r in rows], 5), strict=True) if doc is None or doc == component]
    return list({r[:2]: r for r in reversed(kept)}.values())


def mixture(rows):
    """Each document as often as its source's share takes it."""
    order = sorted({s for _, _, s in rows if s is not None}) + [None] * any(s is None for _, _, s in rows)
    sizes = [sum(len(words(t)) for _, t, x in rows if x == s) for s in order]
    targets = test_mixing.filled(sizes, [(3, 1, 2)[k % 3] for k in range(len(order))], 1.5, 2)
    out = []
    for s, size, target in zip(order, sizes, targets, strict=True):
        own = sorted((r for r in rows if r[2] == s), key=lambda r: hashlib.md5("\x1f".join(["mix-1"] + [str(r[0])] * (r[0] is not None)).encode()).hexdigest())
        at = 0
        for r in own * 2:
            if words(r[1]) and at < int(target + 0.5):
                out.append(r)
            at += len(words(r[1]))
        assert size
    return out


def test_as_brute_force(spark, tmp_path):
    rng = random.Random(12)
    vocabulary = [f"v{k}" for k in range(3000)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(k, f"shared menu line\nand a second one\n{some(60)}\n{some(30)}", "a") for k in range(40)]
    passage, base = some(70), some(100).split()
    rows += [(100 + k, f"{some(40)}\n{passage}\n{some(25)}", "bc"[k % 2]) for k in range(15)]
    for k in range(15):
        copy = list(base)
        copy[rng.randrange(100)] = "changed"
        rows.append((200 + k, " ".join(copy[:50]) + "\n" + " ".join(copy[50:]), None))
    rows += [(300, None, "a"), (301, "", None), (302, some(30_000), "c"), (303, passage, "b"), (304, "a b " * 50, "b"), (305, some(25), "b"), (305, some(25), "b"), rows[3], rows[3]]
    spark.createDataFrame([(*r, "x", len(r[1] or "")) for r in rows], "doc_id long, text string, source string, position string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    kept = mixture(one_each(without_runs(ruled(rows))))
    theirs = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(r[0], theirs.encode(r[1], add_special_tokens=False).ids) for r in kept]
    want = sorted((doc, len(x), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in x)).hexdigest()) for doc, x in ids)
    assert got == want and len(ruled(rows)) < len(rows) and len({r[0] for r in kept}) < len(ruled(rows))
