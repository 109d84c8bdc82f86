"""Folding against Python's own decomposition: every character of the basic and the first further plane, as normal search text."""

import re
import unicodedata

from duecall.functions import text as T
from pyspark.sql import functions as F


def plain(text):
    low = "".join(c for c in unicodedata.normalize("NFKD", text) if not "̀" <= c <= "ͯ").lower()
    return " ".join(re.sub(r"[^a-z0-9+#./-]+", " ", low).split())


def test_every_character(spark):
    points = [chr(k) for k in (*range(1, 0xD800), *range(0xE000, 0x20000)) if unicodedata.category(chr(k)) != "Cn"]
    cells = [f"a{c}b" for c in points]
    rows = [(k, "|".join(cells[k : k + 500])) for k in range(0, len(cells), 500)]
    df = spark.createDataFrame(rows, "id int, t string")
    bad = []
    for r in df.select("id", T.search_text(F.col("t")).alias("got")).collect():
        if r.got != plain(dict(rows)[r.id]):
            bad.append(r.id)
    singles = [(k, cells[k]) for i in bad for k in range(i, min(i + 500, len(cells)))]
    if singles:
        got = {r.id: r.got for r in spark.createDataFrame(singles, "id int, t string").select("id", T.search_text(F.col("t")).alias("got")).collect()}
        wrong = {hex(ord(points[k])) for k, t in singles if got[k] != plain(t)}
        assert wrong <= {"0x212a"}, sorted(wrong)[:20]


def test_whole_texts(spark):
    texts = ["Ⅷ kg ㎏ 𝐀𝐛𝐜 ½ ﬁne Å café ⑴ № ™ ﷺ", "", "plain", "Ünïcödé " * 2000 + "ﬃ", "日本 ㍿ Ａ１"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.search_text(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [plain(t) for t in texts]
