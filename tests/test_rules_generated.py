"""Rules on generated inputs against plain Python: taxonomy, domains, deadline labels, titles, query strings."""

import random
import re
from datetime import datetime, timedelta

from duecall.functions import taxonomy
from duecall.functions import text as T
from duecall.functions.parse import NUMBERS, parse
from duecall.operators import deadlines, merge
from duecall.plans.rules import DOMAINS
from pyspark.sql import functions as F

RNG = random.Random(11)


def made(words, n, most=8):
    return [" ".join(RNG.choice(words) + RNG.choice(["", "", "s", ",", "-"]) for _ in range(RNG.randint(0, most))) for _ in range(n)]


def pieces(rules):
    return sorted({re.sub(r"\\b|\(\?:|[()?+*\\]", "", x).replace("[- ]", "-").replace(".", " ") for _, p, *_ in rules for x in p.split("|")} | {"Poetry", "and", "of", "Zebra", "x"})


def test_taxonomy_and_domains(spark):
    rows = [(k, a, b) for k, (a, b) in enumerate(zip(made(pieces(taxonomy.TOPICS), 400), made(pieces(taxonomy.METHODS), 400), strict=True))] + [(900, None, "robot"), (901, "EEG", None), (902, None, None), (903, "vision " * 5000, "")]
    got = spark.createDataFrame(rows, "id int, a string, b string").select("id", taxonomy.classified(F.col("a"), F.col("b")).alias("c")).select("id", "c.*").collect()
    texts = {k: (f"{a or ''} {b or ''}".lower(), b or "") for k, a, b in rows}
    for r in got:
        text, body = texts[r.id]
        assert r.topics == [n for n, p in taxonomy.TOPICS if re.search(p, text)] and r.methods == [n for n, p in taxonomy.METHODS if re.search(p, text)], text
        assert r.evidence == ("title-and-abstract" if body else "title-only")
    areas = made(pieces(DOMAINS), 400, 3)
    found = spark.createDataFrame([(k, x) for k, x in enumerate(areas)], "id int, t string").select("id", T.ruled(F.lower("t"), DOMAINS, "Other").alias("d")).collect()
    assert {r.id: r.d for r in found} == {k: next((n for n, p in DOMAINS if re.search(p, x.lower())), "Other") for k, x in enumerate(areas)}


def test_deadline_labels(spark):
    words = "main track|full-paper|paper|submission deadline|papers are due|submissions due|abstract|registration|deadline|late breaking|hot off the press|demo|workshop|ARR commitment|direct submission|challenge|shared task|camera-ready|final manuscript|notification|acceptance notice|author|meeting".split("|")
    texts = made(words, 600, 6)

    def twin(low):
        met = list(dict.fromkeys(n for n, p, _ in deadlines.TRACKS if re.search(p, low)))
        for names in deadlines.SPECIFIC:
            if own := [n for n in met if n in names]:
                return sorted(own)
        return sorted(met)

    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string").select("id", deadlines.labels(F.lower("t")).alias("x")).collect()
    assert {r.id: sorted(x.type for x in r.x) for r in got} == {k: twin(t.lower()) for k, t in enumerate(texts)}


def test_base_titles(spark):
    words = [*merge.MODIFIERS, "Big Data", "x", "A", "(", ")", ":", " - ", ",", "Xposters", "track"]
    texts = ["".join(RNG.choice(words) + RNG.choice(["", " ", "  "]) for _ in range(RNG.randint(0, 9))) for _ in range(2000)]
    tail = "|".join(m.replace(" ", "[ ]+") for m in merge.MODIFIERS)
    whole = re.compile(rf"(?i)(?:(?:^|[ ]+|[ ]*[-:,(]+[ ]*)(?:{tail})[ )]*)+$")
    want = {k: whole.sub("", re.sub("[ \t\r\n]+", " ", t).strip(" ")).strip(" ") for k, t in enumerate(texts)}
    got = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", merge.base_title(F.col("t")).alias("b")).collect()
    assert {r.id: r.b for r in got} == want
    long = spark.createDataFrame([("Big " + "posters " * 100_000,)], "t string").select(merge.base_title(F.col("t")).alias("b")).first()
    assert long.b == "Big"


def test_spoken_bounds():
    now = datetime(2030, 5, 15, 12)
    for _ in range(500):
        word, n = RNG.choice([*NUMBERS.items(), *((str(k), k) for k in range(1, 40))])
        unit = RNG.choice(["day", "week"])
        end = now + timedelta(days=n * (7 if unit == "week" else 1))
        how = RNG.choice(["at least", "minimum of", "within", "in the next", "under", "less than"])
        s = parse(f"Workshops {how} {word} {unit}{RNG.choice(['', 's'])} on graphs", now)
        assert (s.least, s.most, s.before) == {"at least": (end, None, None), "minimum of": (end, None, None), "within": (None, end, None), "in the next": (None, end, None)}.get(how, (None, None, end)), s
        assert s.types == ["workshop"] and s.terms == ["graphs"]
