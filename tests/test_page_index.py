"""Pages out of a stored order against sorting everything for each page."""

import random
import re

from duecall.operators import page_index


def test_every_offset_as_sorting_everything(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = [(k, rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 9), rng.choice([1999, 2000])) for k in range(900)]
    df = spark.createDataFrame(rows, "id long, venue string, score int, year int")
    path = f"file://{tmp_path}/index"
    page_index.build(df, "venue", [("score", True), ("year", True), ("id", False)], 12, path)
    stored = page_index.read(spark, path, "venue")
    for venue in ("a", "b", None):
        want = [r[0] for r in sorted((r for r in rows if r[1] == venue), key=lambda r: (-r[2], -r[3], r[0]))]
        asked = spark.createDataFrame([(venue, o, 20) for o in range(0, len(want) + 40, 13)], "venue string, offset long, limit long")
        got = {}
        for r in page_index.many(stored, asked).collect():
            got.setdefault(r.offset, {})[r.ord] = r
        for o in range(0, len(want), 13):
            assert [got[o][k].id for k in sorted(got[o])] == want[o : o + 20] and sorted(got[o])[0] == o + 1
            r = got[o][o + 1]
            assert (r.total, r.next_offset) == (len(want), o + 20 if o + 20 < len(want) else None)
        assert max(got) < len(want)
    held = []
    monkeypatch.setattr(page_index, "holding", lambda hits, of=page_index.holding: held.append(of(hits)) or held[-1])
    one = page_index.page(stored, "a", 41, 500)
    assert [r.ord for r in one.orderBy("ord").collect()] == list(range(42, 92))
    plan = one._jdf.queryExecution().toString()
    assert len(held[0]) <= 2 and re.search(r"PartitionFilters: \[[^]]*range#\d+ (?:IN|=)", plan)
    assert page_index.page(stored, "a", -5, 0).first().ord == 1 and page_index.page(stored, "nowhere", 0, 10).count() == 0
    empty = page_index.build(df.limit(0), "venue", [("id", False)], 4)
    assert page_index.page(empty, "a", 0, 10).count() == 0
