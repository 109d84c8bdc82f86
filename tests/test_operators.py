"""What a query over the tables can't show: edge cases, files, streams."""

from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from duecall.functions import dates as D
from duecall.functions import text as T
from duecall.functions.parse import described, parse, shifted
from duecall.operators import deadlines, lookup, merge, search, upserts
from duecall.sources import paging, parsers, sinks, tables
from duecall.streaming import windows

NOW = datetime(2030, 1, 31, 12)


def test_parse_bounds_types_and_terms():
    s = parse("Trusted only journals on graph databases with at least two weeks away", NOW)
    assert s.types == ["journal", "special-issue"] and s.trusted and s.least == datetime(2030, 2, 14, 12)
    assert s.terms == ["graph", "databases"]
    assert described(s) == "topic: graph databases · type: journal or special issue · deadline on/after Feb 14, 2030 · trusted only"


def test_parse_dates_override_durations_and_roll_over():
    s = parse("workshops within 3 months before March 1 2030", NOW)
    assert s.most == datetime(2030, 3, 1) and s.types == ["workshop"]
    assert parse("after January 5", NOW).least == datetime(2031, 1, 5)
    assert parse("under 10 days", NOW).before == datetime(2030, 2, 10, 12)
    assert parse("after February 30 2030", NOW).least == datetime(2030, 3, 2) and parse("after February 32 2030", NOW).least is None
    assert parse("propose a workshop", NOW).types == ["workshop-proposal"]
    assert parse("", NOW).terms == []
    assert described(parse("rolling calls in less than 2 days", NOW)) == "deadline before Feb 2, 2030 · rolling calls only"
    assert parse("before march 2030", NOW).most == datetime(2030, 3, 20)


@pytest.mark.parametrize(
    ("asked", "terms", "concepts", "types"),
    [
        ("My work is on trustworthy AI and XAI", ["trustworthy", "ai", "xai"], ["trustworthy AI"], []),
        ("calls for papers interested in NLP", ["papers", "nlp"], ["natural language processing"], []),
        ("explainable", ["explainable"], [], []),
        ("workshops on AI with a deadline at least one week away", ["ai"], [], ["workshop"]),
        ("rolling book proposals about AI", ["ai"], [], ["book-proposal"]),
        ("privacy-preserving HTML5, C++ & c#", ["privacy-preserving", "html5", "c++", "c#"], ["cybersecurity", "machine learning"], []),
        ("Médical AI, É 7 x", ["medical", "ai", "7"], ["AI for health"], []),
        ("review papers on computer vision", ["computer", "vision"], ["computer vision"], ["reviewer-call"]),
    ],
)
def test_parse_terms_and_concepts(asked, terms, concepts, types):
    s = parse(asked, NOW)
    assert (s.terms, sorted(s.concepts), s.types) == (terms, sorted(concepts), types)


def test_days_that_a_month_lacks_run_on():
    assert shifted(NOW, 1, "month") == datetime(2030, 3, 3, 12)
    assert shifted(NOW, 1, "year") == datetime(2031, 1, 31, 12)
    assert shifted(datetime(2030, 11, 30), 1, "month") == datetime(2030, 12, 30)


@given(st.integers(-5, 20_000))
def test_cursor_round_trip(n):
    assert search.decode_cursor(search.encode_cursor(n)) == (n if 0 <= n <= 10_000 else 0)


@given(st.text(max_size=30))
def test_bad_cursors_are_zero(x):
    assert search.decode_cursor(x) >= 0


@settings(deadline=None)
@given(st.lists(st.integers(0, 100), max_size=30), st.integers(1, 40), st.integers(1, 3))
def test_rate_fold_in_pieces(times, width, limit):
    times.sort()
    whole, *_ = windows.folded(times, None, 0, width, limit)
    half = len(times) // 2
    a, start, count = windows.folded(times[:half], None, 0, width, limit)
    b, *_ = windows.folded(times[half:], start, count, width, limit)
    assert a + b == whole


def test_folding_and_urls(spark):
    row = spark.createDataFrame([("Ｃafé ﬁt",)], "t string").select(T.folded("t")).first()
    assert row[0] == "Cafe fit"
    cases = [("x", "https://a.b/c/d?q"), ("/x", "https://a.b/c/d"), ("?y", "https://a.b/c"), ("//z.org", "https://a.b"), ("mailto:x", "https://a.b"), ("x", "https://a.b"), ("http://q", "https://a.b")]
    got = [r[0] for r in spark.createDataFrame(cases, "h string, b string").select(T.resolved(F.col("h"), F.col("b"))).collect()]
    assert got == ["https://a.b/c/x", "https://a.b/x", "https://a.b/c?y", "https://z.org", None, "https://a.b/x", "http://q"]


def test_ordered_union(spark):
    row = spark.createDataFrame([(["b", "a"], ["c", "a"]), (None, ["x"])], "a array<string>, b array<string>").select(upserts.unique_union(F.col("a"), F.col("b")).alias("u")).collect()
    assert [r.u for r in row] == [["b", "a", "c"], ["x"]]


def test_fold_prefers_the_richer_and_keeps_order(spark):
    rows = [("k", 1, 1, 2.0, None, ["a"]), ("k", 2, 2, 2.0, "two", ["b"]), ("k", 3, 3, 5.0, None, ["c", "a"]), ("z", 4, 4, 1.0, None, None)]
    df = spark.createDataFrame(rows, "key string, id long, ord long, rich double, note string, tags array<string>")
    unique, gone = merge.folded(df, "key", "id", "ord", "rich", ["note"], ["tags"])
    got = {r.key: r for r in unique.collect()}
    assert (got["k"].id, got["k"].note, got["k"].tags, got["k"].deduplicated_from) == (3, "two", ["c", "a", "b"], [1, 2])
    assert got["z"].id == 4 and got["z"].tags == []
    assert {(r.id, r.duplicate_of) for r in gone.collect()} == {(1, 3), (2, 3)}


def test_diversity_chooses_out_of_all_rows(spark):
    rows = [("v", k, ["a"] if k < 60 else ["b"] if k < 63 else ["a", "c"], round(1 - k / 1000, 4), 2000, f"t{k:02}") for k in range(70)]
    rows += [("w", 100 + k, [["x"], ["y"], ["x", "y"], None][k % 4], round(0.5 - k // 8 / 10, 4), 2000, f"t{k:02}") for k in range(40)]
    df = spark.createDataFrame(rows, "venue string, id long, topics array<string>, score double, year int, title string")
    got = {}
    for r in search.diversified(df, "venue", 9).orderBy("ord").collect():
        got.setdefault(r.venue, []).append(r.id)
    for venue in "vw":
        left = sorted((r for r in rows if r[0] == venue), key=lambda r: (-r[3], -r[4], r[5], r[1]))
        used, want = {}, []
        while left and len(want) < 9:
            left.sort(key=lambda r: -(r[3] + 0.7 * max([0.2, *(1 / (1 + used.get(t, 0)) for t in r[2] or [])])))
            row = left.pop(0)
            want.append(row[1])
            for t in row[2] or []:
                used[t] = used.get(t, 0) + 1
        assert got[venue] == want
    assert got["v"][1] == 60


def test_bibtex_strings_and_braces():
    (kind, key, fields), = parsers.bibtex_entries('@misc{x, a = {b {c} d}, e = "f, g", h = 12 }')
    assert (kind, key, fields) == ("misc", "x", {"a": "b {c} d", "e": "f, g", "h": "12"})


def test_stores_and_sinks(spark, tmp_path):
    missing = tables.json_store(spark, f"{tmp_path}/none.json")
    assert missing.count() == 0 and missing.schema == tables.CALL
    (tmp_path / "s.json").write_text('{"updatedAt": "x", "items": [{"id": "a", "topics": ["t"]}, {"id": "b", "extra": 1}]}')
    assert [r.id for r in tables.json_store(spark, f"{tmp_path}/s.json").collect()] == ["a", "b"]
    (tmp_path / "bad.json").write_text("{")
    assert tables.json_store(spark, f"{tmp_path}/bad.json").count() == 0

    df = spark.createDataFrame([("v1", 1, 2000), ("v1", 2, 2001), ("v2", 3, 2000)], "venue_id string, id long, year int")
    path = f"{tmp_path}/shards"
    sinks.shards(df, path, only_changed=False)
    sinks.upserted(spark, path, spark.createDataFrame([("v1", 2, 2030), ("v3", 4, 2031)], "venue_id string, id long, year int"), "id")
    assert sorted((r.venue_id, r.id, r.year) for r in spark.read.parquet(path).collect()) == [("v1", 1, 2000), ("v1", 2, 2030), ("v2", 3, 2000), ("v3", 4, 2031)]
    shard = tables.venue_shard(spark, path, "v1")
    assert shard.count() == 2 and "PartitionFilters: [isnotnull(venue_id" in shard._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        tables.venue_shard(spark, path, "../x")

    for v in ("1", "2"):
        sinks.snapshot(df.filter(F.col("id") <= int(v)), f"{tmp_path}/snap", v)
    assert sinks.current(spark, f"{tmp_path}/snap").count() == 2
    assert '"count": 3' in sinks.response(df)


def test_rate_limit_on_a_stream(spark, tmp_path):
    rows = [(k, 1, datetime(2030, 1, 1, 0, s // 60, s % 60)) for k, s in enumerate([0, 5, 20, 70])]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = windows.rate_limited_stream(stream, "user_id", 60, 2).writeStream.format("memory").queryName("rates").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90)
        got = {r.event_id: r.allowed for r in spark.table("rates").collect()}
    finally:
        q.stop()
    assert got == {0: True, 1: True, 2: False, 3: True}


def test_watermarked_windows_on_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", datetime(2030, 1, 1, 0, 10), 1.0), (2, "a", datetime(2030, 1, 1, 3), 2.0)], "event_id long, event_type string, ts timestamp, value double")
    df.write.parquet(f"{tmp_path}/in")
    out = windows.tumbling(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    q = out.writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90)
        assert [r.n for r in spark.table("hours").collect()] == [1]
    finally:
        q.stop()


def test_search_from_a_string(spark):
    """Any phrase of any concept keeps a row; accents fold; the constraint, expansion and boosts as told."""
    rows = [
        (1, "conference", "graph privacy", "a paper on Café privacy"),
        (2, "conference", "systems", "cryptography in clouds"),
        (3, "conference", "poetry", "nothing of the kind"),
        (4, "workshop", "privacy", "privacy privacy"),
    ]
    df = spark.createDataFrame(rows, "id long, type string, high string, body string")
    df = df.select("id", "type", F.lit(None).cast("timestamp_ntz").alias("deadline"), F.lit(False).alias("rolling"), F.lit(True).alias("official"), T.search_text(F.col("high")).alias("_high"), T.search_text(F.col("body")).alias("_body"))
    found, q = search.searched(df, "conferences on privacy", NOW)
    assert q.types == ["conference"] and q.concepts.keys() == {"cybersecurity"}
    assert [r.id for r in found.collect()] == [1, 2]
    assert [r.id for r in search.searched(df, "cafe", NOW)[0].collect()] == [1]
    assert parse("after Jan 5", NOW).least == datetime(2031, 1, 5) and not parse("a verified result", NOW).trusted
    assert parse("in less than 2 weeks", NOW).before == datetime(2030, 2, 14, 12)
    assert parse("trusted venues on x", NOW).trusted


def test_dates_in_text(spark):
    text = """Paper submission deadline: Apr 14, 2030.
Hot-off-the-press and late breaking paper submission deadline: June 3rd, 2030.
Main paper camera-ready deadline: 30 July. AOE) Full papers due: Friday, 31 May 2030 (11:59 p.m. Anywhere on Earth). Notification: June 1, 2030 and registration by June 2"""
    now = F.lit("2030-05-20 12:00:00").cast("timestamp_ntz")
    rows = deadlines.tracks(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "Submission of copyright forms, 3 May 2030. Abstract, 1 June 2030. Commitment: June 1 2030")], "id long, text string"), now).collect()
    got = {(r.type, str(r.date)) for r in rows}
    assert got == {("late_breaking_submission", "2030-06-03 23:59:00"), ("camera_ready", "2030-07-30 23:59:00"), ("main_submission", "2030-06-01 11:59:00"), ("notification", "2030-06-01 23:59:00"), ("notification", "2030-06-02 23:59:00"), ("registration", "2030-06-01 23:59:00"), ("registration", "2030-06-02 23:59:00")}
    assert [r.type for r in rows if r.chosen] == ["main_submission"] and {r.id for r in rows} == {1}
    due = spark.createDataFrame([("Due 3 Sept 2030 at 07:59 Pacific Daylight Time</b>",), ("Open for Submissions",)], "t string").select(D.due_text(F.col("t")).alias("d")).collect()
    assert [r.d for r in due] == [datetime(2030, 9, 3, 14, 59), None]


def test_ranks(spark):
    ranks = spark.createDataFrame([("Australasian B",), ("National: USA",), ("A*",), ("Q9",), (None,)], "r string").select(lookup.rank_group(F.col("r"), {"Q9": "C"}).alias("g")).collect()
    assert [r.g for r in ranks] == ["B", "unranked", "A*", "C", "unranked"]
    catalogue = spark.createDataFrame([(1, "DUP", "First Venue", "A"), (2, "DUP", "Second Venue", "B"), (3, "TWO 2029", "Alpha Data", "B"), (4, "TWO", "Beta Data", "Australasian B")], "ord long, acronym string, title string, rank string").withColumn("source", F.lit("s"))
    calls = spark.createDataFrame([(1, "conference", "Dup 2030", "Unknown Things"), (2, "conference", "dup", "the second venue"), (3, None, "TWO", "Gamma Data"), (4, "journal", "TWO", "Beta Data"), (5, None, "none", "x")], "id long, type string, acronym string, name string")
    got = {r.id: (r.rank, r.rank_raw) for r in lookup.ranked(calls, catalogue, "id", "acronym", "name", "type").collect()}
    assert got == {1: (None, None), 2: ("B", "B"), 3: ("B", "B"), 4: (None, None), 5: (None, None)}


def test_fold_as_a_loop_where_richness_rises(spark):
    import random

    rng = random.Random(7)
    rows = [(k // 9, k, rng.choice([None, "c"]), rng.choice([None, "u"]), [rng.choice("pqr")], rng.random() < 0.1) for k in range(180)]
    df = spark.createDataFrame(rows, "key long, id long, cfp string, url string, topics array<string>, confirmed boolean")
    rich = lambda x: merge.richness([x["cfp"], x["url"]], x["topics"], x["confirmed"], F.lit(False), F.lit(False))
    unique, gone = merge.folded(df, "key", "id", "id", rich, ["cfp", "url", "confirmed"], ["topics"])
    got = {r.key: (r.id, r.cfp, r.url, r.topics, r.deduplicated_from, r.n_merged) for r in unique.collect()}
    points = lambda r: (r[1] is not None) + (r[2] is not None) + len(r[3]) / 2 + 5 * r[4]
    steps = set()
    for key in got:
        now, absorbed = None, set()
        for _, *r in (x for x in rows if x[0] == key):
            if now is None:
                now = r
                continue
            a, b = (r, now) if points(r) > points(now) else (now, r)
            steps.add((b[0], a[0]))
            absorbed |= {b[0]}
            now = [a[0], a[1] or b[1], a[2] or b[2], list(dict.fromkeys(a[3] + b[3])), a[4]]
        assert got[key] == (now[0], now[1], now[2], now[3], sorted(absorbed), 9)
    assert {(r.id, r.merged_into) for r in gone.collect()} == steps


def test_entity_merge_loses_no_group(spark):
    cards = [(k, None, f"t{k % 4}", "abc", 2030, False, False, True, False, "old") for k in range(6)]
    cards += [(10, "g1", "x", "abc", 2030, True, False, True, False, "old"), (11, None, "y", "abc", 2030, False, True, False, False, "old"), (12, None, "z", "abc", 2030, False, False, True, True, "old")]
    groups = [("g1", "q", "abc", 2030, "a"), ("g2", "t0", "abc", 2030, "b"), ("g3", "t0", "abc", 2030, "c")] + [(f"h{k}", "", "abc", 2030, "d") for k in range(7)]
    c = spark.createDataFrame(cards, "card_id long, group_id string, title_key string, acronym string, year int, mirrored boolean, from_live boolean, active boolean, organizer boolean, track string")
    g = spark.createDataFrame(groups, "group_id string, title_key string, acronym string, year int, track string")
    out = merge.entity_merge(c, g, ["track"], complete=False).collect()
    assert sum(r.n_groups for r in out) == len(groups)
    by_card = {r.card_id: (r.group_id, r.stage, r.n_groups, r.track) for r in out if r.card_id is not None}
    assert by_card[0] == ("g3", "title", 2, "c") and by_card[10] == ("g1", "id", 1, "a") and 11 not in by_card and 12 not in by_card
    assert sum(r.stage == "fuzzy" for r in out) == 5 and sum(r.stage == "new" for r in out) == 2


def test_pages_of_a_source():
    pages = {"*": (list(range(3)), "a"), "a": (list(range(3)), "b"), "b": ([1], "c")}
    assert [len(x) for x in paging.cursor_pages(lambda c, n: pages[c], 3)] == [3, 3, 1]
    assert len(list(paging.cursor_pages(lambda c, n: ([0] * n, "*"), 3))) == 1
    assert len(list(paging.cursor_pages(lambda c, n: ([0] * n, c + "x"), 3, wanted=4))) == 2
    with pytest.raises(OverflowError):
        list(paging.cursor_pages(lambda c, n: ([0] * n, c + "x"), 3, 5))
    with pytest.raises(OverflowError):
        paging.complete([1, 2], 2)


def test_upsert_moves_a_key(spark, tmp_path):
    path = f"{tmp_path}/moves"
    sinks.shards(spark.createDataFrame([("v1", 1, 2000), ("v2", 2, 2000)], "venue_id string, id long, year int"), path, only_changed=False)
    sinks.upserted(spark, path, spark.createDataFrame([("v2", 1, 2030)], "venue_id string, id long, year int"), "id")
    assert sorted((r.venue_id, r.id, r.year) for r in spark.read.parquet(path).collect()) == [("v2", 1, 2030), ("v2", 2, 2000)]


def test_null_clients_are_limited(spark):
    rows = [(k, None, datetime(2030, 1, 1, 0, 0, k)) for k in range(4)]
    got = windows.rate_limited(spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp"), ["user_id"], 60, 2).collect()
    assert {r.event_id: r.allowed for r in got} == {0: True, 1: True, 2: False, 3: False}


def test_assertions_headers_and_identifiers(spark):
    rows = spark.createDataFrame([(1,), (2,)], "n long")
    assert upserts.asserted(rows, F.col("n") > 0, F.lit("bad")).count() == 2
    with pytest.raises(Exception, match="row 2"):
        upserts.asserted(rows, F.col("n") < 2, F.concat(F.lit("row "), F.col("n").cast("string"))).collect()
    assert "s-maxage=300" in sinks.headers("catalogue")["Cache-Control"] and sinks.headers("search")["Cache-Control"] == "no-store"
    got = spark.createDataFrame([("0000-0001-5109-3700",), ("0000-0001-5109-3701",), ("0000-0002-9079-593x",), ("x",), (None,)], "t string").select(T.orcid(F.col("t")).alias("o")).collect()
    assert [r.o for r in got] == ["0000-0001-5109-3700", None, "0000-0002-9079-593X", None, None]
