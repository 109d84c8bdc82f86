"""Queries on rows that the small tables lack: numbers that look like years, many ids."""

import duckdb
import pytest

from compare import same
from duecall.functions import text as T
from duecall.operators import deadlines, merge, vectors
from duecall.plans import registry
from pyspark.sql import functions as F

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
SMALL = "/root/testdata/sf0.001"


def copied(tmp_path, **tables):
    """The folder and DuckDB's view of tables made by SQL; ``{t}`` stands for the small table t."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t, sql in tables.items():
        con.execute(f"COPY ({sql.format(t=f"read_parquet('{SMALL}/{t}.parquet')")}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    return str(tmp_path), con


def test_baseline_of_many_ids(spark, tmp_path):
    d, con = copied(tmp_path, supplier="SELECT * REPLACE (range AS s_suppkey) FROM {t}, range(20100) WHERE s_suppkey = 0")
    same(QUERIES["baseline_validated"](spark, d), con, ORACLES["baseline_validated"])


@pytest.fixture(scope="module")
def years(tmp_path_factory):
    """Venues and acronyms numbered 1900 to 2099, which look like years."""
    return copied(
        tmp_path_factory.mktemp("years"),
        orders="SELECT * REPLACE (o_custkey % 200 + 1900 AS o_custkey) FROM {t}",
        part="SELECT * REPLACE (p_partkey * 6 + 11400 AS p_partkey) FROM {t}",
        supplier="SELECT * REPLACE (range AS s_suppkey) FROM {t}, range(1900, 2100) WHERE s_suppkey = 0",
        customer="SELECT * REPLACE (range AS c_custkey) FROM {t}, range(3800, 4200) WHERE c_custkey = 0",
        lineitem="SELECT * REPLACE (l_suppkey % 200 + 1900 AS l_suppkey) FROM {t}",
    )


def test_keys_of_names_with_numbers(spark, years):
    d, con = years
    same(QUERIES["identity_keys"](spark, d), con, ORACLES["identity_keys"])
    names = [("Fair of 1927, 2030", "fair of 1927"), ("Fair_2068 2030", "fair 2068"), ("Fair 2068", "fair")]
    df = spark.createDataFrame([(n,) for n, _ in names], "name string")
    none = F.lit(None).cast("string")
    got = df.select(merge.identity_key(F.lit("journal"), F.col("name"), none, none.cast("timestamp_ntz"), F.lit(False)).alias("key")).collect()
    assert [r.key for r in got] == [f"journal|name:{key}|rolling" for _, key in names]
    assert [r.t for r in df.select(T.name_text(F.col("name"), years=False).alias("t")).collect()] == ["fair of", "fair 2068", "fair"]


def test_secondary_store_of_numbered_venues(spark, years):
    d, con = years
    same(QUERIES["secondary_store_scan"](spark, d), con, ORACLES["secondary_store_scan"])


def test_catalogue_of_numbered_acronyms(spark, years):
    d, con = years
    same(QUERIES["catalogue_read"](spark, d), con, ORACLES["catalogue_read"])


def test_each_page_text_is_read_once(spark, monkeypatch):
    texts = ["Paper submission deadline: 3 May 2030.", "Abstract deadline: 1 May 2030. Notification: 2 June 2030.", None, "Nothing."]
    pages = [(k, texts[k % 4]) for k in range(400)] + [(0, texts[1]), (1, texts[1]), (None, texts[0]), (None, texts[1])]
    seen, whole = [], deadlines.read
    monkeypatch.setattr(deadlines, "read", lambda t, now: seen.append(t.count()) or whole(t, now))
    now = F.lit("2030-03-01 00:00:00").cast("timestamp_ntz")
    got = deadlines.tracks(spark.createDataFrame(pages, "id long, text string"), now).collect()
    assert seen == [3]
    rows = {}
    for r in got:
        rows.setdefault(r.id, []).append((r.type, r.date.day, r.chosen))
    main, abstract, notice = ("main_submission", 3), ("abstract_submission", 1), ("notification", 2)
    assert sorted(rows[0]) == sorted(rows[None]) == sorted([(*main, True), (*abstract, False), (*notice, False)])
    assert all(sorted(rows[k]) == [(*abstract, True), (*notice, False)] for k in range(1, 400, 4))
    assert all(rows[k] == [(*main, True)] for k in range(4, 400, 4)) and set(rows) == {None, *range(0, 400, 4), *range(1, 400, 4)}


def test_nearest_with_ties_nulls_and_several_blocks(spark, tmp_path, monkeypatch):
    """Copies, null and zero vectors, and more vectors than a block: as the SQL."""
    monkeypatch.setattr(vectors, "BLOCK", 16)
    bad = "CASE WHEN vec_id = 150 THEN NULL WHEN vec_id = 7 THEN list_transform(embedding, lambda x: 0::FLOAT) ELSE embedding END"
    d, con = copied(tmp_path, embeddings=f"SELECT vec_id + i * 1000 AS vec_id, {bad} AS embedding, label FROM {{t}}, range(3) r(i) WHERE vec_id < 200")
    same(QUERIES["extra_cosine_all"](spark, d), con, ORACLES["extra_cosine_all"])
