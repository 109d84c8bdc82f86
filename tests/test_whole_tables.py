"""Queries over whole tables whose ids lie beyond any fixed range."""

import duckdb
import pytest

from compare import same
from duecall.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    """Parts and vectors of the smallest tables, their ids 50,003 higher."""
    d, con = str(tmp_path_factory.mktemp("shifted")), duckdb.connect()
    for t, key in (("part", "p_partkey"), ("embeddings", "vec_id")):
        con.execute(f"COPY (SELECT * REPLACE ({key} + 50003 AS {key}) FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')) TO '{d}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    return d, con


def test_similarity_of_all_names(spark, shifted):
    d, con = shifted
    df = QUERIES["similarity_family_all"](spark, d)
    same(df, con, ORACLES["similarity_family_all"])
    pairs = con.execute("SELECT count(*) FROM (SELECT DISTINCT a.p_name, b.p_name FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_name < b.p_name)").fetchone()[0]
    assert df.count() == pairs > 0


def test_merge_of_all_cards_and_groups(spark, shifted):
    d, con = shifted
    df = QUERIES["entity_merge_all"](spark, d)
    same(df, con, ORACLES["entity_merge_all"])
    cards = [r.card_id for r in df.collect() if r.card_id is not None]
    assert sorted(cards) == [50003 + k for k in range(200)]
    assert {r.stage for r in df.select("stage").distinct().collect()} == {"id", "title", "fuzzy", "new", "kept"}


def test_registry_match_of_all_names(spark, shifted):
    d, con = shifted
    same(QUERIES["argmax_registry_all"](spark, d), con, ORACLES["argmax_registry_all"])
    rows = con.execute("SELECT p_partkey, p_brand, p_name FROM part ORDER BY 1").fetchall()
    registry_rows = [(rows[k + 1][1], rows[k][2]) for k in range(len(rows) - 1)]
    want = {(b, n) for _, b, n in rows if any(b == rb and set(n.split()) & set(rn.split()) for rb, rn in registry_rows)}
    assert {(r.brand, r.name) for r in QUERIES["argmax_registry_all"](spark, d).collect()} == want and want


def test_cosine_of_every_fiftieth(spark, shifted):
    d, con = shifted
    df = QUERIES["extra_cosine_all"](spark, d)
    same(df, con, ORACLES["extra_cosine_all"])
    got = df.groupBy("q").count().collect()
    assert len(got) == 10 and all(r.q % 50 == 0 and r["count"] == 10 for r in got)
