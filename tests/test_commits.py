"""The ten tables' commits: replaced children, foreign keys, pinned readers, a writer that dies, and two at once."""

import pytest

from duecall.sources import commits

SCHEMAS = {
    "venues": "id string, name string", "venue_aliases": "venue_id string, alias string", "venue_external_ids": "venue_id string, provider string, external_id string",
    "venue_editions": "id string, venue_id string, year int", "papers": "id string, title string", "paper_authors": "paper_id string, author_position int, author_name string",
    "paper_external_ids": "paper_id string, provider string, external_id string", "edition_papers": "edition_id string, paper_id string, status string",
    "venue_insights": "venue_id string, papers long", "ingestion_runs": "provider string, state string",
}


def frames(spark, **rows):
    return {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in rows.items()}


def state(spark, folder, number=None):
    v = commits.Version(spark, folder, number)
    return {k: sorted(tuple(r) for r in v.table(k).collect()) for k in SCHEMAS if k in v.tables}


FIRST = {
    "venues": [("v1", "One"), ("v2", "Two")], "venue_aliases": [("v1", "a"), ("v1", "b"), ("v2", "c")], "venue_external_ids": [("v1", "dblp", "x")],
    "venue_editions": [("e1", "v1", 2001), ("e2", "v1", 2002), ("e3", "v2", 2001)], "papers": [("p1", "P1"), ("p2", "P2"), ("p3", "P3")],
    "paper_authors": [("p1", 1, "Ann"), ("p1", 2, "Bob"), ("p2", 1, "Cy")], "paper_external_ids": [("p1", "doi", "10.1/x")],
    "edition_papers": [("e1", "p1", "in"), ("e2", "p2", "in"), ("e3", "p3", "in")], "venue_insights": [("v1", 2), ("v2", 1)], "ingestion_runs": [("sync", "complete")],
}


def test_commits(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/history"
    assert commits.commit(spark, folder, frames(spark, **FIRST)) == 1
    assert state(spark, folder) == {k: sorted(v) for k, v in FIRST.items()}
    pinned = commits.Version(spark, folder)
    untouched = dict(pinned.tables["papers"]["shards"])

    second = {"venues": [("v1", "One!"), ("v3", "Three")], "venue_aliases": [("v1", "z")], "venue_editions": [("e1", "v1", 2001), ("e9", "v3", 2009)], "papers": [("p2", "P2!")], "paper_authors": [("p2", 1, "Di")], "edition_papers": [("e1", "p2", "in"), ("e9", "p1", "in")], "ingestion_runs": [("sync", "again")]}
    assert commits.commit(spark, folder, frames(spark, **second)) == 2
    want = {
        "venues": [("v1", "One!"), ("v2", "Two"), ("v3", "Three")], "venue_aliases": [("v1", "z"), ("v2", "c")], "venue_external_ids": [],
        "venue_editions": [("e1", "v1", 2001), ("e3", "v2", 2001), ("e9", "v3", 2009)], "papers": [("p1", "P1"), ("p2", "P2!"), ("p3", "P3")],
        "paper_authors": [("p1", 1, "Ann"), ("p1", 2, "Bob"), ("p2", 1, "Di")], "paper_external_ids": [("p1", "doi", "10.1/x")],
        "edition_papers": [("e1", "p2", "in"), ("e3", "p3", "in"), ("e9", "p1", "in")], "venue_insights": [("v1", 2), ("v2", 1)], "ingestion_runs": [("sync", "again"), ("sync", "complete")],
    }
    assert state(spark, folder) == want
    assert state(spark, folder, 1) == {k: sorted(v) for k, v in FIRST.items()} and sorted(r.name for r in pinned.table("venues").collect()) == ["One", "Two"]
    now = commits.Version(spark, folder).tables["papers"]["shards"]
    assert sum(now[k] == untouched[k] for k in untouched) >= len(untouched) - 1

    for bad in ({"edition_papers": [("e1", "nowhere", "in")]}, {"venue_aliases": [("v9", "x")]}, {"papers": [(None, "x")]}):
        with pytest.raises(ValueError, match="isn't in|null in"):
            commits.commit(spark, folder, frames(spark, **bad))
    with monkeypatch.context() as m:
        m.setattr(commits, "publish", lambda *a: 1 / 0)  # the writer dies when all files are written
        with pytest.raises(ZeroDivisionError):
            commits.commit(spark, folder, frames(spark, venues=[("v1", "lost")]))
    assert state(spark, folder) == want

    def other(*a, of=commits.check):  # another writer commits between this one's read and its publish
        monkeypatch.setattr(commits, "check", of)
        commits.commit(spark, folder, frames(spark, venue_insights=[("v1", 7)]))
        of(*a)

    monkeypatch.setattr(commits, "check", other)
    with pytest.raises(commits.Conflict):
        commits.commit(spark, folder, frames(spark, venues=[("v1", "late")]))
    assert state(spark, folder) == want | {"venue_insights": [("v1", 7), ("v2", 1)]}
