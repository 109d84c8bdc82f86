"""JSON stores that are read again only where their files changed, and broken ones."""

import json
import os

from duecall.sources import stores


def put(path, items, at):
    path.write_text(items if isinstance(items, str) else json.dumps({"updatedAt": "x", "source": "s", "items": items}))
    os.utime(path, (at, at))


def test_changed_broken_and_gone(spark, tmp_path):
    folder, cache = tmp_path / "stores", f"file://{tmp_path}/cache"
    look = lambda: stores.refreshed(spark, f"file://{folder}", cache)

    def found():
        rows, states = look()
        name = lambda p: p.rsplit("/", 1)[1]
        return sorted((r.id, name(r.path)) for r in rows.collect()), {name(r.path): r.state for r in states.collect()}

    assert found() == ([], {})
    folder.mkdir()
    put(folder / "a.json", [{"id": "1", "topics": ["x"]}, {"id": "2"}], 1000)
    put(folder / "b.json", [{"id": "3"}], 1000)
    put(folder / "c.json", "{broken", 1000)
    (folder / "notes.txt").write_text("no store")
    first = ([("1", "a.json"), ("2", "a.json"), ("3", "b.json")], {"a.json": "read", "b.json": "read", "c.json": "broken"})
    assert found() == first
    put(folder / "a.json", [{"id": "9"}], 1000)  # the same time: it isn't opened
    put(folder / "b.json", '{"items": [{"id": "4"', 2000)
    assert found() == (first[0], {"a.json": "same", "b.json": "broken", "c.json": "broken"})
    put(folder / "c.json", [{"id": "5"}], 3000)
    put(folder / "b.json", [{"id": "6"}], 3000)
    (folder / "a.json").unlink()
    assert found() == ([("5", "c.json"), ("6", "b.json")], {"b.json": "read", "c.json": "read"})
    assert found()[1] == {"b.json": "same", "c.json": "same"}
