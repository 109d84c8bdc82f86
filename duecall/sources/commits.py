"""Many tables in one commit: a versioned manifest names the files of each table, and a pointer names the manifest.

A commit writes new files beside the old ones, only for the shards that it touches, checks the foreign keys of
what it brings against the state it makes, writes the manifest of the next version, which fails if
another writer has made that version meanwhile, and then moves the pointer by a rename. Until then
readers see the old version whole; a writer killed anywhere before leaves it readable, and its files belong to no manifest.
A reader is pinned to one manifest, whatever is committed later.

What becomes of a table's rows is told by its rule. All rules replace: the rows whose ``owner``
columns equal those of a touched owner go, and the new rows come. An upsert's owner is its own key; a
child's is its parent, so a parent's children go and come with it; ``via`` finds the owners through another
table's old state. Rows of a table without an owner are only added. Of new rows with one key the last by ``order`` stays. Keys are
never null: such rows fail the check, as an unknown parent does. Lists of shards and versions go through the
driver: they are bounded by the number of shards, not by the rows.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duecall.sources.sinks import _fs, moved
from duecall.sources.staging import written

#: Shards of a table, tasks that write one, tables that are worked at once.
SHARDS, WRITERS, THREADS = 16, 4, 4


@dataclass(frozen=True)
class Rule:
    """key: columns that are unique. owner: columns that name what a row belongs to. touched: (table, columns) whose new rows
    name the owners that are replaced. via: (table, its owner columns, its columns) that lead from touched owners to this table's. parents: (columns, table, columns)."""

    key: tuple[str, ...]
    owner: tuple[str, ...] = ()
    touched: tuple[str, tuple[str, ...]] | None = None
    via: tuple[str, tuple[str, ...], tuple[str, ...]] | None = None
    parents: tuple[tuple[tuple[str, ...], str, tuple[str, ...]], ...] = field(default=())


#: The venue history's ten tables.
HISTORY = {
    "venues": Rule(("id",), ("id",), ("venues", ("id",))),
    "venue_aliases": Rule(("venue_id", "alias"), ("venue_id",), ("venues", ("id",)), parents=((("venue_id",), "venues", ("id",)),)),
    "venue_external_ids": Rule(("venue_id", "provider", "external_id"), ("venue_id",), ("venues", ("id",)), parents=((("venue_id",), "venues", ("id",)),)),
    "venue_editions": Rule(("id",), ("venue_id",), ("venues", ("id",)), parents=((("venue_id",), "venues", ("id",)),)),
    "papers": Rule(("id",), ("id",), ("papers", ("id",))),
    "paper_authors": Rule(("paper_id", "author_position"), ("paper_id",), ("papers", ("id",)), parents=((("paper_id",), "papers", ("id",)),)),
    "paper_external_ids": Rule(("paper_id", "provider"), ("paper_id",), ("papers", ("id",)), parents=((("paper_id",), "papers", ("id",)),)),
    "edition_papers": Rule(("edition_id", "paper_id"), ("edition_id",), ("venues", ("id",)), ("venue_editions", ("venue_id",), ("id",)), ((("edition_id",), "venue_editions", ("id",)), (("paper_id",), "papers", ("id",)))),
    "venue_insights": Rule(("venue_id",), ("venue_id",), ("venue_insights", ("venue_id",)), parents=((("venue_id",), "venues", ("id",)),)),
    "ingestion_runs": Rule((), ()),
}


class Conflict(RuntimeError):
    """Another writer has made this version."""


def _read(spark: SparkSession, path: str) -> str | None:
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


class Version:
    """One committed state; its tables stay what they are whatever is committed later."""

    def __init__(self, spark: SparkSession, folder: str, number: int | None = None) -> None:
        self.spark, self.folder = spark, folder
        self.number = int(_read(spark, f"{folder}/CURRENT") or 0) if number is None else number
        found = _read(spark, f"{folder}/manifests/{self.number:012}.json") if self.number else None
        if self.number and found is None:
            raise ValueError(f"no version {self.number}")
        self.tables = json.loads(found)["tables"] if found else {}

    def table(self, name: str, shards: list[int] | None = None) -> DataFrame | None:
        """A table, or some shards of it; None if it was never written."""
        if name not in self.tables:
            return None
        schema = T.StructType.fromJson(self.tables[name]["schema"])
        paths = [f"{self.folder}/{p}" for k, p in self.tables[name]["shards"].items() if shards is None or int(k) in shards]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def _shard(columns: tuple[str, ...]):  # noqa: ANN202
    return F.pmod(F.xxhash64(*columns), F.lit(SHARDS)).cast("int") if columns else F.lit(0)


def _owners(now: Version, new: dict[str, DataFrame], rule: Rule) -> DataFrame | None:
    """The owners whose rows go, by the rule's owner columns."""
    if not rule.touched or rule.touched[0] not in new:
        return None
    of = new[rule.touched[0]].select(*rule.touched[1]).distinct()
    if not rule.via:
        return of.toDF(*rule.owner)
    table, owner, columns = rule.via
    old = now.table(table)
    return None if old is None else old.join(of.toDF(*owner), list(owner), "left_semi").select(*columns).distinct().toDF(*rule.owner)


def commit(spark: SparkSession, folder: str, new: dict[str, DataFrame], rules: dict[str, Rule] = HISTORY, order: str | None = None) -> int:
    """Commits new rows of any of the tables as one version; returns its number."""
    now = Version(spark, folder)
    stamp = uuid.uuid4().hex[:12]
    with ThreadPoolExecutor(THREADS) as pool:  # the tables' jobs don't wait for one another
        new = dict(zip(new, pool.map(lambda x: written(last(x[1], rules[x[0]].key, order), x[0]), new.items()), strict=True))
        made = pool.map(lambda x: _rewritten(now, new, *x, stamp), rules.items())
        tables = now.tables | {name: entry for name, entry in zip(rules, made, strict=True) if entry}
    after = Version(spark, folder, 0)
    after.tables = tables
    check(after, new, rules)
    return publish(spark, folder, now.number, tables)


def _rewritten(now: Version, new: dict[str, DataFrame], name: str, rule: Rule, stamp: str) -> dict | None:
    """Writes the shards of a table that the new rows touch; returns its entry in the manifest, or None if nothing touches it."""
    spark, folder, own = now.spark, now.folder, rule.owner
    gone = _owners(now, new, rule)
    if name not in new and (gone is None or name not in now.tables):
        return None
    entry = now.tables.get(name)
    schema = T.StructType.fromJson(entry["schema"]) if entry else T.StructType([T.StructField(f.name, f.dataType) for f in new[name].schema])
    old = {int(k): p for k, p in entry["shards"].items()} if entry else {}
    path = f"data/{name}/{now.number + 1:012}-{stamp}"
    fresh = new[name].select(*schema.names) if name in new else None
    if not own:  # added beside what is there
        fresh.write.parquet(f"{folder}/{path}/run")
        return {"schema": json.loads(schema.json()), "shards": {str(k): p for k, p in old.items()} | {str(now.number + 1): f"{path}/run"}}
    gone = None if gone is None else written(gone, f"{name}-owners")
    parts = [df.select(_shard(own).alias("s")) for df in (fresh, gone) if df is not None]
    touched = sorted({r[0] for df in parts for r in df.distinct().collect()})  # SHARDS at most
    rows = now.table(name, touched) if entry else None
    if rows is not None and gone is not None:
        rows = rows.join(gone, list(own), "left_anti")
    if rows is not None and fresh is not None and own != rule.key:  # rows of an owner that isn't touched are upserted by key
        rows = rows.join(fresh.select(*rule.key), list(rule.key), "left_anti")
    every = fresh if rows is None else rows.select(*schema.names) if fresh is None else rows.select(*schema.names).unionByName(fresh)
    every.withColumn("shard", _shard(own)).repartition("shard", F.pmod(F.hash(*rule.key), F.lit(WRITERS))).write.partitionBy("shard").parquet(f"{folder}/{path}")
    p, fs = _fs(spark, f"{folder}/{path}")
    made = [int(x.getPath().getName().removeprefix("shard=")) for x in fs.listStatus(p) if x.getPath().getName().startswith("shard=")]
    return {"schema": json.loads(schema.json()), "shards": {str(k): q for k, q in old.items() if k not in touched} | {str(k): f"{path}/shard={k}" for k in made}}


def last(df: DataFrame, key: tuple[str, ...], order: str | None) -> DataFrame:
    if not key:
        return df
    if not order or order not in df.columns:
        return df.dropDuplicates(list(key))
    by = Window.partitionBy(*key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def check(after: Version, new: dict[str, DataFrame], rules: dict[str, Rule]) -> None:
    """Raises ValueError for a new row with a null key or a parent that isn't there."""
    def one(x: tuple[str, DataFrame]) -> str | None:
        name, df = x
        keys = rules[name].key
        if keys and not df.filter(reduce(Column.__or__, (F.col(c).isNull() for c in keys))).isEmpty():
            return f"{name}: null in {', '.join(keys)}"
        for columns, parent, theirs in rules[name].parents:
            known = after.table(parent)
            lost = df if known is None else df.join(known.select(*theirs).toDF(*columns), list(columns), "left_anti")
            if not lost.isEmpty():
                return f"{name}: {', '.join(columns)} isn't in {parent}"
        return None

    with ThreadPoolExecutor(THREADS) as pool:
        for said in pool.map(one, new.items()):
            if said:
                raise ValueError(said)


def publish(spark: SparkSession, folder: str, base: int, tables: dict) -> int:
    """Writes the manifest of version base + 1, unless there is one, and moves the pointer to it."""
    path, fs = _fs(spark, f"{folder}/manifests/{base + 1:012}.json")
    try:
        out = fs.create(path, False)
    except Exception as e:  # py4j wraps the file system's own error
        raise Conflict(f"version {base + 1} is taken") from e
    out.write(bytearray(json.dumps({"version": base + 1, "base": base, "tables": tables}).encode()))
    out.close()
    moved(spark, f"{folder}/CURRENT", str(base + 1))
    return base + 1
