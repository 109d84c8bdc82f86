"""Sinks: atomic snapshots, partitioned shards, upserts of partitions, manifests."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from duecall.sources.staging import written


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def moved(spark: SparkSession, pointer: str, version: str) -> None:
    """Points a file at a version by a rename: readers see the old one or the new one."""
    temp, fs = _fs(spark, f"{pointer}.tmp")
    out = fs.create(temp, True)
    out.write(bytearray(version.encode()))
    out.close()
    target, _ = _fs(spark, pointer)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    kind = getattr(hadoop, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri()).rename(fs.makeQualified(temp), fs.makeQualified(target), how)


def snapshot(df: DataFrame, folder: str, version: str) -> str:
    """Writes a new version beside the old ones and then moves the pointer file; readers see one or the other."""
    path = f"{folder}/v={version}"
    df.write.mode("overwrite").parquet(path)
    moved(df.sparkSession, f"{folder}/CURRENT", version)
    return path


def current(spark: SparkSession, folder: str) -> DataFrame:
    version = spark.read.text(f"{folder}/CURRENT").first()[0]
    return spark.read.parquet(f"{folder}/v={version}")


def counted(df: DataFrame, path: str, **metrics: Column) -> dict:
    """Writes a frame and returns the metrics, aggregates that are observed as its rows pass by: no second pass reads them.
    A task that runs twice may be counted twice, so they are for counters and audits, not for results."""
    seen = Observation()
    df.observe(seen, *(c.alias(k) for k, c in metrics.items())).write.parquet(path)
    return seen.get


def shards(df: DataFrame, path: str, by: str = "venue_id", only_changed: bool = True) -> None:
    """One partition for each venue; with only_changed the others stay as they are."""
    mode = "dynamic" if only_changed else "static"
    df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(by).parquet(path)


def upserted(spark: SparkSession, path: str, fresh: DataFrame, key: str, by: str = "venue_id") -> None:
    """Rewrites the partitions that fresh touches, and those that hold its keys now: their old rows
    without fresh's keys, and fresh. A key that moves leaves its old partition; one that is left empty goes."""
    stored = spark.read.parquet(path)
    held = stored.join(fresh.select(key), key, "left_semi").select(by)
    touched = written(fresh.select(by).union(held).distinct(), "touched")
    old = stored.join(touched, by, "left_semi").join(fresh.select(key), key, "left_anti")
    # the plan reads what it will overwrite, so the result is set down first
    merged = written(old.unionByName(fresh.select(*old.columns)), "merged")
    shards(merged, path, by)
    for row in touched.join(merged.select(by).distinct(), by, "left_anti").toLocalIterator():
        empty, fs = _fs(spark, f"{path}/{by}={row[0]}")
        fs.delete(empty, True)


def manifest(df: DataFrame, by: str = "venue_id") -> DataFrame:
    """What the shards hold: rows, years, newest update."""
    return df.groupBy(by).agg(F.count("*").alias("paper_count"), F.count_distinct("year").alias("edition_count"), F.min("year").alias("start_year"), F.max("year").alias("end_year"))


def response(df: DataFrame, most: int = 1000) -> str:
    """A page of rows as a JSON envelope; a page is bounded, so it may go through the driver."""
    rows = [json.loads(x) for x in df.limit(most).toJSON().collect()]
    return json.dumps({"count": len(rows), "items": rows})


#: How long, in seconds, a shared cache may keep each kind of response.
CACHED = {"catalogue": 300, "history": 3600}


def headers(kind: str) -> dict[str, str]:
    """What goes with a response: its type, and how long it may be kept; kinds that aren't listed aren't kept."""
    keep = f"public, s-maxage={CACHED[kind]}, stale-while-revalidate={2 * CACHED[kind]}" if kind in CACHED else "no-store"
    return {"Content-Type": "application/json; charset=utf-8", "Cache-Control": keep}
