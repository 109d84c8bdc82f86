"""Set maintenance between runs: replacing, upserting, archiving, selecting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duecall.sources.staging import written


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row for each key: the first in order, whatever the partitions."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def replaced(old: DataFrame, fresh: DataFrame, column: str, value: str) -> DataFrame:
    """old without the rows of one column value, and the fresh ones."""
    return old.filter(~F.col(column).eqNullSafe(F.lit(value))).unionByName(fresh)


def preserving(old: DataFrame, fresh: DataFrame, key: str, refresh: list[str]) -> DataFrame:
    """Full upsert: known rows take the columns in refresh and keep the others, new rows come whole."""
    new = fresh.withColumnsRenamed({c: f"_{c}" for c in fresh.columns})
    both = old.join(new, F.col(key) == F.col(f"_{key}"), "full")
    value = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c)) if c in refresh else F.coalesce(F.col(c), F.col(f"_{c}"))
    return both.select(*(value(c).alias(c) for c in old.columns), F.col(f"_{key}").isNotNull().alias("refreshed"))


def with_delete(old: DataFrame, fresh: DataFrame, key: str, lapsed: Column) -> DataFrame:
    """fresh has a verdict: active replaces, inactive deletes, error deletes only what has lapsed."""
    settled = fresh.filter("verdict in ('active', 'inactive')").select(key)
    failed = fresh.filter("verdict = 'error'").select(key, F.lit(True).alias("_failed"))
    kept = old.join(settled, key, "left_anti").join(failed, key, "left")
    kept = kept.filter(~(F.coalesce("_failed", F.lit(False)) & lapsed)).drop("_failed")
    return kept.unionByName(fresh.filter("verdict = 'active'").drop("verdict"))


def archive(old: DataFrame, fresh: DataFrame, collection: str, key: str) -> DataFrame:
    """Rows by "collection:key", the later run's where both have one."""
    both = old.withColumn("_run", F.lit(0)).unionByName(fresh.withColumn("_run", F.lit(1)))
    both = both.withColumn("key", F.concat(F.lit(f"{collection}:"), F.col(key).cast("string")))
    return first_by(both, ["key"], F.desc("_run")).select("key", *old.columns)


def bounded_log(log: DataFrame, most: int, *order: Column) -> DataFrame:
    """The last entries; a top-k that Spark takes from each partition's top-k."""
    return log.orderBy(*order).limit(most)


def cyclic(keys: DataFrame, key: str, cursor: int, size: int) -> DataFrame:
    """The size keys from a cursor on, around the end: (key, slot). Keys are numbered within ranges, and
    the ranges' offsets, one row each, are added: no task holds all keys."""
    placed = written(keys.select(key).repartitionByRange(key).select(key, F.spark_partition_id().alias("_p")), "ranges")
    offsets = placed.groupBy("_p").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = offsets.withColumns({"_o": before, "_m": F.sum("_c").over(Window.partitionBy())}).drop("_c")
    numbered = placed.join(offsets, "_p").withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1 + F.col("_o"))
    slot = F.pmod(F.col("_i") - F.lit(cursor) % F.col("_m"), F.col("_m"))
    return numbered.withColumn("slot", slot.cast("long")).filter(F.col("slot") < size).select(key, "slot")


def asserted(rows: DataFrame, holds: Column, said: Column) -> DataFrame:
    """rows as they are; the job fails with said at the first row for which holds isn't true."""
    return rows.filter(F.when(F.coalesce(holds, F.lit(False)), F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))


def selected(rows: DataFrame, wanted: DataFrame, key: str, types: list[str]) -> DataFrame:
    return rows.filter(F.col("type").isin(types)).join(wanted.select(key), key, "left_semi")


def must_resolve(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """(asked, found, complete): whether every wanted id has a row."""
    asked = ids.select(key).distinct()
    hit = asked.join(rows.select(key), key, "left_semi")
    return asked.agg(F.count("*").alias("asked")).crossJoin(hit.agg(F.count("*").alias("found"))).withColumn("complete", F.col("asked") == F.col("found"))


def unique_union(a: Column, b: Column) -> Column:
    """a's elements, then b's new ones, each once, in order."""
    return F.array_union(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))
