"""Pages out of a stored order: a page reads the ranges that hold it, and nothing is sorted or counted anew.

Build: the rows are range-partitioned by (group, order), each range is sorted and written as a folder, and
a small table holds how many rows of each group every range has and how many of the group's rows come before it.
A page of a group at an offset is found in that table; only its ranges are read, of which one or two
hold a page, and the total comes from the table.

Offsets and limits are clamped as the API does: limits from 1 to 50, offsets beyond 10,000 or below 0 are 0. The order must
end in a column that tells rows apart, so ties keep their place on all pages. A null group is a group. An empty table
gives no pages, nor does an offset beyond the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duecall.sources.staging import shared_path

MOST, LAST = 50, 10_000


@dataclass(frozen=True)
class Pages:
    rows: DataFrame
    ranges: DataFrame
    group: str


def build(rows: DataFrame, group: str, order: list[tuple[str, bool]], ranges: int, path: str | None = None) -> Pages:
    """rows, stored by group and by the columns of order, each with whether it descends; about as many ranges as said."""
    spark = rows.sparkSession
    path = path or shared_path(spark, "pages")
    keys = [F.col(group).asc_nulls_first(), *(F.col(c).desc() if down else F.col(c).asc() for c, down in order)]
    dealt = rows.repartitionByRange(ranges, *keys).withColumn("range", F.spark_partition_id()).sortWithinPartitions("range", *keys)
    dealt.withColumn("place", F.monotonically_increasing_id()).write.partitionBy("range").parquet(f"{path}/rows")
    stored = spark.read.schema(dealt.drop("range").schema.add("place", T.LongType()).add("range", T.IntegerType())).parquet(f"{path}/rows")
    counts = stored.groupBy(group, "range").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    by = Window.partitionBy(group).orderBy("range")
    table = counts.select(group, "range", "n", "first", (F.sum("n").over(by) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(group)).alias("total"))
    table.write.parquet(f"{path}/ranges")
    return read(spark, path, group, stored.schema, table.schema)


def read(spark: SparkSession, path: str, group: str, rows: object = None, ranges: object = None) -> Pages:
    of = lambda name, schema: (spark.read.schema(schema) if schema else spark.read).parquet(f"{path}/{name}")
    return Pages(of("rows", rows), of("ranges", ranges), group)


def clamped(offset: int, limit: int) -> tuple[int, int]:
    return offset if 0 <= offset <= LAST else 0, min(MOST, max(1, limit))


def _cut(pages: Pages, hits: DataFrame) -> DataFrame:
    """The rows of hits (group, range, first, before, total, offset, limit), each with its place in the group's order."""
    g = pages.group
    hits = hits.withColumnRenamed(g, "_g").withColumnRenamed("range", "_range")
    rows = pages.rows.join(hits, F.col(g).eqNullSafe(F.col("_g")) & (F.col("range") == F.col("_range")))
    rows = rows.withColumn("ord", F.col("before") + F.col("place") - F.col("first") + 1).filter((F.col("ord") > F.col("offset")) & (F.col("ord") <= F.col("offset") + F.col("limit")))
    after = F.when(F.col("total") > F.col("offset") + F.col("limit"), F.col("offset") + F.col("limit"))
    names = [c for c in pages.rows.columns if c not in ("range", "place")]
    return rows.select(*names, "offset", "ord", "total", after.alias("next_offset"))


def _hits(pages: Pages, requests: DataFrame) -> DataFrame:
    g = pages.group
    asked = requests.withColumnRenamed(g, "_g")
    met = pages.ranges.join(asked, F.col(g).eqNullSafe(F.col("_g"))).drop("_g")
    return met.filter((F.col("before") < F.col("offset") + F.col("limit")) & (F.col("before") + F.col("n") > F.col("offset")))


def many(pages: Pages, requests: DataFrame) -> DataFrame:
    """The pages of requests (group, offset long, limit long), all at once."""
    return _cut(pages, _hits(pages, requests))


def page(pages: Pages, group: object, offset: int, limit: int) -> DataFrame:
    """One page: the folders of its ranges alone are read."""
    offset, limit = clamped(offset, limit)
    spark, kind = pages.rows.sparkSession, pages.rows.schema[pages.group].dataType.simpleString()
    hits = _hits(pages, spark.createDataFrame([(group, offset, limit)], f"{pages.group} {kind}, offset long, limit long"))
    return _cut(Pages(pages.rows.filter(F.col("range").isin(holding(hits))), pages.ranges, pages.group), hits)


def holding(hits: DataFrame) -> list[int]:
    """The ranges that hold a page: as many as its rows at most."""
    return sorted(r["range"] for r in hits.select("range").collect())
