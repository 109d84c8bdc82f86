"""Readers: typed tables, JSON stores, venue shards, layered configs; and proxy views over the synthetic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXTS = "id type name acronym domain publisher source status callStatus deadline closesAt expiresAt proposalDeadline url cfpUrl officialCfpUrl".split()
CALL = T.StructType(
    [T.StructField(c, T.StringType()) for c in _TEXTS]
    + [T.StructField("topics", T.ArrayType(T.StringType())), T.StructField("rolling", T.BooleanType()), T.StructField("deadlineTBD", T.BooleanType())]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out if it comes in fewer pieces than there are cores, as a small file does; a large
    table is left as it is. For queries that compute much for each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def json_store(spark: SparkSession, path: str, item: T.StructType = CALL) -> DataFrame:
    """The items of a JSON envelope {updatedAt, source, items[]}; a missing or broken file gives no rows of the same schema."""
    if not _exists(spark, path):
        return spark.createDataFrame([], item)
    envelope = T.StructType([T.StructField("updatedAt", T.StringType()), T.StructField("source", T.StringType()), T.StructField("items", T.ArrayType(item))])
    rows = spark.read.schema(envelope).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return rows.select(F.inline("items"))


def venue_shard(spark: SparkSession, path: str, venue_id: str) -> DataFrame:
    """One venue's rows of a table partitioned by venue_id: other partitions aren't listed or read."""
    import re

    if not re.fullmatch(r"[a-z0-9]+(?:-[a-z0-9]+)*", venue_id):
        raise ValueError(f"not a venue id: {venue_id!r}")
    return spark.read.parquet(path).filter(F.col("venue_id") == venue_id)


def layered(generated: DataFrame, manual: DataFrame, key: str, order: str) -> DataFrame:
    """generated rows overridden by manual rows of the same key; an overridden row keeps its place, new ones come after."""
    both = generated.withColumn("_layer", F.lit(0)).unionByName(manual.withColumn("_layer", F.lit(1)))
    by_key = Window.partitionBy(key)
    first = by_key.orderBy("_layer", order)
    both = both.withColumns({"_place": F.first(F.struct("_layer", order)).over(first), "_n": F.row_number().over(by_key.orderBy(F.desc("_layer"), F.desc(order)))})
    return both.filter("_n = 1").orderBy("_place").drop("_n", "_layer", "_place")


def freshest(database: DataFrame, snapshot: DataFrame, key: str, stamp: str) -> DataFrame:
    """For each key the database row if it is at least as new as the snapshot's, or there is none; else the snapshot's."""
    both = database.withColumn("origin", F.lit("database")).unionByName(snapshot.withColumn("origin", F.lit("snapshot")))
    w = Window.partitionBy(key).orderBy(F.col(stamp).desc_nulls_last(), "origin")
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


NOW = "1998-06-01 00:00:00"
# Which call type and status an order stands for.
TYPES = {"1-URGENT": "conference", "2-HIGH": "workshop", "3-MEDIUM": "journal", "4-NOT SPECIFIED": "special-issue", "5-LOW": "book-proposal"}


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as calls: the order's date is the deadline, its priority the type; low priority is rolling."""
    o = table(spark, sf_dir, "orders")
    kind = F.coalesce(*(F.when(F.col("o_orderpriority") == k, F.lit(v)) for k, v in TYPES.items()), F.lit("conference"))
    rolling = F.col("o_orderpriority") == "5-LOW"
    return o.select(
        F.col("o_orderkey").alias("id"),
        kind.alias("type"),
        F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "P", "tentative").otherwise("open").alias("status"),
        F.when(~rolling, F.col("o_orderdate")).alias("deadline"),
        F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderdate")).alias("expires_at"),
        rolling.alias("rolling"),
        (F.col("o_orderkey") % 11 == 0).alias("deadline_tbd"),
        F.when(F.col("o_orderkey") % 5 == 0, "seed").otherwise("agent").alias("source"),
        (F.col("o_orderkey") % 3 == 0).alias("official"),
        F.col("o_custkey").alias("venue"),
        F.col("o_totalprice").alias("score"),
    )


CALLS_SQL = """calls AS (SELECT o_orderkey AS id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'conference' WHEN '2-HIGH' THEN 'workshop' WHEN '3-MEDIUM' THEN 'journal' WHEN '4-NOT SPECIFIED' THEN 'special-issue' WHEN '5-LOW' THEN 'book-proposal' ELSE 'conference' END AS type,
  CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'P' THEN 'tentative' ELSE 'open' END AS status,
  CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS deadline, CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate END AS expires_at,
  o_orderpriority = '5-LOW' AS rolling, o_orderkey % 11 = 0 AS deadline_tbd, CASE WHEN o_orderkey % 5 = 0 THEN 'seed' ELSE 'agent' END AS source,
  o_orderkey % 3 = 0 AS official, o_custkey AS venue, o_totalprice AS score FROM orders)"""


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts as papers: the name's words are topics, the type the method, the brand the venue, the price the citations."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        F.split("p_name", " ").alias("topics"),
        F.col("p_type").alias("method"),
        F.col("p_brand").alias("venue"),
        (1990 + F.col("p_size") % 30).cast("long").alias("year"),
        F.round(F.col("p_retailprice")).cast("long").alias("citations"),
        F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("https://papers.example.org/"), F.col("p_partkey").cast("string"))).alias("open_url"),
    )


PAPERS_SQL = """papers AS (SELECT p_partkey AS id, p_name AS title, string_split(p_name, ' ') AS topics, p_type AS method, p_brand AS venue,
  (1990 + p_size % 30)::BIGINT AS year, round(p_retailprice)::BIGINT AS citations,
  CASE WHEN p_partkey % 4 <> 0 THEN 'https://papers.example.org/' || p_partkey END AS open_url FROM part)"""
