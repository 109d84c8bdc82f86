"""An inverted index stored as tables, and a search of many queries at once that skips what can't win.

Build: a row for each (term, record) with the term's impact, its BM25 factor without the idf:
tf (k1 + 1) / (tf + k1 (1 - b + b len / avg)). A term's postings are dealt to slices of about ``SLICE`` records, so that
no frequent term is sorted in one task, sorted by impact and packed into blocks of ``BLOCK`` with
their greatest impact. The blocks lie in ``SHARDS`` folders by the term's hash, sorted by term.

Search, for a table of queries of any size; all steps are joins on terms:
1. The first blocks of each query term give partial scores; the k-th best of a query is a bound that
   its k-th result reaches at least.
2. The terms of a query whose greatest scores together stay below the bound aren't essential: no
   record that has only such terms can win. Of the essential terms, a block is skipped if its greatest score and
   those of all other terms together stay below the bound.
3. The records in the remaining blocks are candidates as far as their score so far and
   the other terms' greatest scores reach the bound; the other terms are looked up for them only.
What is skipped can't be among the first k, so the result is that of a full scan. Scores are rounded to six
digits, and bounds leave room for that; ties go to the smaller id.

A null text has no terms. A query without terms known to the index has no results. Rows of one id are
one record, as long as the longest of them, with the terms of all. An empty table makes an index without blocks, which finds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duecall.functions.text import let
from duecall.operators.search import B, K1
from duecall.sources.staging import shared_path, written

SLICE, BLOCK, SHARDS, FIRST = 1_000_000, 128, 16, 2
ROOM = 1e-5

@dataclass(frozen=True)
class Index:
    blocks: DataFrame
    terms: DataFrame


def shard(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SHARDS)).cast("int")


def build(rows: DataFrame, high: Column, body: Column, high_weight: float, path: str | None = None) -> Index:
    """The index of rows with a column id; high and body are arrays of tokens, high counting high_weight times."""
    spark = rows.sparkSession
    path = path or shared_path(spark, "postings")
    one = lambda t, w: F.transform(t, lambda x: F.struct(x.alias("term"), F.lit(float(w)).alias("w")))
    of = lambda x: F.struct((high_weight * F.size(x["h"]) + F.size(x["b"])).cast("double").alias("len"), F.concat(one(x["h"], high_weight), one(x["b"], 1)).alias("terms"))
    taken = rows.select("id", let(F.struct(high.alias("h"), body.alias("b")), of).alias("x"))  # before the rows multiply
    counts = taken.select("id", "x.len", F.explode_outer("x.terms").alias("t")).select("id", "len", "t.term", "t.w")
    counts = written(counts.groupBy("id", "term").agg(F.sum("w").alias("tf"), F.max("len").alias("len")), "counts")
    stats = counts.groupBy("id").agg(F.max("len").alias("len")).agg(F.count("*").alias("n"), F.greatest(F.avg("len"), F.lit(1.0)).alias("avg"))
    n, avg = stats.first()
    norm = K1 * (1 - B + B * F.col("len") / F.lit(float(avg or 1)))
    terms = counts.filter("term is not null").withColumn("impact", F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).groupBy("term").agg(F.count("*").alias("df"), F.max("impact").alias("top"))
    idf = F.ln(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = terms.select("term", "df", idf.alias("idf"), "top", F.ceil(F.col("df") / SLICE).cast("int").alias("slices"), shard(F.col("term")).alias("shard"))
    terms.repartitionByRange("shard", "term").sortWithinPartitions("shard", "term").write.partitionBy("shard").parquet(f"{path}/terms")
    terms = spark.read.schema("term string, df long, idf double, top double, slices int, shard int").parquet(f"{path}/terms")
    found = counts.join(terms.select("term", "slices"), "term").select("term", "id", (F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("impact"), F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"))
    place = F.row_number().over(Window.partitionBy("term", "slice").orderBy(F.desc("impact"), "id")) - 1
    found = found.withColumn("block", F.floor(place / BLOCK).cast("int"))
    packed = found.groupBy("term", "slice", "block").agg(F.max("impact").alias("top"), F.collect_list(F.struct("id", "impact")).alias("postings"))
    packed = written(packed.withColumn("shard", shard(F.col("term"))), "packed").repartitionByRange("shard", "term", "slice", "block")
    packed.sortWithinPartitions("shard", "term", "slice", "block").write.partitionBy("shard").parquet(f"{path}/blocks")
    return read(spark, path, dict(rows.dtypes)["id"])


def read(spark: SparkSession, path: str, id_type: str = "bigint") -> Index:
    """A stored index; nothing of the records themselves is read."""
    blocks = f"term string, slice int, block int, top double, postings array<struct<id:{id_type},impact:double>>, shard int"
    return Index(spark.read.schema(blocks).parquet(f"{path}/blocks"), spark.read.schema("term string, df long, idf double, top double, slices int, shard int").parquet(f"{path}/terms"))


def first(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("q").orderBy(*order)).cast("long")).filter(F.col("ord") <= k)


def planned(index: Index, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """((q, term, v, most, bound, sum, essential) of each query term, the blocks of all these terms)."""
    asked = queries.groupBy("q", "term").agg(F.max("w").alias("w")).withColumn("shard", shard(F.col("term")))
    shards = [r[0] for r in asked.select("shard").distinct().collect()]  # SHARDS at most: other folders aren't read
    blocks, terms = index.blocks.filter(F.col("shard").isin(shards)), index.terms.filter(F.col("shard").isin(shards))
    asked = asked.join(terms.select("term", "idf", "top"), "term").select("q", "term", (F.col("w") * F.col("idf")).alias("v"), (F.col("w") * F.col("idf") * F.col("top")).alias("most"))
    asked = written(asked, "asked")
    blocks = blocks.join(asked.select("term").distinct(), "term", "left_semi")
    early = asked.join(blocks.filter(F.col("block") < FIRST).select("term", F.inline("postings")), "term").select("q", "id", F.expr("v * impact AS score"))
    early = first(early.groupBy("q", "id").agg(F.sum("score").alias("score")), k, F.desc("score"), F.col("id"))
    bound = early.filter(F.col("ord") == k).select("q", (F.col("score") - ROOM).alias("bound"))
    by = Window.partitionBy("q")
    plan = asked.join(bound, "q", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)))
    below = F.sum("most").over(by.orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0))
    return written(plan.withColumns({"sum": F.sum("most").over(by), "essential": below >= F.col("bound")}), "plan"), blocks


def reaching(plan: DataFrame, blocks: DataFrame) -> DataFrame:
    """(q, v, postings): of the essential terms the blocks that a winner may stand in."""
    reach = F.col("sum") - F.col("most") + F.col("v") * F.col("top") >= F.col("bound")
    return plan.filter("essential").join(blocks, "term").filter(reach).select("q", "v", "postings")


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """(q, id, score, ord): the k best records of each query of (q, term, w), a row for each of its terms."""
    plan, blocks = planned(index, queries, k)
    rest = plan.groupBy("q").agg(F.max("bound").alias("bound"), F.sum(F.when(~F.col("essential"), F.col("most")).otherwise(0.0)).alias("rest"))
    kept = reaching(plan, blocks).select("q", "v", F.inline("postings")).select("q", "id", F.expr("v * impact AS score"))
    found = kept.groupBy("q", "id").agg(F.sum("score").alias("score")).join(rest, "q")
    found = written(found.filter(F.col("score") + F.col("rest") >= F.col("bound")).select("q", "id", "score"), "candidates")
    others = plan.filter("not essential").select("q", "term", "v")
    lookup = blocks.join(others.select("term").distinct(), "term", "left_semi").select("term", F.inline("postings"))
    more = found.select("q", "id").join(others, "q").join(lookup, ["term", "id"]).select("q", "id", F.expr("v * impact AS score"))
    total = found.union(more).groupBy("q", "id").agg(F.round(F.sum("score"), 6).alias("score")).filter("score > 0")
    return first(total, k, F.desc("score"), F.col("id")).select("q", "id", "score", "ord")
