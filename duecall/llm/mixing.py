"""Mixing sources to target weights along a time-varying curriculum.

Each source has a share of the training tokens and a schedule: how its weight runs
over training time 0 to 1, piecewise linear. The integral of the schedule is the
source's cumulative demand. A document's place among its source's words, in a fixed
random order, is inverted through that demand into a training position, and the
documents are range-sorted by position.

Targets: sources share ``share`` times all words by weight; none gets more than
``most`` times its own words, and what is cut goes to the others by weight. A source
whose target exceeds its words is gone through again from the start; the document at
which its target ends counts with the words up to there, so that a source's words
come within one of its target.

A null text has no words; a null source is a source of its own, last in order. Rows
equal in doc_id and text are each placed by themselves, as often as they repeat.
A document without words takes none. An empty table gives no rows. Extra columns,
whatever their names, pass through ``training_order``; of rows equal in doc_id and text it takes
the least by the other columns (any, where a column is a map and has no order).

``sources`` has windows over one row for each source in one task: sources are few by
the nature of a mix. Texts are read once; what follows works on a written table of sizes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duecall.llm.common import ROW, documents, n_words, packed, text_key, unpacked, written

#: A source's documents are dealt over this many buckets by their random order: words
#: before a document are those of earlier buckets plus those before it in its own.
BUCKETS_HEX = 3


@dataclass(frozen=True)
class Mixture:
    """weights repeat over the sources in order; schedules, as (time, height) knots from 0 to 1, likewise."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most: int = 2
    schedules: tuple[tuple[tuple[float, float], ...], ...] = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (1.0, 0.5)))
    seed: str = "mix-1"


def pick(values: tuple, rank: Column) -> Column:
    """values[(rank - 1) mod n]."""
    return F.get(F.array(*map(F.lit, values)), F.pmod(rank - 1, F.lit(len(values))).cast("int"))


def sources(docs: DataFrame, mix: Mixture) -> DataFrame:
    """(source, source_size, weight, rank, target): one row a source, so windows over all of them stay small.

    With the sources by words a weight unit, the first k fill to their limit, and the rest
    share what is left by weight. What they get a weight unit rises with k up to the first k
    for which none of the rest is above, and falls from there on: that is the largest.
    """
    found = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = found.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    found = found.withColumn("weight", pick(mix.weights, F.col("rank")))
    full = F.col("source_size") * mix.most
    by_room = Window.orderBy((full / F.col("weight")).asc(), "rank")
    found = found.withColumns(
        {
            "_before": F.coalesce(F.sum(full).over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_weights": F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)),
            "_all": F.sum("source_size").over(Window.partitionBy()) * mix.share,
        }
    )
    level = (F.col("_all") - F.col("_before")) / F.col("_weights")
    level = F.max(F.when(level * F.col("weight") <= full, level)).over(Window.partitionBy())
    found = found.withColumn("_level", level)
    target = F.coalesce(F.least(full.cast("double"), F.col("_level") * F.col("weight")), full.cast("double"))
    return found.select("source", "source_size", "weight", "rank", target.alias("target"))


def position(done: Column, rank: Column, mix: Mixture) -> Column:
    """The training time at which the share ``done`` of a source's demand is met: the inverse of its schedule's integral."""

    def inverse(knots: tuple[tuple[float, float], ...]) -> Column:
        areas = [(t1 - t0) * (h0 + h1) / 2 for (t0, h0), (t1, h1) in zip(knots, knots[1:], strict=False)]
        need, before, out = done * sum(areas), 0.0, F.lit(1.0)
        pieces = []
        for ((t0, h0), (t1, h1)), area in zip(zip(knots, knots[1:], strict=False), areas, strict=True):
            rest, slope = need - before, (h1 - h0) / (t1 - t0)
            t = t0 + (rest / h0 if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), h0 * h0 + 2 * slope * rest)) - h0) / slope)
            pieces.append((before + area, t))
            before += area
        for end, t in reversed(pieces):
            out = F.when(need <= end, t).otherwise(out)
        return F.round(F.least(out, F.lit(1.0)), 9)

    which = F.pmod(rank - 1, F.lit(len(mix.schedules)))
    out = inverse(mix.schedules[-1])
    for k, knots in list(enumerate(mix.schedules))[:-1]:
        out = F.when(which == k, inverse(knots)).otherwise(out)
    return out


def mixed(docs: DataFrame, mix: Mixture = Mixture()) -> DataFrame:
    """(doc_id, text, source) -> (doc_id, tkey, source, size, source_size, target, taken, placements):
    placements has (copy, position, words) for each time that the document is taken.

    Only sizes are shuffled, never texts. The shuffle is by source and bucket, so a source
    with a third of all documents is spread over thousands of keys.
    """
    order = F.md5(F.concat_ws("\x1f", F.lit(mix.seed), F.col("doc_id").cast("string")).cast("binary"))
    slim = docs.select("doc_id", text_key(F.col("text")).alias("tkey"), "source", n_words(F.col("text")).alias("size"), order.alias("_order"))
    slim = written(slim.withColumn("_bucket", F.substring("_order", 1, BUCKETS_HEX)), "sizes")
    per_source = sources(slim, mix)
    buckets = slim.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_earlier", F.coalesce(F.sum("_words").over(earlier), F.lit(0))).drop("_words")
    buckets = buckets.join(per_source.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    buckets = buckets.withColumnsRenamed({"source": "_s", "_bucket": "_b"})
    joined = slim.join(buckets, (F.col("_bucket") == F.col("_b")) & F.col("source").eqNullSafe(F.col("_s")))
    within = Window.partitionBy("source", "_bucket").orderBy("_order", "doc_id", "size", "tkey").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_earlier") + F.coalesce(F.sum("size").over(within), F.lit(0))
    joined = joined.withColumn("_start", start)
    wanted = F.floor(F.col("target") + 0.5)
    copies = []
    for k in range(mix.most):
        at = F.col("_start") + F.col("source_size") * k
        done = F.when(F.col("target") > 0, at / F.col("target")).otherwise(0.0)
        copies.append(F.struct(F.lit(k).alias("copy"), position(done, F.col("rank"), mix).alias("position"), F.greatest(F.lit(0), F.least(wanted - at, F.col("size"))).cast("long").alias("words")))
    joined = joined.withColumn("placements", F.filter(F.array(*copies), lambda c: c["words"] > 0))
    taken = F.aggregate("placements", F.lit(0).cast("long"), lambda n, c: n + c["words"])
    return joined.select("doc_id", "tkey", "source", "size", "source_size", "target", taken.alias("taken"), "placements")


def curriculum(docs: DataFrame, mix: Mixture = Mixture()) -> DataFrame:
    """One row each time that a document is taken, range-sorted by position: (position, copy, words, doc_id, tkey, source)."""
    rows = mixed(docs, mix).select("doc_id", "tkey", "source", F.inline("placements"))
    return rows.repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy")


def training_order(docs: DataFrame, mix: Mixture = Mixture()) -> DataFrame:
    """docs, all columns, each row as often as the mix takes it, in training order. A
    document at which a source's target ends is there whole; rows equal in doc_id and text each at their own places."""
    places = mixed(docs.select("doc_id", "text", "source"), mix).select(F.col("doc_id").isNull().alias("n"), F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("tkey").alias("k"), F.inline("placements"))
    doc_id = F.col("doc_id")
    rows = packed(docs, n=doc_id.isNull(), d=F.coalesce(doc_id, F.lit(0)), k=text_key(F.col("text")))
    one = F.first(ROW) if "map<" in rows.schema[ROW].dataType.simpleString() else F.min(ROW)
    rows = rows.groupBy("n", "d", "k").agg(one.alias(ROW)).join(places, ["n", "d", "k"])
    order = ("position", "n", "d", "copy")
    return unpacked(rows.repartitionByRange(*order).sortWithinPartitions(*order), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(documents(spark, sf_dir))
    first = F.get("placements", F.lit(0))["position"]
    out = out.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position"))
    return out.repartitionByRange(F.col("first_position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("first_position").asc_nulls_last(), "doc_id")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1' || chr(31) || doc_id::VARCHAR) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM d GROUP BY source),
w AS (SELECT *, CASE (rnk - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
l AS (SELECT *, coalesce(sum(source_size * 2) OVER (ORDER BY source_size * 2 / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS bef,
         sum(weight) OVER (ORDER BY source_size * 2 / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS ws,
         (sum(source_size) OVER ())::DOUBLE * 1.5 AS total FROM w),
v AS (SELECT *, max(CASE WHEN (total - bef) / ws * weight <= source_size * 2 THEN (total - bef) / ws END) OVER () AS lvl FROM l),
t AS (SELECT source, source_size, rnk, coalesce(least((source_size * 2)::DOUBLE, lvl * weight), (source_size * 2)::DOUBLE) AS target FROM v),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.rnk,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, greatest(0, least(floor(target + 0.5)::BIGINT - st, size)) AS w0, greatest(0, least(floor(target + 0.5)::BIGINT - (st + source_size), size)) AS w1 FROM p),
f AS (SELECT *, CASE WHEN w0 > 0 THEN st WHEN w1 > 0 THEN st + source_size END / target AS done FROM c)
SELECT doc_id, size, source_size, target, (w0 + w1)::BIGINT AS taken,
  CASE WHEN done IS NOT NULL THEN round(least(CASE WHEN (rnk - 1) % 2 = 0 THEN (sqrt(0.25::DOUBLE + 2 * done) - 0.5::DOUBLE) ELSE 1.5::DOUBLE - sqrt(greatest(0::DOUBLE, 2.25::DOUBLE - 2 * done)) END, 1::DOUBLE), 9) END AS first_position
FROM f
"""
