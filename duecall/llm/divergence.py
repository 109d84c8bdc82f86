"""Source divergence audit: DuckDB counts terms and sums pair differences shard by shard, Spark merges sums and ranks.

Terms are ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of a text in which A-Z is lower case. Of each
lang the terms in at least ``LEAST_DOCS`` of its documents are kept, V of them. A source's
smoothed share of a kept term, in parts of 10^9, is 1 + floor(10^9 (n + 5) / (N + 5 V)), n
being the term's count there and N the counts' sum. Two sources of a lang differ by the sum of
their shares' differences over all kept terms; a source differs from its lang in the terms
of which it has a greater share.

Counting: each task hands its texts to DuckDB in batches of ``BATCH_BYTES``; one SQL
statement takes them apart and counts by lang, source and term. Spark adds the counts up, so a term or a
source of any frequency is summed before and after the shuffle. Shares: the kept counts are
dealt to shards by lang and the term's hash, ``SHARD_ROWS`` each, together with the lang's list of
sources (the square root of the lang's result rows). In each shard DuckDB fills in
the sources that lack a term, sums the differences of each pair of sources, ``PAIRS`` at a time, and takes each
source's first terms. Spark adds the pairs' sums up and ranks.

All arithmetic is exact, in 128-bit integers where 64 may not do. Null text, lang and source are
read as ''. A document without a term still makes its lang and source known. Repeated rows are documents of their own.
Ties rank by item in UTF-8 order. A lang with one source has no pairs; one
without kept terms has pairs of value 0. An empty table gives no rows. Only text,
lang and source are read, so extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duecall.llm.common import documents, small_batches, written

LEAST_DOCS, TOP = 30, 50
#: Bytes of text that one SQL statement takes; kept counts a shard; pairs of sources that are summed at once.
BATCH_BYTES, SHARD_ROWS, PAIRS = 16_000_000, 100_000, 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalpha())

COUNTS = "lang string, source string, term string, n long, docs long"
#: Terms by lang and source with their documents; a row without a term for each lang and source.
COUNT_SQL = """
WITH w AS (SELECT r, lang, source, unnest(string_split(translate(text, $1, $2), ' ')) AS term FROM texts),
d AS (SELECT lang, source, term, count(*) AS n FROM w WHERE term <> '' GROUP BY r, lang, source, term)
SELECT lang, source, term, sum(n)::BIGINT AS n, count(*) AS docs FROM d GROUP BY lang, source, term
UNION ALL SELECT DISTINCT lang, source, '', 0::BIGINT, 0::BIGINT FROM texts
"""

PARTS = "part string, lang string, source string, item string, value long"
SHARE_SQL = """
CREATE TEMP TABLE shares AS
SELECT t.term, g.i, coalesce(k.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(k.n, 0) + 5)) // (g.total + 5 * g.v))::BIGINT AS p
FROM (SELECT DISTINCT term FROM kept) t CROSS JOIN sources g LEFT JOIN kept k ON k.term = t.term AND k.source = g.source
"""
PAIR_SQL = """
SELECT 'pair' AS part, a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
FROM sources a JOIN sources b ON a.i < b.i
LEFT JOIN (SELECT x.i, y.i AS j, sum(abs(x.p - y.p)) AS value FROM shares x JOIN shares y ON x.term = y.term AND x.i < y.i WHERE x.i >= $1 AND x.i < $2 GROUP BY x.i, y.i) s ON s.i = a.i AND s.j = b.i
WHERE a.i >= $1 AND a.i < $2 AND ($3 OR s.value IS NOT NULL)
"""
TERM_SQL = """
WITH q AS (SELECT term, (1 + (1000000000::HUGEINT * (sum(n) + 5)) // (any_value(g.whole) + 5 * any_value(g.v)))::BIGINT AS q FROM shares JOIN sources g USING (i) GROUP BY term)
SELECT 'term' AS part, g.lang, g.source, term AS item, p - q AS value FROM shares JOIN q USING (term) JOIN sources g USING (i)
WHERE n > 0 AND p > q QUALIFY row_number() OVER (PARTITION BY i ORDER BY p - q DESC, term) <= $1
"""


def _duck():  # noqa: ANN202
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): how often, and in how many documents, each term occurs; term '' for each lang and source."""

    def count(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows)
        with _duck() as db:
            db.register("texts", table.append_column("r", pa.array(range(table.num_rows), pa.int64())))
            yield from db.sql(COUNT_SQL, params=[_UPPER + _SEPARATORS, _LOWER + " " * len(_SEPARATORS)]).to_arrow_table().to_batches(20_000)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if held and size + b.nbytes > BATCH_BYTES:
                yield from count(held)
                held, size = [], 0
            held.append(b)
            size += b.nbytes
        if held:
            yield from count(held)

    small_batches(docs.sparkSession)
    read = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return read.mapInArrow(of, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_counts(docs: DataFrame, least: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """((lang, source, term, n) of the kept terms, (lang, source, i, total, whole, v, shards): each lang's sources with their sums)."""
    counts = written(counted(docs), "counts")
    terms = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least)
    terms = written(terms.select("lang", "term"), "terms")
    kept = written(counts.select("lang", "source", "term", "n").join(terms, ["lang", "term"]), "kept")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("whole"), F.count("*").alias("rows")).join(terms.groupBy("lang").agg(F.count("*").alias("v")), "lang")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sources = counts.filter("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    sources = sources.select(
        "lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("i"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "whole", "v")),
        F.greatest(F.lit(1), F.ceil(F.coalesce("rows", F.lit(0)) / SHARD_ROWS)).cast("int").alias("shards"),
    )
    return kept, written(sources, "sources")


def shard_parts(kept: DataFrame, sources: DataFrame, top: int = TOP) -> DataFrame:
    """(part, lang, source, item, value): of each shard, the sum of each pair of sources, source < item, and each source's first terms."""

    def of(key: tuple, terms: pa.Table, groups: pa.Table) -> pa.Table:
        n = groups.num_rows
        step = max(1, PAIRS // max(1, n))
        with _duck() as db:
            db.register("kept", terms)
            db.register("sources", groups)
            db.execute(SHARE_SQL)
            out = [db.sql(PAIR_SQL, params=[at, at + step, key[1].as_py() == 0]).to_arrow_table() for at in range(0, n, step)]
            return pa.concat_tables([*out, db.sql(TERM_SQL, params=[top]).to_arrow_table()])

    shards = sources.select("lang", "shards").distinct()
    dealt = kept.join(shards, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), "source", "term", "n")
    lists = sources.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    return dealt.groupBy("lang", "shard").cogroup(lists.groupBy("lang", "shard")).applyInArrow(of, PARTS)


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): the sources of a lang that differ most, and the terms that set a source apart."""
    parts = written(shard_parts(*kept_counts(docs, least), top), "parts")
    pairs = parts.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    pairs = pairs.select("lang", "value", F.inline(both))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").union(ranked(parts.filter("part = 'term'"), "term").filter(F.col("rank") <= top))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
s AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
a AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n FROM s JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM a JOIN v USING (lang)),
l AS (SELECT lang, term, sum(n) AS n FROM a GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM l JOIN v USING (lang)),
pv AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
u AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM s x JOIN s y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pv ON pv.lang = x.lang AND pv.source = x.source AND pv.item = y.source
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM u) WHERE part = 'pair' OR rank <= 50
"""
