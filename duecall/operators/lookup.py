"""Lookups by normal form: rankings, venue identities, coverage, fuzzy matches. Dimensions are hinted nowhere: Spark broadcasts them by their size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duecall.functions import text as T

# Formal ranks, and words that names of venues share.
FORMAL = ["A*", "A", "B", "C"]
GENERIC = "acm ieee international conference annual symposium workshop on of the and for".split()


def rank_group(rank: Column, groups: dict[str, str] | None = None) -> Column:
    """A raw rank's group: as configured, a formal rank itself, a regional B or C its letter, else unranked."""
    raw = F.trim(F.coalesce(rank, F.lit("")))
    out = F.when(raw.isin(FORMAL), raw).when(raw.rlike(r"^(?i:australasian)\s+[bBcC]$"), F.upper(F.right(raw, F.lit(1)))).otherwise("unranked")
    for name, group in (groups or {}).items():
        out = F.when(raw == name, F.lit(group)).otherwise(out)
    return out


def ranked(calls: DataFrame, rankings: DataFrame, key: str, acronym: str, title: str, kind: str | None = None, groups: dict[str, str] | None = None, site: str = "") -> DataFrame:
    """calls with rank, rank_raw, rank_source and rank_url of the ranking row of the same normal acronym, or nulls.

    Only conferences and calls without a type (column kind) are ranked. One candidate is taken; of
    several the one with strictly the best title similarity; where the best tie, the first of
    them if all candidates have one rank group. rankings: (ord, acronym, title, rank, source), and
    path, where the catalogue has a page below site for each row.
    """
    words = lambda c: F.array_distinct(T.tokens(T.name_text(c, years=False, ampersand=False), 3, digits=False, stop=[]))
    own = calls.withColumns({"_a": T.acronym(F.col(acronym)), "_t": words(F.col(title))}).filter("_a <> ''")
    own = own.filter(F.coalesce(F.col(kind), F.lit("conference")) == "conference") if kind else own
    dim = rankings.select(F.col("ord").alias("_ord"), T.acronym(F.col("acronym")).alias("_b"), words(F.col("title")).alias("_u"), F.col("rank").alias("_rank"), F.col("source").alias("_source"), rank_group(F.col("rank"), groups).alias("_group"), (F.col("path") if "path" in rankings.columns else F.lit(None).cast("string")).alias("_path"))
    hits = own.join(dim, F.col("_a") == F.col("_b")).select(key, "_ord", "_rank", "_source", "_group", "_path", T.jaccard(F.col("_t"), F.col("_u")).alias("_s"))
    by_score = hits.groupBy(key, "_s").agg(F.min(F.struct("_ord", "_rank", "_source", "_group", "_path")).alias("_first"), F.count("*").alias("_n"), F.min("_group").alias("_lo"), F.max("_group").alias("_hi"))
    best = by_score.groupBy(key).agg(F.max(F.struct("_s", "_n", "_first")).alias("_top"), (F.min("_lo") == F.max("_hi")).alias("_one"))
    sure = (F.col("_top._n") == 1) | F.col("_one")
    pick = lambda f: F.when(sure, F.col(f"_top._first.{f}"))
    return calls.join(best.select(key, pick("_group").alias("rank"), pick("_rank").alias("rank_raw"), pick("_source").alias("rank_source"), F.concat(F.lit(site), pick("_path")).alias("rank_url")), key, "left")


def identified(calls: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """calls with the venue of the first matching identity key, venues in their order.

    calls has ``keys``: array<struct(kind, value)> in order of trust; keys is (venue, venue_ord, kind, value).
    Within a venue the kinds are tried in order; the first venue with any hit wins.
    """
    exploded = calls.select(key, F.posexplode("keys").alias("_place", "_k")).select(key, "_place", "_k.kind", "_k.value").filter("value <> ''")
    hits = exploded.join(keys, ["kind", "value"])
    best = hits.groupBy(key).agg(F.min(F.struct("venue_ord", "_place", "venue", "kind")).alias("_b"))
    return calls.join(best.select(key, F.col("_b.venue").alias("venue"), F.col("_b.kind").alias("matched_by")), key, "left")


def covered(calls: DataFrame, coverage: DataFrame, key: str) -> DataFrame:
    """Left join of a coverage row with zeros for what is missing."""
    return calls.join(coverage, key, "left").na.fill(0, ["paper_count", "edition_count"]).na.fill("missing", ["coverage_status"])


def best_match(left: DataFrame, right: DataFrame, key: str, block: list[str], score: Column, least: float, order: str, alone: bool = False) -> DataFrame:
    """For each left row the right row of its block with the highest score, at least least; ties to the first, or no match if only a lone candidate counts."""
    hits = left.join(right, block).withColumn("_s", score).filter(F.col("_s") >= least)
    w = Window.partitionBy(key)
    hits = hits.withColumns({"_n": F.row_number().over(w.orderBy(F.desc("_s"), order)), "_c": F.count("*").over(w)})
    hits = hits.filter("_n = 1")
    return (hits.filter("_c = 1") if alone else hits).drop("_n", "_c").withColumnRenamed("_s", "score")


def token_in_id(acronyms: DataFrame, acronym: str, ids: DataFrame, key: str, longest: int = 4) -> DataFrame:
    """acronyms with the first id that holds the acronym as a token, or null; between the acronym's words anything but letters and digits may stand.

    An id's tokens, up to ``longest`` neighbours joined, are matched by an equi-join, and the
    pattern decides among what meets; acronyms of more words than that match nothing.
    """
    parts = F.filter(F.split(F.lower(F.col(key)), "[^a-z0-9]+"), lambda x: x != "")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(F.col("_p"), lambda x, i: F.array_join(F.slice("_p", i + 1, n), ""))))
    tokens = ids.select(F.col(key).alias("_id"), parts.alias("_p")).select("_id", F.explode(F.array_distinct(runs)).alias("_t"))
    name = T.name_text(F.col(acronym))
    own = acronyms.select(F.col(acronym).alias("_a"), name.alias("_n")).distinct().withColumn("_t", F.replace("_n", F.lit(" "), F.lit("")))
    pattern = F.concat(F.lit("(?:^|[^a-z0-9])"), F.replace("_n", F.lit(" "), F.lit("[^a-z0-9]*")), F.lit("(?:[^a-z0-9]|$)"))
    met = own.filter("_t <> ''").join(tokens, "_t").filter(F.rlike(F.lower("_id"), pattern))
    first = met.groupBy("_a").agg(F.min("_id").alias(key))
    return acronyms.join(first, F.col(acronym).eqNullSafe(F.col("_a")), "left").drop("_a")


def existing(records: DataFrame, watch: DataFrame, key: str) -> DataFrame:
    """records (key, acronym, title) with the first row of watch (ord, acronym, name, ...) of the
    same normal acronym or of exactly that name in lower case, and its other columns."""
    exact = lambda c: F.lower(F.trim(c))
    by_acronym = watch.select("ord", T.acronym(F.col("acronym")).alias("_a")).filter("_a <> ''").groupBy("_a").agg(F.min("ord").alias("_1"))
    by_name = watch.select("ord", exact(F.col("name")).alias("_n")).groupBy("_n").agg(F.min("ord").alias("_2"))
    out = records.withColumns({"_x": T.acronym(F.col("acronym")), "_y": exact(F.col("title"))})
    out = out.join(by_acronym, F.col("_x") == F.col("_a"), "left").join(by_name, F.col("_y") == F.col("_n"), "left").withColumn("ord", F.least("_1", "_2"))
    return out.select(*records.columns, "ord").join(watch.drop("acronym", "name"), "ord", "left")
