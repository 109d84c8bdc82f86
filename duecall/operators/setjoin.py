"""Set joins by prefix filter: which large sets hold a given share of a small set's words."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duecall.sources.staging import written


def contained(short: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(q, id, ratio): the pairs in which a text of (id, words) holds at least that share of the words of a short one of (q, words).

    A short text of m words that misses no more than m - ceil(least m) of them holds one at least of
    any m - ceil(least m) + 1. So each is posted under that many of its words only, the rarest, and meets
    only the texts that hold one; all other words are counted for these pairs alone. Frequent
    words thus join nothing, unless a short text has no others. Words are distinct within a row.

    Only words that some short text has leave the texts, so their vocabulary's bulk isn't shuffled; the frequencies are counted on these.
    A null or empty set holds nothing and is held by nothing. Rows that repeat an id are taken as one. A
    very frequent word's partition can be split, as the joins are plain.
    """
    m = F.size("words")
    share = Fraction(str(least))
    need = F.ceil((m * share.numerator) / F.lit(share.denominator)).cast("int")
    short = written(short.filter(m > 0).groupBy("q").agg(F.array_distinct(F.flatten(F.collect_set("words"))).alias("words")), "short")
    vocabulary = written(short.select(F.explode("words").alias("t")).distinct(), "vocabulary")
    held = written(texts.select("id", F.explode(F.array_distinct("words")).alias("t")).join(vocabulary, "t").distinct(), "held")
    often = held.groupBy("t").agg(F.count("*").alias("n"))
    ranked = short.select("q", F.explode("words").alias("t")).join(often, "t", "left").groupBy("q").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "t"))).alias("words"))
    ranked = written(ranked.select("q", m.alias("m"), need.alias("need"), F.transform("words", lambda w: w["t"]).alias("words")), "ranked")
    prefix = ranked.select("q", F.explode(F.slice("words", F.lit(1), F.col("m") - F.col("need") + 1)).alias("t"))
    pairs = written(prefix.join(held, "t").select("q", "id").distinct(), "pairs")
    every = pairs.join(ranked.select("q", "m", "need", F.explode("words").alias("t")), "q")
    counted = every.join(held, ["id", "t"]).groupBy("q", "id", "m", "need").agg(F.count("*").alias("n"))
    return counted.filter("n >= need").select("q", "id", (F.col("n") / F.col("m")).alias("ratio"))
