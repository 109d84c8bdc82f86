"""Field-weighted BM25 over two fields, concept filters, phrase boosts, facets, paging, diversity.

Terms are counted by exploding only the query's terms: what is shuffled grows with the
matches, not with the tokens. The corpus statistics are one row and are broadcast.
"""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duecall.functions import text as T
from duecall.functions.parse import Search, parse
from duecall.operators import lifecycle
from duecall.sources.staging import written

K1, B = 1.2, 0.75


def counted(high: Column, body: Column, weights: dict[str, float], high_weight: float, floor: float = 0.0) -> Column:
    """struct(len, tf): a row's weighted length, and how often it has each of the query's terms; high and body are arrays of tokens."""
    terms = F.array(*map(F.lit, weights)).cast("array<string>")
    of = lambda hits, t: F.size(F.filter(hits, lambda x: x == t))
    hits = lambda tokens: F.filter(tokens, lambda x: x.isin(list(weights))) if weights else F.array().cast("array<string>")
    tf = T.let(F.struct(hits(high).alias("h"), hits(body).alias("b")), lambda x: F.transform(terms, lambda t: high_weight * of(x["h"], t) + of(x["b"], t)))
    return F.struct(F.greatest(high_weight * F.size(high) + F.size(body), F.lit(floor)).cast("double").alias("len"), tf.alias("tf"))


def weighed(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """rows, which have ``_c`` (see counted) and ``_bonus``, with a BM25 score in their place.

    score = sum over terms of w * ln(1 + (N - df + .5) / (df + .5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len / avg)),
    tf and len counting the high field high_weight times, and the bonus. Statistics are over rows as given.
    """
    stats = rows.agg(F.count("*").alias("_n"), F.greatest(F.avg("_c.len"), F.lit(1.0)).alias("_avg"), *(F.count_if(F.get("_c.tf", F.lit(k)) > 0).alias(f"_df{k}") for k in range(len(weights))))
    out = rows.crossJoin(F.broadcast(stats))
    total = F.lit(0.0)
    for k, w in enumerate(weights.values()):
        tf, df = F.get("_c.tf", F.lit(k)), F.col(f"_df{k}")
        idf = F.ln(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
        total = total + F.when(tf > 0, w * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_c.len") / F.col("_avg")))).otherwise(0.0)
    return out.withColumn("score", total + F.col("_bonus")).select(*(c for c in rows.columns if c not in ("_c", "_bonus")), "score")


def scored(rows: DataFrame, high: Column, body: Column, weights: dict[str, float], high_weight: float, floor: float = 0.0) -> DataFrame:
    """rows with a BM25 score over short fields; high and body are arrays of tokens, weights the query's terms."""
    return weighed(rows.withColumns({"_c": counted(high, body, weights, high_weight, floor), "_bonus": F.lit(0.0)}), weights)


def phrase_bonus(phrase: str, high: Column, body: Column) -> Column:
    """5 for the whole phrase in the high text, else 2 in the body; none for phrases under three characters."""
    if len(phrase) < 3:
        return F.lit(0.0)
    return F.when(high.contains(phrase), 5.0).when(body.contains(phrase), 2.0).otherwise(0.0)


def concept_hits(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases a text holds, anywhere, also within words."""
    return sum((F.when(text.contains(p), 1).otherwise(0) for p in phrases), F.lit(0))


def concept_bonus(text: Column, concepts: dict[str, list[str]]) -> Column:
    """2 for each concept that is met, and 0.75 for each further phrase of it, three at most."""
    out = F.lit(0.0)
    for phrases in concepts.values():
        hits = concept_hits(text, phrases)
        out = out + F.when(hits > 0, 2 + 0.75 * F.least(hits - 1, F.lit(3))).otherwise(0.0)
    return out


def expansion(terms: list[str], concepts: dict[str, list[str]]) -> dict[str, float]:
    """The query's terms at weight 1, the words of its concepts at 0.32."""
    out = dict.fromkeys(terms, 1.0)
    for phrases in concepts.values():
        for word in (w for p in phrases for w in p.split()):
            out.setdefault(word, 0.32)
    return out


def searched(rows: DataFrame, raw: str, now: datetime) -> tuple[DataFrame, Search]:
    """The whole search, from a string to scored rows in order: constraints, concept filter, weighted BM25
    over what is left, boosts, and a score above 0 where the query has meaning; else by deadline.

    rows: (id, type, deadline, rolling, official, ``_high``, ``_body``) with the two fields' search texts. What the
    statistics, the filter and the scores need of them is made in one pass and written, so that long texts are taken apart once.
    """
    q = parse(raw, now)
    rows = lifecycle.constrained(rows, q.types, q.trusted, q.rolling, *(str(x) if x else None for x in (q.least, q.most, q.before)))
    if not (q.terms or q.concepts):
        out = rows.drop("_high", "_body").withColumn("score", F.lit(0.0))
        return out.orderBy(F.when(~F.coalesce("rolling", F.lit(False)), F.col("deadline")).asc_nulls_last(), "id"), q
    weights = expansion(q.terms, q.concepts)
    phrases = list(dict.fromkeys(p for some in q.concepts.values() for p in some))

    def of(x: Column) -> Column:
        both = F.concat_ws(" ", x["h"], x["b"])
        met = concept_hits(both, phrases) > 0 if phrases else F.lit(True)
        bonus = phrase_bonus(q.text, x["h"], x["b"]) + concept_bonus(both, q.concepts)
        counts = T.let(F.struct(T.tokens(x["h"]).alias("h"), T.tokens(x["b"]).alias("b")), lambda t: counted(t["h"], t["b"], weights, 2.4))
        return F.when(met, F.struct(counts.alias("c"), bonus.alias("bonus")))

    slim = rows.withColumn("_x", T.let(F.struct(F.col("_high").alias("h"), F.col("_body").alias("b")), of)).drop("_high", "_body")
    slim = written(slim, "counts").filter("_x is not null")
    slim = slim.select(*(c for c in slim.columns if c != "_x"), F.col("_x.c").alias("_c"), F.col("_x.bonus").alias("_bonus"))
    out = weighed(slim, weights).withColumn("score", F.round("score", 6)).filter("score > 0")
    return out.orderBy(F.desc("score"), "id"), q


def faceted(papers: DataFrame, year: int | None = None, topic: str | None = None, method: str | None = None, open_only: bool = False) -> DataFrame:
    if year is not None:
        papers = papers.filter(F.col("year") == year)
    if topic:
        papers = papers.filter(F.array_contains("topics", topic))
    if method:
        papers = papers.filter(F.col("method") == method)
    return papers.filter(F.col("open_url").isNotNull()) if open_only else papers


SORTS = {
    "relevance": lambda: (F.desc("score"), F.desc("year"), F.asc("title"), F.asc("id")),
    "recent": lambda: (F.desc("year"), F.asc("title"), F.asc("id")),
    "cited": lambda: (F.desc(F.coalesce("citations", F.lit(0))), F.desc("year"), F.asc("id")),
}


def page(rows: DataFrame, order: tuple[Column, ...], offset: int, limit: int) -> DataFrame:
    """One page with ord, total and next_offset (null on the last page); limits are clamped as the API does."""
    limit, offset = min(50, max(1, limit)), offset if 0 <= offset <= 10_000 else 0
    total = rows.agg(F.count("*").alias("total"))
    cut = rows.orderBy(*order).offset(offset).limit(limit).withColumn("ord", F.row_number().over(Window.orderBy(*order)).cast("long") + offset)
    after = F.when(F.col("total") > offset + limit, F.lit(offset + limit)).cast("long")
    return cut.crossJoin(F.broadcast(total)).withColumn("next_offset", after)


def encode_cursor(offset: int) -> str:
    import base64

    return base64.urlsafe_b64encode(str(offset).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> int:
    import base64

    try:
        n = int(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError:
        return 0
    return n if 0 <= n <= 10_000 else 0


def diversified(ranked: DataFrame, group: str, limit: int, bonus: float = 0.7, least: float = 0.2, tail: bool = False) -> DataFrame:
    """Greedy choice of ``limit`` of each group's rows, out of all: the next one has the largest
    score + bonus * novelty, novelty being the best 1 / (1 + uses) of its topics, and least at least.

    Rows of one set of topics are equally novel at any time and so taken in their order:
    the first ``limit`` of each set are all that can win. Ties keep the order of the step before,
    as a stable sort does. The choice depends on all before it, so it runs by group in Python,
    on rows bounded by limit times the sets. With ``tail`` the rows that weren't chosen follow by rank.
    """
    order = (F.desc("score"), F.desc("year"), "title", "id")
    rows = ranked.withColumn("_set", F.array_join(F.transform(F.sort_array(F.coalesce("topics", F.array().cast("array<string>"))), lambda t: F.concat(F.length(t).cast("string"), F.lit(":"), t)), ","))
    head = capped(rows, [group, "_set"], limit, *order)
    head = head.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).select(group, "id", "topics", "score", "_r")

    def pick(batch: pd.DataFrame) -> pd.DataFrame:
        rows = batch.sort_values("_r").to_dict("records")
        topics = lambda r: [] if r["topics"] is None else r["topics"]
        used: dict[str, int] = {}
        out = []
        while rows and len(out) < limit:
            rows.sort(key=lambda r: -(r["score"] + bonus * max([least, *(1 / (1 + used.get(t, 0)) for t in topics(r))])))
            row = rows.pop(0)
            for t in topics(row):
                used[t] = used.get(t, 0) + 1
            out.append((row[group], row["id"], len(out) + 1))
        return pd.DataFrame(out, columns=[group, "id", "ord"])

    kind = dict(head.dtypes)[group]
    chosen = head.groupBy(group).applyInPandas(pick, f"{group} {kind}, id long, ord long")
    if not tail:
        return chosen
    chosen = written(chosen, "chosen")
    rest = ranked.join(chosen.select("id"), "id", "left_anti").withColumn("ord", F.row_number().over(Window.partitionBy(group).orderBy(*order)) + F.lit(limit))
    return chosen.unionByName(rest.select(group, "id", F.col("ord").cast("long").alias("ord")))


def shortlist(ranked: DataFrame, rest: DataFrame, size: int) -> DataFrame:
    """Distinct ids: ranked ones by their order, then others by theirs, size at most."""
    both = ranked.select("id", F.lit(0).alias("_p"), "ord").unionByName(rest.select("id", F.lit(1).alias("_p"), "ord"))
    one = both.groupBy("id").agg(F.min(F.struct("_p", "ord")).alias("_k"))
    return one.orderBy("_k", "id").limit(size).select("id", F.row_number().over(Window.orderBy("_k", "id")).cast("long").alias("ord"))


def capped(rows: DataFrame, by: list[str], most: int, *order: Column) -> DataFrame:
    """The first rows of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")
