"""Merging records of one entity: identity keys, richness, the ordered fold, live overlays, nested groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duecall.functions import text as T

# Types known by name only, acronyms that name nothing, words that end a track's title.
NAME_ONLY = ["special-issue", "book-proposal", "chapter-proposal", "reviewer-call"]
GENERIC = ["conference", "workshop", "journal", "track", "full", "abstracts"]
MODIFIERS = ["main track", "research track", "industry track", "demo track", "short papers", "full papers", "posters", "late breaking", "proceedings", "submissions"]


def identity_key(kind: Column, name: Column, acronym: Column, deadline: Column, mirrored: Column) -> Column:
    """type|identity|deadline: the acronym where it tells calls apart, else the name; of both only years from 2000 on go."""
    kind = F.coalesce(kind, F.lit("unknown"))
    short = T.acronym(acronym, "20")
    by_acronym = ~kind.isin(NAME_ONLY) & ~mirrored & (short != "") & ~short.isin(GENERIC)
    ident = F.when(by_acronym, F.concat(F.lit("acronym:"), short)).otherwise(F.concat(F.lit("name:"), T.name_text(name, years=False, centuries="20")))
    when = F.coalesce(F.date_format(deadline, "yyyy-MM-dd HH:mm:ss.SSS"), F.when(kind == "journal", "rolling").otherwise("undated"))
    return F.concat_ws("|", kind, ident, when)


def richness(present: list[Column], topics: Column, confirmed: Column, official_page: Column, official_source: Column) -> Column:
    """A point for each field that is there, half a point for up to six topics, and for evidence."""
    points = sum((F.when(c.isNotNull(), 1.0).otherwise(0.0) for c in present), F.lit(0.0))
    flag = lambda c, n: F.when(F.coalesce(c, F.lit(False)), float(n)).otherwise(0.0)
    return points + F.least(F.lit(6), F.greatest(F.lit(0), F.coalesce(F.size(topics), F.lit(0)))) / 2 + flag(confirmed, 5) + flag(official_page, 4) + flag(official_source, 2)


def folded(rows: DataFrame, key: str, ident: str, order: str, rich: str | Callable[[Column], Column], scalars: list[str], unions: list[str]) -> tuple[DataFrame, DataFrame]:
    """(unique, duplicates): the rows of each key folded in order, one after another.

    What is merged so far and the next row meet: the row takes over only if it is strictly
    richer; what the preferred one lacks comes from the other; arrays are united, the
    preferred one's elements first. rich is a column, or a function of a row as a struct: then
    what is merged so far is weighed anew each time, as it gains fields. Each absorbed id is reported with the id that it
    was merged into (merged_into) and the one that stands at the end (duplicate_of).

    The fold depends on all before it, so a key's rows go through one expression: for keys
    of bounded size, as copies of one call are.
    """
    empty = F.array().cast(dict(rows.dtypes)[ident].join(["array<", ">"]))
    weigh = (lambda x: x[rich]) if isinstance(rich, str) else rich
    kept = [*scalars, *([rich] if isinstance(rich, str) else [])]
    item = F.struct(F.col(ident).alias("id"), *(F.col(c) for c in kept), *(F.coalesce(F.col(c), F.array().cast(dict(rows.dtypes)[c])).alias(c) for c in unions), empty.alias("absorbed"))
    pair = f"struct<id:{dict(rows.dtypes)[ident]},merged_into:{dict(rows.dtypes)[ident]}>"

    def overlaid(a: Column, b: Column) -> Column:
        """a preferred over b."""
        absorbed = F.filter(F.array_distinct(F.concat(F.array(a["id"]), a["absorbed"], F.array(b["id"]), b["absorbed"])), lambda x: x != a["id"])
        return F.struct(a["id"].alias("id"), *(F.coalesce(a[c], b[c]).alias(c) for c in kept), *(F.array_distinct(F.concat(a[c], b[c])).alias(c) for c in unions), absorbed.alias("absorbed"))

    def step(state: Column, x: Column) -> Column:
        over = F.coalesce(weigh(x), F.lit(0.0)) > F.coalesce(weigh(state["now"]), F.lit(0.0))
        gone = F.when(over, F.struct(state["now"]["id"].alias("id"), x["id"].alias("merged_into"))).otherwise(F.struct(x["id"].alias("id"), state["now"]["id"].alias("merged_into")))
        return F.struct(F.when(over, overlaid(x, state["now"])).otherwise(overlaid(state["now"], x)).alias("now"), F.concat(state["gone"], F.array(gone)).alias("gone"))

    groups = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.col(ident).alias("_i"), item.alias("x")))).alias("_g"), F.count("*").alias("n_merged"))
    start = F.struct(F.get("_g", F.lit(0))["x"].alias("now"), F.array().cast(f"array<{pair}>").alias("gone"))
    done = groups.withColumn("_s", F.aggregate(F.slice("_g", F.lit(2), F.size("_g")), start, lambda s, x: step(s, x["x"])))
    unique = done.select(key, F.col("_s.now.id").alias(ident), *(F.col(f"_s.now.{c}").alias(c) for c in [*scalars, *unions]), F.array_sort("_s.now.absorbed").alias("deduplicated_from"), "n_merged")
    gone = done.select(key, F.col("_s.now.id").alias("duplicate_of"), F.inline("_s.gone"))
    return unique, gone.select(F.col("id").alias(ident), "duplicate_of", "merged_into", key)


def base_title(title: Column) -> Column:
    """Without trailing track names, however many there are.

    The title is read from its end, where the names begin, so each letter is met once: a
    name, what parts it from the one before, and so on. Possessive quantifiers keep no places to go
    back to, so the length of the tail is no matter.
    """
    names = "|".join(m[::-1].replace(" ", "[ ]+") for m in MODIFIERS)
    name = rf"(?:{names})(?=$|[ :,(-])"
    between = r"(?:[ ]*+[:,(-]++|[ ])[ )]*+"
    tail = rf"(?i)^[ )]*+{name}(?:{between}{name})*+(?:[ ]*+[:,(-]++[ ]*+|[ ]++|$)"
    return F.trim(F.reverse(F.regexp_replace(F.reverse(T.squeezed(title)), tail, "")))


def title_key(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(base_title(title)), "conference|symposium|meeting", ""), "[^a-z0-9]", "")


def two_levels(entries: DataFrame, outer: str, when: str, track: str, link: str) -> DataFrame:
    """(outer, primary, n_deadlines, deadlines): each key's deadlines in order, undated last, with their distinct tracks and links."""
    inner = entries.groupBy(outer, when).agg(F.sort_array(F.collect_set(track)).alias("tracks"), F.sort_array(F.collect_list(link)).alias("links"))
    place = F.struct(F.col(when).isNull().alias("undated"), F.col(when).alias("deadline"), "tracks", "links")
    out = inner.groupBy(outer).agg(F.sort_array(F.collect_list(place)).alias("deadlines"))
    return out.select(outer, F.get("deadlines", F.lit(0))["deadline"].alias("primary"), F.size("deadlines").cast("long").alias("n_deadlines"), "deadlines")


def entity_merge(cards: DataFrame, groups: DataFrame, overlay: list[str], complete: bool = True) -> DataFrame:
    """cards overlaid by live groups, and the groups that match none as new cards.

    Groups come in the order of their ids. One matches by its id, else by title key; several
    that match one card are merged into it one after another, so the last one's columns stand, and n_groups
    counts them all: none vanishes. The rest match by acronym and year, against cards that aren't mirrored and that
    no group has matched: each takes the next such card, as a card that is taken is mirrored from then on. What
    is left is new. Cards that an earlier live run made (from_live) go before, unless the snapshot isn't complete and they are still open;
    so do calls for organizers. cards: (card_id, group_id, title_key, acronym, year, mirrored, from_live, active, organizer, ...overlay),
    groups: (group_id, title_key, acronym, year, ...overlay).
    """
    stale = F.col("from_live") & (F.lit(complete) | ~F.col("active"))
    cards = cards.filter(~F.col("organizer") & ~stale)
    first = F.min("card_id")
    by_id = cards.filter("group_id is not null").groupBy("group_id").agg(first.alias("m1"))
    by_title = cards.filter("title_key <> ''").groupBy("title_key").agg(first.alias("m2"))
    matched = groups.join(by_id, "group_id", "left").join(by_title, "title_key", "left").withColumn("card_id", F.coalesce("m1", "m2"))
    matched = matched.withColumn("stage", F.when(F.col("m1").isNotNull(), "id").when(F.col("m2").isNotNull(), "title"))
    taken = matched.filter("card_id is not null").select("card_id").distinct()
    turn = lambda by: F.row_number().over(Window.partitionBy("acronym", "year").orderBy(by))
    free = cards.filter("not mirrored and length(acronym) >= 3").join(taken, "card_id", "left_anti").select("acronym", "year", F.col("card_id").alias("m3"), turn("card_id").alias("turn"))
    rest = matched.filter("card_id is null").drop("card_id", "stage").withColumn("turn", turn("group_id")).join(free, ["acronym", "year", "turn"], "left")
    rest = rest.select("group_id", F.col("m3").alias("card_id"), F.when(F.col("m3").isNotNull(), "fuzzy").otherwise("new").alias("stage"), *overlay)
    every = matched.filter("card_id is not null").select("group_id", "card_id", "stage", *overlay).unionByName(rest)
    last = F.max(F.struct("group_id", "stage", *overlay)).alias("_l")
    side = every.filter("card_id is not null").groupBy("card_id").agg(last, F.count("*").alias("n_groups"))
    merged = cards.select("card_id", "group_id", *overlay).join(side, "card_id", "left")
    merged = merged.select("card_id", F.coalesce("_l.group_id", "group_id").alias("group_id"), F.coalesce("_l.stage", F.lit("kept")).alias("stage"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"), *(F.coalesce(F.col(f"_l.{c}"), F.col(c)).alias(c) for c in overlay))
    new = every.filter("card_id is null").select(F.lit(None).cast(dict(cards.dtypes)["card_id"]).alias("card_id"), "group_id", "stage", F.lit(1).cast("long").alias("n_groups"), *overlay)
    return merged.unionByName(new)
