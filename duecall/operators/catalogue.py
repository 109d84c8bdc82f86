"""The catalogue's read path as one plan: from the stores to the cards that a reader sees.

The store's cards are overlaid by the last snapshot of live groups that are still ahead, which also brings
new cards; then come ranks, the lifecycle at an instant, the merge of equal calls, safe URLs, the venue's
identity and coverage, the primary URL and its kind, and the order: soonest first, undated last. Every step is the
operator of its own name; what they do about nulls, ties and repeats holds here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duecall.functions import text as T
from duecall.operators import admission, fold, lifecycle, lookup, merge

#: What a card has; the store also has group_id, title_key, year, from_live and organizer.
CARD = ["id", "type", "name", "acronym", "deadline", "rolling", "status", "expires_at", "deadline_tbd", "source", "official", "cfp_url", "url", "mirrored"]
DIRECTORY_LINKS = 2


def recovered(store: DataFrame, live: DataFrame, now: str, new_id: Callable[[Column], Column]) -> DataFrame:
    """The store's cards and those of live groups (group_id, title_key, acronym, year, name, deadline, url) that are ahead; the snapshot isn't taken as complete."""
    overlay = ["deadline", "url"]
    ahead = live.filter(F.col("deadline") > lifecycle.instant(now))
    cards = lifecycle.judged(store, now).withColumn("acronym", T.acronym(F.col("acronym")))
    cards = cards.select(F.col("id").alias("card_id"), "group_id", "title_key", "acronym", "year", "mirrored", "from_live", "active", "organizer", *overlay)
    merged = merge.entity_merge(cards, ahead.select("group_id", "title_key", "acronym", "year", *overlay), overlay, complete=False)
    old = merged.filter("card_id is not null").select(F.col("card_id").alias("id"), *overlay, F.col("stage") != "kept")
    old = old.toDF("id", *overlay, "_met").join(store.drop(*overlay), "id").withColumn("mirrored", F.col("mirrored") | F.col("_met"))
    new = merged.filter("card_id is null").select("group_id", *overlay).join(ahead.select("group_id", "name", "acronym"), "group_id")
    none = {"type": F.lit("conference"), "rolling": F.lit(False), "status": F.lit("open"), "expires_at": F.lit(None).cast("timestamp_ntz"), "deadline_tbd": F.lit(False), "source": F.lit("live"), "official": F.lit(True), "cfp_url": F.lit(None).cast("string"), "mirrored": F.lit(True)}
    return old.select(*CARD).unionByName(new.withColumns({"id": new_id(F.col("group_id")), **none}).select(*CARD))


def active_calls(store: DataFrame, live: DataFrame, rankings: DataFrame, identities: DataFrame, coverage: DataFrame, now: str, organizers: list[str], new_id: Callable[[Column], Column], site: str = "") -> DataFrame:
    """The cards of calls that are open at now: CARD, rank, rank_url, n_merged, venue, papers, resolved_url and link_kind, in order.

    identities: (venue, venue_ord, kind, value); coverage: (venue, papers). A workshop's URL that more than two
    share is a directory's.
    """
    rows = recovered(store, live, now, new_id)
    rows = lookup.ranked(rows, rankings, "id", "acronym", "name", "type", site=site)
    rows = lifecycle.judged(rows, now).filter("active")
    rows = rows.withColumn("key", merge.identity_key(F.col("type"), F.col("name"), F.col("acronym"), F.col("deadline"), F.col("mirrored")))
    scalars = [c for c in CARD if c != "id"] + ["rank", "rank_url"]
    shape = fold.Shape("key", "id", "id", scalars, present=["cfp_url", "url"], points={"official": 2.0})
    rows, _ = fold.streamed(rows.select("key", "id", *scalars), shape)
    rows = rows.withColumns({"cfp_url": T.normal_url(F.col("cfp_url")), "url": T.normal_url(F.col("url"))})
    known = F.array(F.struct(F.lit("acronym").alias("kind"), T.acronym(F.col("acronym")).alias("value")), F.struct(F.lit("name").alias("kind"), T.name_text(F.col("name"), years=False).alias("value")))
    rows = lookup.identified(rows.withColumn("keys", known), identities, "id").drop("keys")
    rows = rows.join(coverage, "venue", "left").withColumn("resolved_url", admission.primary_url(F.col("type"), [F.col("cfp_url"), F.col("url")], organizers))
    shared = rows.filter("type = 'workshop' and resolved_url is not null").groupBy("resolved_url").agg(F.count("*").alias("_n")).filter(F.col("_n") > DIRECTORY_LINKS)
    rows = rows.join(shared, "resolved_url", "left")
    rows = rows.withColumn("link_kind", F.when((F.col("type") == "workshop") & F.col("_n").isNotNull(), "workshop-directory").otherwise(F.col("type"))).drop("_n", "key")
    return lifecycle.soonest_first(rows)
