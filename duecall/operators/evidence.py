"""Rule chains that keep all failing reasons, and weighted evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Ranks and quartiles that support an identity.
RANKED = ["A*", "A", "B", "C", "Q1", "Q2", "Q3", "Q4"]


def reasons(rules: dict[str, Column]) -> Column:
    """The names of all rules that fail; a null rule fails. A row is admitted where there is none."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))


def assessed(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    out = rows.withColumn("reasons", reasons(rules))
    return out.withColumn("admitted", F.size("reasons") == 0)


def weighed(good: dict[str, tuple[Column, int]], bad: dict[str, tuple[Column, int]], decisive: Column) -> Column:
    """struct(level, score, quality, notes): caution from 3 bad points, or 2 without decisive evidence;
    trusted with decisive evidence, 3 good points and no bad one; else review."""
    on = lambda c: F.coalesce(c, F.lit(False))
    points = lambda m: sum((F.when(on(c), n).otherwise(0) for c, n in m.values()), F.lit(0))
    g, b, d = points(good), points(bad), on(decisive)
    level = F.when((b >= 3) | ((b >= 2) & ~d), "caution").when(d & (g >= 3) & (b == 0), "trusted").otherwise("review")
    notes = F.array_compact(F.array(*(F.when(on(c), F.lit(k)) for k, (c, _) in [*good.items(), *bad.items()])))
    return F.struct(level.alias("level"), (g - b).cast("long").alias("score"), F.when(d, "corroborated").otherwise("partial").alias("quality"), notes.alias("notes"))


def legitimacy(x: Column) -> Column:
    """struct(level, score, quality, notes) of a call by all its evidence, journals by their identity and
    listing, other venues by proceedings, publisher and parent.

    x has host, approved, suspicious, type, tier, source, unreachable; identity, listed, indexed, conflict;
    established, checked, prior_publisher; publisher_now; parent, parent_claimed.
    """
    on = lambda c: F.coalesce(x[c], F.lit(False))
    journal = F.coalesce(x["type"], F.lit("")).isin("journal", "special-issue")
    venue, workshop = ~journal, x["type"].eqNullSafe(F.lit("workshop"))
    good = {
        "approved-host": (on("approved"), 1),
        "journal-identity": (journal & on("identity"), 2),
        "listed": (journal & on("listed"), 2),
        "indexed": (journal & ~on("listed") & on("indexed"), 1),
        "proceedings-on-publisher": (venue & on("established") & on("prior_publisher"), 3),
        "proceedings": (venue & on("established") & ~on("prior_publisher"), 1),
        "publisher-of-this-edition": (venue & on("publisher_now"), 2),
        "parent-lists-it": (workshop & on("parent"), 3),
        "ranked": (F.coalesce(x["tier"], F.lit("")).isin(*RANKED) & (on("identity") | on("established")), 1),
        "review-platform": (x["source"].eqNullSafe(F.lit("openreview")), 1),
    }
    bad = {
        "suspicious-host": (on("suspicious"), 2),
        "no-host": (x["host"].isNull() | (x["host"] == ""), 1),
        "identity-conflict": (journal & on("conflict"), 3),
        "no-proceedings": (venue & on("checked") & ~on("established"), 2),
        "parent-unconfirmed": (workshop & on("parent_claimed") & ~on("parent"), 1),
        "unreachable": (on("unreachable"), 1),
        "unknown-source": (x["source"].eqNullSafe(F.lit("other")) & ~on("approved") & ~on("identity") & ~on("established"), 1),
    }
    decisive = F.when(journal, on("identity") & (on("listed") | on("indexed"))).otherwise((on("established") & on("prior_publisher")) | on("publisher_now") | on("parent"))
    return weighed(good, bad, decisive)


def fused(evidence: DataFrame, key: str, event_year: Column) -> DataFrame:
    """(key, n_years, n_sources, n_recent, established) from rows (key, source, year, official, link).

    Recent are the four years before the event; established takes a recent year, and two
    sources with years or an official history with a link.
    """
    rows = evidence.withColumn("_recent", (F.col("year") >= event_year - 4) & (F.col("year") < event_year))
    out = rows.groupBy(key).agg(
        F.count_distinct("year").alias("n_years"),
        F.count_distinct(F.when(F.col("year").isNotNull(), F.col("source"))).alias("n_sources"),
        F.count_distinct(F.when(F.col("_recent"), F.col("year"))).alias("n_recent"),
        F.bool_or("official").alias("_official"),
        F.bool_or("link").alias("_link"),
    )
    established = (F.col("n_recent") >= 1) & ((F.col("n_sources") >= 2) | (F.coalesce("_official", F.lit(False)) & F.coalesce("_link", F.lit(False))))
    return out.withColumn("established", established).drop("_official", "_link")


def deadline_verdict(listed: Column, found: Column, reachable: Column, tolerance_days: float = 1.5) -> Column:
    """skipped, unreachable, unverified, confirmed or mismatch."""
    apart = F.abs(F.unix_timestamp(found.cast("timestamp")) - F.unix_timestamp(listed.cast("timestamp"))) / 86400
    return F.when(listed.isNull(), "skipped").when(~reachable, "unreachable").when(found.isNull(), "unverified").when(apart <= tolerance_days, "confirmed").otherwise("mismatch")


def venue_score(acronym: str, name: str, text: Column) -> Column:
    """0.55 if the acronym is a word of the page's normal text, and 0.45 times the share of the
    name's words of four letters or more that the text holds anywhere, also within words."""
    words = [w for w in dict.fromkeys(name.split()) if len(w) > 3]
    hits = sum((F.when(text.contains(w), 1).otherwise(0) for w in words), F.lit(0))
    share = hits / len(words) if words else F.lit(0.0)
    return F.least(F.lit(1.0), F.when(F.concat(F.lit(" "), text, F.lit(" ")).contains(f" {acronym} "), 0.55).otherwise(0.0) + 0.45 * share)
