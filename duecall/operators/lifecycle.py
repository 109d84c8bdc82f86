"""Whether a call is open at an instant, and why not; order, leases and last-good merging.

"Now" is always a parameter. Columns that a frame lacks count as null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses that close a call whatever its dates.
CLOSED = ["closed", "expired", "inactive", "cancelled", "canceled", "archived"]


def instant(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def closure(now: str, status: Column, seed: Column, verified: Column, dates: list[Column], raw: list[Column] | None, rolling: Column, pending: Column) -> Column:
    """struct(active, reason, closed_at), tested in this order: a closing status; an imported
    seed that nobody verified; the first date that is set (unreadable, passed or ahead); rolling; pending date; nothing.

    dates are columns of dates; or raw is their texts: the first that isn't empty counts, and if
    it can't be read the deadline is invalid, whatever the later ones say.
    """
    text = F.coalesce(*(F.nullif(F.trim(x), F.lit("")) for x in raw)) if raw else None
    date = F.coalesce(*dates) if text is None else F.coalesce(*(F.try_to_timestamp(text, F.lit(form)) for form in ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"))).cast("timestamp_ntz")
    out = lambda active, reason, at=None: F.struct(F.lit(active).alias("active"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), (F.lit(None) if at is None else at).cast("timestamp_ntz").alias("closed_at"))
    low = F.lower(F.trim(status))
    cases = F.when(low.isin(CLOSED), out(False, F.concat(F.lit("status:"), low))).when(seed & ~verified, out(False, "unverified-seed"))
    if text is not None:
        cases = cases.when(text.isNotNull() & date.isNull(), out(False, "invalid-deadline"))
    return (
        cases.when(date <= instant(now), out(False, "deadline-passed", date))
        .when(date.isNotNull(), out(True, "deadline"))
        .when(F.coalesce(rolling, F.lit(False)), out(True, "rolling"))
        .when(F.coalesce(pending, F.lit(False)), out(True, "pending-deadline"))
        .otherwise(out(False, "no-deadline"))
    )


def judged(calls: DataFrame, now: str) -> DataFrame:
    """The calls view with active, reason and closed_at."""
    state = closure(now, F.col("status"), F.col("source") == "seed", F.col("official"), [F.col("expires_at"), F.col("deadline")], None, F.col("rolling") | (F.col("type") == "journal"), F.col("deadline_tbd"))
    return calls.withColumn("_s", state).select(*calls.columns, "_s.*")


def partition(calls: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(active, closed); closed rows say deprecated where nobody verified them, and when they closed and were archived."""
    all_ = judged(calls, now)
    label = F.when(F.col("reason").startswith("unverified-"), "deprecated").otherwise("closed")
    closed = all_.filter(~F.col("active")).withColumns({"lifecycle": label, "closed_at": F.coalesce("closed_at", instant(now)), "archived_at": instant(now)})
    return all_.filter("active"), closed


def soonest_first(calls: DataFrame, date: str = "deadline", key: str = "id") -> DataFrame:
    """By date, undated last; ties by key."""
    return calls.orderBy(F.col(date).asc_nulls_last(), key)


def meets(types: list[str] | None = None, trusted: bool = False, rolling: bool = False, least: str | None = None, most: str | None = None, before: str | None = None) -> Column:
    """Whether a row meets all constraints; a bound on the deadline isn't met without one."""
    date = F.when(~F.coalesce("rolling", F.lit(False)), F.col("deadline"))
    all_of = [
        F.col("type").isin(types) if types else None, F.col("official") if trusted else None, F.col("rolling") if rolling else None,
        date >= instant(least) if least else None, date <= instant(most) if most else None, date < instant(before) if before else None,
    ]
    return F.coalesce(reduce(Column.__and__, [c for c in all_of if c is not None], F.lit(True)), F.lit(False))


def constrained(calls: DataFrame, *constraints, **named) -> DataFrame:  # noqa: ANN002, ANN003
    """Rows that meet all constraints, which are those of meets."""
    return calls.filter(meets(*constraints, **named))


def lease(now: str, end: Column, days: int = 6) -> Column:
    """When a row lapses that nobody renews: days from now, or the end of its service if that is sooner."""
    return F.least(instant(now) + F.make_dt_interval(F.lit(days)), end)


def last_good(previous: DataFrame, fresh: DataFrame, key: str, complete: bool, now: str) -> DataFrame:
    """fresh, and if it isn't complete also what the last run had that is still open and not in it."""
    if complete:
        return fresh.withColumn("kept_from_last", F.lit(False))
    kept = previous.join(fresh.select(key), key, "left_anti").filter(F.col("deadline") > instant(now))
    return fresh.withColumn("kept_from_last", F.lit(False)).unionByName(kept.withColumn("kept_from_last", F.lit(True)))


def item_type(x: Column) -> Column:
    """A record's type: as it says, else by what it holds: a role for reviewers, a review status, a conference that asks for workshops."""
    text = F.lower(F.concat_ws(" ", x["name"], x["requirements"]))
    return (
        F.when(F.coalesce(x["type"], F.lit("")) != "", x["type"])
        .when(x["venue"].isNotNull() & F.lower(F.coalesce(x["role"], F.lit(""))).contains("reviewer"), "reviewer-call")
        .when(x["review_status"].isNotNull(), "review")
        .when(x["conference"].isNotNull() & text.contains("workshop"), "workshop-proposal")
        .otherwise("")
    )


def trusted(x: Column) -> Column:
    """Whether a record counts as trusted: no level is no objection, what awaits review never is."""
    level = F.lower(F.coalesce(x["level"], F.lit("trusted")))
    return x["review_status"].isNull() & (item_type(x) != "review") & level.isin("trusted", "admitted", "verified")
