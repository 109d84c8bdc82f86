"""Deadline tracks in page texts: labelled dates, and the submission track to show.

Sentences without any label go first, by one pattern; labels and dates are read from the others, as
plain columns. A null text has no sentences. A page is told by its id: rows of one id are one page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duecall.functions import dates as D
from duecall.sources.staging import written

# The labels of deadline tracks in lower case, with their priority.
TRACKS = [
    ("main_submission", r"(?:main\s+track\s+|full[- ]?paper\s+|paper\s+)?submission\s+deadline", 1),
    ("main_submission", r"(?:papers?|submissions?)\s+(?:are\s+)?due", 1),
    ("abstract_submission", r"abstract\s+(?:registration\s+)?deadline", 2),
    ("late_breaking_submission", r"(?:late[- ]?breaking|hot[- ]?off[- ]?the[- ]?press|short\s+paper|demo|poster)\s+(?:paper\s+)?submission\s+deadline", 3),
    ("workshop_submission", r"workshop\s+(?:paper\s+)?submission\s+deadline", 3),
    ("arr_commitment", r"arr\s+commitment(?:\s+deadline)?", 2),
    ("direct_submission", r"direct\s+submissions?(?:\s+deadline)?", 2),
    ("challenge_submission", r"(?:challenge|shared\s+task|competition)\s+(?:paper\s+)?submission\s+deadline", 3),
    ("camera_ready", r"camera[- ]?ready|final\s+(?:paper|manuscript)", 99),
    ("notification", r"notification|acceptance\s+notice", 99),
    ("registration", r"(?:author\s+)?registration", 99),
]
# Of a sentence's labels those of the first of these sets that it meets count, else all.
SPECIFIC = [["late_breaking_submission"], ["arr_commitment"], ["direct_submission"], ["challenge_submission"], ["workshop_submission"], ["abstract_submission"], ["camera_ready", "notification", "registration"]]
SENTENCES = r"(?<=[.;|])\s+|\n+"


def labels(low: Column) -> Column:
    """array<struct(type, priority)>: the labels of a sentence in lower case that count."""
    met = {name: reduce(Column.__or__, (low.rlike(p) for n, p, _ in TRACKS if n == name)) for name, _, _ in TRACKS}
    order = {name: k for name, _, k in TRACKS}
    some = lambda names: F.array_compact(F.array(*(F.when(met[n], F.struct(F.lit(n).alias("type"), F.lit(order[n]).alias("priority"))) for n in names)))
    specific = [F.when(reduce(Column.__or__, (met[n] for n in names)), some(names)) for names in SPECIFIC]
    return F.coalesce(*specific, some(list(met)))


def read(texts: DataFrame, now: Column) -> DataFrame:
    """(text, type, priority, date): each label of a sentence of a text with each date in it, from a day ago to 550 days ahead, each once."""
    any_label = "|".join(p for _, p, _ in TRACKS)
    rows = texts.select("text", D.year_hint(F.col("text"), now).alias("year"), F.explode(F.split("text", SENTENCES)).alias("s"))
    rows = rows.filter(F.col("s").rlike(f"(?i){any_label}")).select("text", D.all_dates(F.col("s"), F.col("year")).alias("dates"), labels(F.lower("s")).alias("labels"))
    rows = rows.select("text", F.explode("dates").alias("date"), "labels").filter((F.col("date") >= now - F.expr("INTERVAL 1 DAY")) & (F.col("date") <= now + F.expr("INTERVAL 550 DAYS")))
    return rows.select("text", F.inline("labels"), "date").distinct()


def tracks(pages: DataFrame, now: Column) -> DataFrame:
    """(id, type, priority, date, chosen): each label of a sentence with each date in it, from a day ago to 550 days ahead, each once
    a page; chosen is the submission track to show: still ahead, by priority, then date.

    A text's tracks depend on it alone: each distinct text is read once, written with the track to show, and joined back
    to its pages, whose ids then need no shuffle of all tracks. Ids with several texts, counted first, are taken apart and chosen from anew.
    """
    ahead = F.when((F.col("priority") < 99) & (F.col("date") > now), F.struct("priority", "date", "type"))

    def chosen(rows: DataFrame, by: str) -> DataFrame:
        best = rows.withColumn("_b", F.min(ahead).over(Window.partitionBy(by)))
        return best.select(by, "type", "priority", "date", F.coalesce((F.col("type") == F.col("_b.type")) & (F.col("date") == F.col("_b.date")), F.lit(False)).alias("chosen"))

    several = written(pages.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "repeated")
    pages = pages.select("id", "text").filter("text is not null")
    # dealt out by a number, else Spark would put the few texts, which take long to read, into fewer tasks
    texts = written(pages.select("text").distinct().repartition(pages.sparkSession.sparkContext.defaultParallelism), "texts")
    found = chosen(read(texts, now), "text")
    found = written(found.groupBy("text").agg(F.collect_list(F.struct("type", "priority", "date", "chosen")).alias("found")), "tracks")
    if several.isEmpty():
        return pages.join(found, "text").select("id", F.inline("found"))
    again = pages.join(several, pages["id"].eqNullSafe(several["id"]), "left_semi").join(found, "text").select("id", F.inline("found"))
    again = chosen(again.select("id", "type", "priority", "date").distinct(), "id")
    once = pages.join(several, pages["id"].eqNullSafe(several["id"]), "left_anti").join(found, "text")
    return once.select("id", F.inline("found")).unionByName(again)
