"""Parsers of fetched documents: BibTeX, XML tables of contents, directory pages as text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duecall.functions import dates
from duecall.functions import text as T

_ENTRY = re.compile(r"(?m)^@(\w+)\s*\{\s*([^,\s]+)\s*,")
_FIELD = re.compile(r"(\w+)\s*=\s*")


def _value(text: str, at: int) -> tuple[str, int]:
    """The field value at a place: braced, quoted or bare; and where it ends."""
    if at < len(text) and text[at] in '{"':
        close, depth, k = ("}" if text[at] == "{" else '"'), 0, at
        while k < len(text):
            c = text[k]
            if c == "\\":
                k += 2
                continue
            if c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
            if (close == "}" and depth == 0) or (close == '"' and c == '"' and k > at and depth == 0):
                return text[at + 1 : k], k + 1
            k += 1
        return text[at + 1 :], len(text)
    end = re.compile(r"[,}\n]").search(text, at)
    stop = end.start() if end else len(text)
    return text[at:stop].strip(), stop


def bibtex_entries(text: str) -> list[tuple[str, str, dict[str, str]]]:
    """(kind, key, fields) of each entry; fields may go on over lines."""
    heads = list(_ENTRY.finditer(text))
    out = []
    for k, head in enumerate(heads):
        body, at, fields = text[head.end() : heads[k + 1].start() if k + 1 < len(heads) else len(text)], 0, {}
        while m := _FIELD.search(body, at):
            value, at = _value(body, m.end())
            fields[m[1].lower()] = " ".join(value.split())
        out.append((head[1].lower(), head[2], fields))
    return out


def bibtex(files: DataFrame) -> DataFrame:
    """(kind, key, fields map) of the entries in a frame's column ``text``; each text is parsed by itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([e for t in b["text"] if t is not None for e in bibtex_entries(t)], columns=["kind", "key", "fields"])

    return files.select("text").mapInPandas(run, "kind string, key string, fields map<string,string>")


def author_names(field: Column) -> Column:
    """"Last, First and ..." as an array of "First Last"."""
    flip = lambda a: F.when(a.contains(","), F.concat_ws(" ", F.trim(F.element_at(F.split(a, ","), -1)), F.trim(F.get(F.split(a, ","), F.lit(0))))).otherwise(a)
    return F.transform(F.split(T.latex_text(field), r" and "), lambda a: flip(F.trim(a)))


def toc_papers(pages: DataFrame, key: str) -> DataFrame:
    """(key, ord, title, authors, year) of the <article> records of an XML table of contents, authors in order."""
    records = pages.select(key, F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<article[^>]*>(.*?)</article>"), F.lit(1))).alias("ord", "_r"))
    one = lambda tag: T.xml_text(F.regexp_extract("_r", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1))
    authors = F.transform(F.regexp_extract_all("_r", F.lit(r"(?s)<author[^>]*>(.*?)</author>"), F.lit(1)), T.xml_text)
    return records.select(key, F.col("ord").cast("long"), one("title").alias("title"), authors.alias("authors"), one("year").try_cast("int").alias("year"))


def records(spark: SparkSession, path: str, starts: str | None = None, ends: str | None = None) -> DataFrame:
    """(record, file): the records of text files, cut where one starts or after one ends. The cut is the reader's own
    record separator, so one large file is read by many tasks."""
    rows = spark.read.option("lineSep", starts or ends).text(path).select(F.col("value").alias("record"), F.col("_metadata.file_path").alias("file"))
    if ends:
        return rows.withColumn("record", F.concat("record", F.lit(ends)))
    head = starts.lstrip("\n")
    return rows.withColumn("record", F.when(F.col("record").startswith(head), F.col("record")).otherwise(F.concat(F.lit(head), "record")))


def bibtex_files(spark: SparkSession, path: str) -> DataFrame:
    """(kind, key, fields map) of the entries of .bib files, which begin at a line's start. What stands before a file's first
    entry is passed over, unless it reads as an entry itself but for the sign."""
    return bibtex(records(spark, path, starts="\n@").select(F.col("record").alias("text")))


def toc_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, title, authors, year) of the <article> records of XML index files; a last one that isn't closed has what it holds."""
    whole = records(spark, path, ends="</article>").filter(F.col("record").rlike(r"<article[\s>]"))
    return toc_papers(whole.select("file", F.col("record").alias("xml")), "file").drop("ord")


def directory_text(pages: DataFrame, key: str, marker: str) -> DataFrame:
    """(key, title, status) of a directory as text: below the marker, a title line and the status line after it; dated ones before open ones, one for each title."""
    lines = pages.select(key, F.posexplode(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("i", "line"))
    by = Window.partitionBy(key).orderBy("i")
    lines = lines.withColumns({"status": F.lead("line").over(by), "_in": F.max((F.col("line") == marker).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1))})
    rows = lines.filter((F.col("_in") == 1) & F.col("status").rlike("^(?:Due |Open)") & ~F.col("line").rlike("^(?:Due |Open)"))
    best = F.min(F.struct((~F.col("status").startswith("Due ")).alias("undated"), "i", "status"))
    return rows.groupBy(key, F.col("line").alias("title")).agg(best["status"].alias("status"))


# What a directory's text has besides titles and dates, in lower case.
OPEN_LINE, IGNORED = "open for submissions", ["open for submissions", "active venues", "show all venues", "show all active venues"]
DUE_LINE = r"(?i)^due \d{1,2} [a-z]{3,9} 20\d{2} at \d{1,2}:\d{2} "


def directory_titles(pages: DataFrame, key: str) -> DataFrame:
    """(key, group_id, title, status, due) of a directory's text, whose titles are joined to its links.

    pages: (key, text, anchors array<struct<text, href>>). Below the first line that says so, a title is a line that is no
    status and isn't ignored, before a line that is a status as a whole: open, or due at a time with its zone. Its link is the first to a group with
    the same text, but for case, blanks and kinds of apostrophes. Of a group's entries the first dated one counts, else the
    first. A page without the marker, links or text has none.
    """
    clean = lambda c: F.trim(F.regexp_replace(c, "[ \t\r\n\u00a0]+", " "))
    same = lambda c: F.regexp_replace(F.lower(clean(c)), "[\u2019\u2018]", "'")
    lines = pages.select(key, F.posexplode(F.filter(F.transform(F.split("text", "\r?\n"), clean), lambda x: x != "")).alias("i", "title"))
    by = Window.partitionBy(key).orderBy("i")
    lines = lines.withColumns({"status": F.lead("title").over(by), "_in": F.max((F.lower("title") == OPEN_LINE).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1))})
    is_status = lambda c: F.lower(c).isin(OPEN_LINE) | F.concat(c, F.lit(" ")).rlike(DUE_LINE)
    rows = lines.filter((F.col("_in") == 1) & is_status(F.col("status")) & ~is_status(F.col("title")) & ~same(F.col("title")).isin(IGNORED))
    rows = rows.select(key, "i", "title", "status", same(F.col("title")).alias("_k"))
    links = pages.select(key, F.posexplode("anchors").alias("j", "a")).select(key, "j", same(F.col("a.text")).alias("_k"), clean(F.col("a.href")).alias("href"))
    links = links.filter(F.col("href").rlike(r"(?i)openreview\.net/group\?id=|^/group\?id=") & (F.col("_k") != ""))
    first = links.groupBy(key, "_k").agg(F.min(F.struct("j", "href"))["href"].alias("href"))
    group = F.try_url_decode(F.regexp_extract("href", r"[?&]id=([^&#]*)", 1))
    met = rows.join(first, [key, "_k"]).withColumn("group_id", group).filter(F.coalesce("group_id", F.lit("")) != "")
    met = met.withColumn("due", F.when(F.lower("status") != OPEN_LINE, dates.due_text(F.col("status"))))
    best = F.min(F.struct(F.col("due").isNull().alias("undated"), "i", "title", "due", F.when(F.lower("status") == OPEN_LINE, "open").otherwise("due").alias("status"))).alias("b")
    return met.groupBy(key, "group_id").agg(best).select(key, "group_id", "b.title", "b.status", "b.due")


def directory_html(pages: DataFrame, key: str, marker: str) -> DataFrame:
    """(key, group_id, title, status, due) of a directory page's group links below the marker, if it has one.

    A link's status is the text up to the next group link: open, due with a date, or active. Of a group's
    entries an open one counts, else a dated one, else the first; the last of several open ones.
    """
    anchor = r"(?i)<a\b[^>]*href=[\"'][^\"']*\bgroup\?[^\"']*\bid=[^\"']*[\"'][^>]*>"
    section = F.when(F.col("html").rlike(f"(?i){marker}"), F.regexp_replace("html", f"(?is)^.*?{marker}", "")).otherwise(F.col("html"))
    heads, tails = F.regexp_extract_all("_s", F.lit(anchor), F.lit(0)), F.split("_s", anchor, -1)
    rows = pages.select(key, section.alias("_s")).select(key, F.posexplode(F.zip_with(heads, F.slice(tails, F.lit(2), F.greatest(F.lit(0), F.size(tails) - 1)), lambda h, t: F.struct(h.alias("h"), t.alias("t")))).alias("i", "x"))
    group = F.try_url_decode(T.xml_text(F.regexp_extract("x.h", r"\bid=([^&\"']+)", 1)))
    title = T.html_text(F.regexp_extract("x.t", r"(?is)^(.*?)</a>", 1))
    near = T.html_text(F.regexp_replace("x.t", r"(?is)^.*?</a>", ""))
    rows = rows.select(key, "i", group.alias("group_id"), title.alias("title"), near.alias("near")).filter("group_id <> '' and title <> ''")
    rows = rows.withColumn("due", dates.due_text(F.when(F.col("near").rlike(r"(?i)\bdue\b"), F.col("near"))))
    rows = rows.withColumn("status", F.when(F.lower("near").contains("open for submissions"), "open").when(F.col("due").isNotNull(), "due").otherwise("active"))
    place = F.struct((F.col("status") != "open").alias("a"), F.col("due").isNull().alias("b"), F.when(F.col("status") == "open", -F.col("i")).otherwise(F.col("i")).alias("c"), "title", "status", "due")
    return rows.groupBy(key, "group_id").agg(F.min(place).alias("_b")).select(key, "group_id", "_b.title", "_b.status", "_b.due")


def index_editions(pages: DataFrame, key: str, since: int, until: int) -> DataFrame:
    """(key, year, title, volumes) of a venue's index: each heading with a year in the range, and the volumes listed before the next one."""
    parts = pages.select(key, F.posexplode(F.split("xml", r"(?=<h2\b)")).alias("at", "_p")).filter(F.col("_p").startswith("<h2"))
    head = T.xml_text(F.regexp_extract("_p", r"(?s)^<h2[^>]*>(.*?)</h2>", 1))
    volumes = F.regexp_extract_all("_p", F.lit(r'<proceedings[^>]*\bkey="([^"]+)"'), F.lit(1))
    rows = parts.select(key, "at", F.regexp_extract(head, r"\b((?:19|20)[0-9]{2})\b", 1).try_cast("int").alias("year"), head.alias("title"), volumes.alias("volumes"))
    return rows.filter(F.col("year").between(since, until)).select(key, "year", "title", "volumes")
