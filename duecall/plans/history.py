"""Queries of venue history, sources, set maintenance, windows and extras that Spark brings along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duecall.functions import text as T
from duecall.operators import upserts, vectors
from duecall.sources import commits, parsers, sinks, staging, tables
from duecall.sources.tables import CALLS_SQL, PAPERS_SQL, calls, papers, spread, table
from duecall.streaming import leases, ledger, windows

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("WITH g AS (SELECT n_nationkey AS ord, n_name AS id, 'generated' AS origin FROM nation WHERE n_nationkey < 15), m AS (SELECT n_nationkey AS ord, n_name AS id, 'manual' AS origin FROM nation WHERE n_nationkey % 4 = 0) SELECT coalesce(m.id, g.id) AS id, CASE WHEN m.id IS NOT NULL THEN 'manual' ELSE 'generated' END AS origin FROM g FULL JOIN m ON g.id = m.id")
def layered_config(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("id"))
    return tables.layered(n.filter("ord < 15").withColumn("origin", F.lit("generated")), n.filter("ord % 4 = 0").withColumn("origin", F.lit("manual")), "id", "ord").select("id", "origin")


@query("WITH a AS (SELECT o_custkey AS id, max(o_orderdate) AS at FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS id, max(o_orderdate) AS at FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.at IS NULL OR a.at >= b.at THEN a.at ELSE b.at END AS at, CASE WHEN b.at IS NULL OR a.at >= b.at THEN 'database' ELSE 'snapshot' END AS origin FROM a FULL JOIN b ON a.id = b.id")
def freshest_source(spark: SparkSession, d: str) -> DataFrame:
    side = lambda k: table(spark, d, "orders").filter(f"o_orderkey % 2 = {k}").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("at"))
    return tables.freshest(side(0), side(1), "id", "at")


@query(f"WITH {PAPERS_SQL} SELECT venue AS venue_id, count(*) AS paper_count, count(DISTINCT year) AS edition_count, min(year) AS start_year, max(year) AS end_year FROM papers GROUP BY 1")
def shard_manifest(spark: SparkSession, d: str) -> DataFrame:
    return sinks.manifest(papers(spark, d).withColumnRenamed("venue", "venue_id"))


@query(f"WITH {PAPERS_SQL} SELECT venue AS venue_id, id, year, title FROM papers QUALIFY row_number() OVER (PARTITION BY venue ORDER BY year DESC, title, id) <= 5")
def snapshot_sort_head(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("venue").orderBy(F.desc("year"), "title", "id")
    return papers(spark, d).withColumn("_n", F.row_number().over(w)).filter("_n <= 5").select(F.col("venue").alias("venue_id"), "id", "year", "title")


@query(f"WITH {CALLS_SQL} SELECT DISTINCT id FROM calls WHERE type = 'conference' AND status <> 'closed' ORDER BY id LIMIT 20000")
def baseline_ids(spark: SparkSession, d: str) -> DataFrame:
    return calls(spark, d).filter("type = 'conference' and status <> 'closed'").select("id").distinct().orderBy("id").limit(20_000)


@query(f"WITH {CALLS_SQL}, u AS (SELECT id FROM calls WHERE id % 9 = 0 AND venue NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)), f AS (SELECT id FROM calls WHERE id % 50 = 0) SELECT id, 'identity' AS why FROM u UNION SELECT id, 'provider' FROM f")
def pending_retry(spark: SparkSession, d: str) -> DataFrame:
    c = calls(spark, d)
    known = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("venue"))
    unresolved = c.filter("id % 9 = 0").join(known, "venue", "left_anti").select("id", F.lit("identity").alias("why"))
    return unresolved.union(c.filter("id % 50 = 0").select("id", F.lit("provider").alias("why"))).distinct()


@query("""WITH g AS (SELECT user_id, min(ts) FILTER (event_type IN ('click', 'view') AND ts > TIMESTAMP '2024-01-10') AS due FROM events GROUP BY user_id) SELECT c_custkey AS id, g.due FROM customer JOIN g ON user_id = c_custkey WHERE g.due IS NOT NULL""")
def earliest_open_invitation(spark: SparkSession, d: str) -> DataFrame:
    open_ = table(spark, d, "events").filter(F.col("event_type").rlike("^(?:click|view)$") & (F.col("ts") > F.lit("2024-01-10").cast("timestamp_ntz")))
    first = open_.groupBy("user_id").agg(F.min("ts").alias("due"))
    return table(spark, d, "customer").join(first, F.col("c_custkey") == F.col("user_id")).select(F.col("c_custkey").alias("id"), "due")


@query(f"WITH {PAPERS_SQL}, r AS (SELECT DISTINCT title, year, method, venue FROM papers) SELECT p.id FROM papers p JOIN (SELECT title, year, method FROM r GROUP BY ALL HAVING count(*) = 1) u USING (title, year, method)")
def exactly_one_match(spark: SparkSession, d: str) -> DataFrame:
    """Registry rows are accepted only where one candidate is left."""
    p = papers(spark, d)
    same = ["title", "year", "method"]
    lone = p.select(*same, "venue").distinct().groupBy(*same).agg(F.count("*").alias("c")).filter("c = 1")
    return p.join(lone, same, "left_semi").select("id")


@query("""SELECT event_id AS id, k AS origin FROM (SELECT event_id, 0 AS p, 'pending' AS k, event_id % 500 AS u FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 1, 'fresh', event_id % 500 FROM events WHERE event_type = 'signup') QUALIFY row_number() OVER (PARTITION BY u ORDER BY p, event_id) = 1""")
def replay_pending_first(spark: SparkSession, d: str) -> DataFrame:
    """What the last run left undone goes before what is new; each URL once."""
    n = F.col("event_id")
    rows = table(spark, d, "events").select(n.alias("id"), "event_type", T.normal_url(F.concat(F.lit("HTTPS://Host.org/"), (n % 500).cast("string"))).alias("url"))
    pending, fresh = rows.filter("event_type = 'error'"), rows.filter("event_type = 'signup'")
    both = pending.withColumns({"p": F.lit(0), "origin": F.lit("pending")}).unionByName(fresh.withColumns({"p": F.lit(1), "origin": F.lit("fresh")}))
    return upserts.first_by(both, ["url"], "p", "id").select("id", "origin")


@query("""WITH r AS (SELECT p_partkey AS k, p_brand || ' ' || p_partkey // 300 AS title FROM part WHERE p_partkey % 3 = 0 AND p_size % 2 = 0 AND p_size >= 40) SELECT min(k) AS id, title FROM r GROUP BY title HAVING count(*) = 1""")
def registry_accepted(spark: SparkSession, d: str) -> DataFrame:
    """Registry rows are accepted where title, publisher family, ISSN and number of DOIs fit, and exactly one row does."""
    p, n = table(spark, d, "part").withColumn("title", F.concat(F.col("p_brand"), F.lit(" "), F.floor(F.col("p_partkey") / 300).cast("string"))), F.col("p_size")
    venues = p.select(T.name_text(F.col("title")).alias("t"), "title").distinct()
    rows = p.select(F.col("p_partkey").alias("id"), T.name_text(F.concat(F.upper("title"), F.lit(" "))).alias("t"), F.when(F.col("p_partkey") % 3 == 0, "Springer Nature").otherwise("Other Press").alias("publisher"), T.issn(F.when(n % 2 == 0, "0028-0836").otherwise("0028-0837")).alias("issn"), n.alias("dois"))
    fit = rows.filter(F.lower("publisher").contains("springer") & F.col("issn").isNotNull() & (F.col("dois") >= 40)).join(venues, "t")
    return fit.groupBy("title").agg(F.min("id").alias("id"), F.count("*").alias("n")).filter("n = 1").select("id", "title")


@query(f"WITH {PAPERS_SQL} SELECT id FROM papers WHERE list_has_any(topics, ['blue', 'steel']) AND year = 2005 AND NOT regexp_matches(lower(title), '^(?:white|editorial|front matter)')")
def member_and_front_matter(spark: SparkSession, d: str) -> DataFrame:
    """Set membership by overlap, and patterns that exclude front matter."""
    keep = F.arrays_overlap("topics", F.array(F.lit("blue"), F.lit("steel"))) & (F.col("year") == 2005) & ~F.lower("title").rlike("^(?:white|editorial|front matter)")
    return papers(spark, d).filter(keep).select("id")


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages), k AS (SELECT min(page_id) AS page_id, regexp_replace(href, '#.*$', '') AS link FROM l WHERE regexp_matches(lower(href), '^/[a-z]') AND NOT contains(href, 'xx') GROUP BY 2) SELECT page_id, link FROM k ORDER BY page_id, link LIMIT 250""")
def candidate_links(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    fit = links.filter(F.lower("href").rlike("^/[a-z]") & ~F.col("href").contains("xx"))
    return fit.groupBy(F.regexp_replace("href", "#.*$", "").alias("link")).agg(F.min("page_id").alias("page_id")).orderBy("page_id", "link").limit(250).select("page_id", "link")


@query(f"WITH {CALLS_SQL}, p AS (SELECT id, deadline FROM calls WHERE id % 2 = 0 AND deadline > TIMESTAMP '1999-01-01'), f AS (SELECT id, deadline FROM calls WHERE id % 6 = 0), r AS (SELECT id FROM calls WHERE id % 10 = 0 AND status = 'closed') SELECT id, 'kept' AS origin FROM p WHERE id NOT IN (SELECT id FROM f) AND id NOT IN (SELECT id FROM r) AND id % 14 <> 0 AND deadline NOT IN (SELECT deadline FROM f WHERE deadline IS NOT NULL) UNION ALL SELECT id, 'fresh' FROM f")
def keep_unless_rejected(spark: SparkSession, d: str) -> DataFrame:
    """What the last run had stays unless it is fetched anew, rejected, archived, or fetched under another id."""
    c = calls(spark, d)
    previous = c.filter((F.col("id") % 2 == 0) & (F.col("deadline") > F.lit("1999-01-01").cast("timestamp_ntz")))
    fresh = c.filter("id % 6 = 0")
    rejected = c.filter("id % 10 = 0 and status = 'closed'").select("id")
    archived = c.filter("id % 14 = 0").select("id")
    kept = previous.join(fresh.select("id"), "id", "left_anti").join(rejected, "id", "left_anti").join(archived, "id", "left_anti").join(fresh.select("deadline"), "deadline", "left_anti")
    return kept.select("id", F.lit("kept").alias("origin")).unionByName(fresh.select("id", F.lit("fresh").alias("origin")))


@query("WITH a AS (SELECT p_brand AS id, 1 AS layer, list_distinct(list(p_type ORDER BY p_partkey)) AS t FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), b AS (SELECT p_brand AS id, 2, list_distinct(list(p_type ORDER BY p_partkey)) AS t FROM part WHERE p_partkey % 3 = 0 GROUP BY 1) SELECT coalesce(a.id, b.id) AS id, array_to_string(list_sort(list_distinct(list_concat(a.t, b.t))), ',') AS names, CASE WHEN b.id IS NULL THEN 1 ELSE 2 END AS layer FROM a FULL JOIN b ON a.id = b.id")
def union_later_overrides(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    side = lambda k, layer: p.filter(f"p_partkey % {k} = 0").groupBy(F.col("p_brand").alias("id")).agg(F.collect_set("p_type").alias("t")).withColumn("layer", F.lit(layer))
    both = side(2, 1).unionByName(side(3, 2)).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("t"), F.max("layer").alias("layer"))
    return both.select("id", F.array_join(F.sort_array("t"), ",").alias("names"), "layer")


@query(f"WITH {PAPERS_SQL}, l AS (SELECT id, list_concat(topics, [method, venue]) AS l FROM papers) SELECT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS union FROM l")
def ordered_union(spark: SparkSession, d: str) -> DataFrame:
    """First-occurrence order of united arrays."""
    p = papers(spark, d)
    return p.select("id", F.array_join(upserts.unique_union(F.col("topics"), F.array("method", "venue")), ",").alias("union"))


@query("SELECT 'inproceedings' AS kind, 'a' || p_partkey AS key, p_name || ' ' || p_brand AS title, 'Jane Doe;' || p_type || ' Roe' AS authors, '2030' AS year FROM part UNION ALL SELECT 'article', 'b' || p_partkey, 'Slow etudes', NULL, NULL FROM part")
def bibtex_scan(spark: SparkSession, d: str) -> DataFrame:
    """Two entries for each part: nested braces, quotes, accents, fields over several lines."""
    rows = parsers.bibtex(table(spark, d, "part").select(_bib_text()))
    f = F.col("fields")
    return rows.select("kind", "key", T.latex_text(f["title"]).alias("title"), F.array_join(parsers.author_names(f["author"]), ";").alias("authors"), f["year"].alias("year"))


def _bib_text() -> Column:
    n = F.col("p_partkey").cast("string")
    return F.concat(
        F.lit("% a comment\n@inproceedings{a"), n, F.lit(",\n title = {"), F.col("p_name"), F.lit(" {"), F.col("p_brand"), F.lit("}},\n author = {Doe, Jane and Roe,\n   "), F.col("p_type"), F.lit("},\n year = 2030\n}\n@article{b"), n, F.lit(", title = \"Slow \\'etudes\", doi={10.1/x}}\n"),
    ).alias("text")


@query("SELECT c_custkey AS toc, 0::BIGINT AS ord, 'On ' || c_mktsegment || ' Sets' AS title, 'Ann & Co|' || c_name AS authors, 2000 + c_nationkey AS year FROM customer UNION ALL SELECT c_custkey, 1, 'Second', '', NULL FROM customer")
def xml_toc_scan(spark: SparkSession, d: str) -> DataFrame:
    out = parsers.toc_papers(table(spark, d, "customer").select(F.col("c_custkey").alias("toc"), _toc_text()), "toc")
    return out.select("toc", "ord", "title", F.array_join("authors", "|").alias("authors"), "year")


def _toc_text() -> Column:
    return F.concat(
        F.lit("<toc><article key='x'><author>Ann &amp; Co</author><author>"), F.col("c_name"), F.lit("</author><title>On <i>"), F.col("c_mktsegment"), F.lit("</i>\n Sets</title><year>"), (2000 + F.col("c_nationkey")).cast("string"), F.lit("</year></article>\n<article><title>Second</title><year>bad</year></article></toc>"),
    ).alias("xml")


@query("SELECT 'inproceedings' AS kind, 'a' || p_partkey AS key, p_name || ' ' || p_brand AS title, 'Jane Doe;' || p_type || ' Roe' AS authors, '2030' AS year FROM part UNION ALL SELECT 'article', 'b' || p_partkey, 'Slow etudes', NULL, NULL FROM part")
def bibtex_file_scan(spark: SparkSession, d: str) -> DataFrame:
    """The same entries out of .bib files, which many tasks read."""
    path = staging.shared_path(spark, "bib")
    table(spark, d, "part").select(_bib_text()).write.text(path)
    rows, f = parsers.bibtex_files(spark, path), F.col("fields")
    return rows.select("kind", "key", T.latex_text(f["title"]).alias("title"), F.array_join(parsers.author_names(f["author"]), ";").alias("authors"), f["year"].alias("year"))


@query("SELECT 'On ' || c_mktsegment || ' Sets' AS title, 'Ann & Co|' || c_name AS authors, 2000 + c_nationkey AS year FROM customer UNION ALL SELECT 'Second', '', NULL FROM customer")
def xml_file_scan(spark: SparkSession, d: str) -> DataFrame:
    """The records of XML index files, which many tasks read."""
    path = staging.shared_path(spark, "toc")
    table(spark, d, "customer").select(_toc_text()).write.text(path)
    return parsers.toc_files(spark, path).select("title", F.array_join("authors", "|").alias("authors"), "year")


@query("SELECT c_custkey AS page, c_name AS title, 'Due 1 June 2030' AS status FROM customer UNION ALL SELECT c_custkey, 'Beta 2030', CASE WHEN c_custkey % 2 = 0 THEN 'Open' ELSE 'Due 12 March 2030' END FROM customer")
def directory_text_scan(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("Home\nOld Venue\nDue 1 May\nOpen for Submissions\n"), F.col("c_name"), F.lit("\nOpen\nBeta 2030\n"), F.when(F.col("c_custkey") % 2 == 0, "Open").otherwise("Due 12 March 2030"), F.lit("\n\n"), F.col("c_name"), F.lit("\nDue 1 June 2030\n"))
    return parsers.directory_text(table(spark, d, "customer").select(F.col("c_custkey").alias("page"), text.alias("text")), "page", "Open for Submissions")


@query("""WITH c AS (SELECT c_custkey AS k, c_name AS name FROM customer)
SELECT k AS page, 'Conf.org/' || k || '/Main Track' AS group_id, name || chr(39) || 's OpenML Workshop' AS title, CASE WHEN k % 3 = 0 THEN 'due' ELSE 'open' END AS status, CASE WHEN k % 3 = 0 THEN TIMESTAMP '2030-03-13 03:59:00' END AS due FROM c
UNION ALL SELECT k, 'Conf.org/' || k || '/B', CASE WHEN k % 2 = 0 THEN 'Beta again' ELSE 'Beta' END, CASE WHEN k % 2 = 0 THEN 'due' ELSE 'open' END, CASE WHEN k % 2 = 0 THEN TIMESTAMP '2030-06-01 12:00:00' END FROM c""")
def directory_titles_links(spark: SparkSession, d: str) -> DataFrame:
    """Titles in a directory's text, joined to its links by their text, one entry for each group."""
    k = F.col("c_custkey")
    status = F.when(k % 3 == 0, "Due 12 Mar 2030 at 23:59 Eastern Daylight Time").otherwise("open for submissions")
    again = F.when(k % 2 == 0, "Due 1 June 2030 at 12:00 UTC").otherwise("Open for Submissions")
    text = F.concat(F.lit("Open\nEarly\nOpen for submissions\n  Active Venues\r\nOpen for Submissions\n"), F.col("c_name"), F.lit("’s  OpenML Workshop \n"), status, F.lit("\nUnlinked 2030\nOpen for Submissions\nBeta\nOpen for Submissions\nDue Diligence Days\nno status\nBeta again\n"), again)
    anchor = lambda t, h: F.struct(t.alias("text"), F.concat(*h).alias("href"))
    key, loud = k.cast("string"), F.concat(F.upper("c_name"), F.lit("'S OPENML WORKSHOP"))
    anchors = F.array(
        anchor(loud, (F.lit("/other?id="), key)), anchor(loud, (F.lit("/group?id=Conf.org%2F"), key, F.lit("%2FMain%20Track&x=1"))),
        anchor(F.concat(F.col("c_name"), F.lit("'s OpenML Workshop")), (F.lit("/group?id=Later"), key)), anchor(F.lit("Beta"), (F.lit("https://openreview.net/group?id=Conf.org/"), key, F.lit("/B#tab"))), anchor(F.lit("Beta  again"), (F.lit("/group?id=Conf.org/"), key, F.lit("/B"))),
        anchor(F.lit("Due Diligence Days"), (F.lit("/group?id=Days"), key)),
    )
    pages = table(spark, d, "customer").select(k.alias("page"), text.alias("text"), anchors.alias("anchors"))
    out = parsers.directory_titles(pages, "page")
    return out.withColumn("title", F.replace("title", F.lit("’"), F.lit("'")))


_ITEMS = {
    "venues": "id || '/' || name", "venue_aliases": "venue_id || '/' || alias", "venue_external_ids": "venue_id || '/' || provider || '/' || external_id", "venue_editions": "id || '/' || venue_id || '/' || event_year", "papers": "id || '/' || title",
    "paper_authors": "paper_id || '/' || author_position || '/' || author_name", "paper_external_ids": "paper_id || '/' || provider || '/' || external_id", "edition_papers": "edition_id || '/' || paper_id || '/' || membership_status",
    "venue_insights": "venue_id || '/' || paper_count", "ingestion_runs": "provider || '/' || state",
}


def _snapshot(spark: SparkSession, d: str, second: bool) -> dict[str, DataFrame]:
    """suppliers as venues, parts as papers, lineitems as what appeared in a venue's yearly edition; the second snapshot has some venues only."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    s = table(spark, d, "supplier")
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", F.year("l_shipdate").alias("event_year"), "l_linestatus", "l_returnflag")
    if second:
        s = s.filter("s_nationkey < 12")
        li = li.filter("l_returnflag = 'R'").join(s.select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey", "left_semi")
    edition = F.concat(key("e", "l_suppkey"), F.lit("-"), F.col("event_year").cast("string"))
    venue, p = key("v", "s_suppkey"), table(spark, d, "part")
    out = {
        "venues": s.select(venue.alias("id"), F.concat("s_name", F.lit("!" if second else "")).alias("name")),
        "venue_aliases": s.select(venue.alias("venue_id"), key("n", "s_nationkey").alias("alias")),
        "venue_editions": li.select("l_suppkey", "event_year").distinct().select(edition.alias("id"), key("v", "l_suppkey").alias("venue_id"), "event_year"),
        "edition_papers": li.groupBy("l_suppkey", "event_year", "l_partkey").agg(F.min("l_linestatus").alias("membership_status")).select(edition.alias("edition_id"), key("p", "l_partkey").alias("paper_id"), "membership_status"),
        "venue_insights": li.groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("paper_count")).select(key("v", "l_suppkey").alias("venue_id"), "paper_count"),
        "ingestion_runs": s.groupBy().agg(F.count("*").alias("n")).select(F.lit("venue-history-sync").alias("provider"), F.lit("second" if second else "first").alias("state")),
    }
    if second:
        return out
    paper = key("p", "p_partkey")
    author = F.array(F.struct(F.lit(1).alias("author_position"), F.col("p_brand").alias("author_name")), F.struct(F.lit(2).alias("author_position"), F.col("p_type").alias("author_name")))
    return out | {
        "venue_external_ids": s.select(venue.alias("venue_id"), F.lit("dblp").alias("provider"), F.lower("s_name").alias("external_id")),
        "papers": p.select(paper.alias("id"), F.col("p_name").alias("title")),
        "paper_authors": p.select(paper.alias("paper_id"), F.inline(author)),
        "paper_external_ids": p.select(paper.alias("paper_id"), F.lit("type").alias("provider"), F.col("p_type").alias("external_id")),
    }


@query("""WITH t AS (SELECT s_suppkey AS k FROM supplier WHERE s_nationkey < 12), l AS (SELECT l_suppkey, l_partkey, year(l_shipdate) AS y, l_linestatus FROM lineitem WHERE l_suppkey NOT IN (SELECT k FROM t) OR l_returnflag = 'R'),
i AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1), j AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey IN (SELECT k FROM t) GROUP BY 1)
SELECT 'venues' AS table_name, 'v' || s_suppkey || '/' || s_name || CASE WHEN s_nationkey < 12 THEN '!' ELSE '' END AS item FROM supplier
UNION ALL SELECT 'venue_aliases', 'v' || s_suppkey || '/n' || s_nationkey FROM supplier
UNION ALL SELECT 'venue_external_ids', 'v' || s_suppkey || '/dblp/' || lower(s_name) FROM supplier WHERE s_nationkey >= 12
UNION ALL SELECT DISTINCT 'venue_editions', 'e' || l_suppkey || '-' || y || '/v' || l_suppkey || '/' || y FROM l
UNION ALL SELECT 'papers', 'p' || p_partkey || '/' || p_name FROM part
UNION ALL SELECT 'paper_authors', 'p' || p_partkey || '/1/' || p_brand FROM part UNION ALL SELECT 'paper_authors', 'p' || p_partkey || '/2/' || p_type FROM part
UNION ALL SELECT 'paper_external_ids', 'p' || p_partkey || '/type/' || p_type FROM part
UNION ALL SELECT 'edition_papers', 'e' || l_suppkey || '-' || y || '/p' || l_partkey || '/' || min(l_linestatus) FROM l GROUP BY l_suppkey, y, l_partkey
UNION ALL SELECT 'venue_insights', 'v' || i.l_suppkey || '/' || coalesce(j.n, i.n) FROM i LEFT JOIN j USING (l_suppkey)
UNION ALL SELECT 'ingestion_runs', 'venue-history-sync/' || x FROM (VALUES ('first'), ('second')) v(x)""")
def history_commits(spark: SparkSession, d: str) -> DataFrame:
    """Two commits of the ten tables, and what a reader of the second one sees."""
    folder = staging.shared_path(spark, "history")
    for second in (False, True):
        commits.commit(spark, folder, _snapshot(spark, d, second))
    now = commits.Version(spark, folder)
    parts = [now.table(name).select(F.lit(name).alias("table_name"), F.expr(item).alias("item")) for name, item in _ITEMS.items()]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The events table, a file or a folder of files, as a stream of files."""
    path, fs = sinks._fs(spark, f"{d}/events.parquet")
    files = spark.readStream.schema(table(spark, d, "events").schema)
    return files.parquet(f"{d}/events.parquet") if fs.getFileStatus(path).isDirectory() else files.option("pathGlobFilter", "events.parquet").parquet(d)


@query("""WITH e AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next, max(ts) OVER () AS last FROM events)
SELECT user_id, ts + INTERVAL 6 HOUR AS lapsed_at FROM e WHERE CASE WHEN next IS NULL THEN date_trunc('milliseconds', ts + INTERVAL 6 HOUR) < date_trunc('milliseconds', last) ELSE next > ts + INTERVAL 6 HOUR END""")
def lease_lapses(spark: SparkSession, d: str) -> DataFrame:
    """When each user's lease of six hours, which every event renews, ran out: keyed state with timers, over the events as a stream."""
    out, check = staging.shared_path(spark, "lapses"), staging.shared_path(spark, "check")
    old = spark.conf.get(leases.STORE[0])
    spark.conf.set(*leases.STORE)
    try:
        stream = leases.lapses(_events(spark, d), "user_id", 6 * 3600)
        stream.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out).awaitTermination()
    finally:
        spark.conf.set(leases.STORE[0], old)
    return spark.read.schema(stream.schema).parquet(out)


@query("SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN 'deferred' ELSE 'accepted' END AS state FROM events")
def ledger_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream through the batch ledger: repeats dropped, errors deferred, all others accepted once."""
    folder = staging.shared_path(spark, "ledger")
    ledger.ingest(_events(spark, d).select("event_id", "ts", "event_type"), folder, lambda: F.col("event_type") != "error", late="365 days", tries=1_000)
    return ledger.state(spark, folder).select("event_id", "event_type", "state")


@query("""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, event_type, event_id, ts, i, ts AS window_start, 1 AS c FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_type, e.event_id, e.ts, e.i, CASE WHEN e.ts >= r.window_start + INTERVAL 1 DAY THEN e.ts ELSE r.window_start END, CASE WHEN e.ts >= r.window_start + INTERVAL 1 DAY THEN 1 ELSE r.c + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.i = r.i + 1)
SELECT event_type, user_id, event_id, window_start, c <= 1 AS allowed FROM r""")
def anchored_rate_window(spark: SparkSession, d: str) -> DataFrame:
    return windows.rate_limited(table(spark, d, "events"), ["event_type", "user_id"], 86_400, 1)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def extra_tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = windows.tumbling(table(spark, d, "events"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("WITH g AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS n FROM events)) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, s")
def extra_sessions(spark: SparkSession, d: str) -> DataFrame:
    return windows.sessions(table(spark, d, "events")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def extra_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").rollup(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("WITH q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q, vec_id, round(list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]), 6) AS cosine FROM q, embeddings WHERE vec_id <> q) SELECT q, vec_id, cosine FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY cosine DESC, vec_id) <= 10")
def extra_cosine_all(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 50 against all, block by block."""
    v = spread(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")))
    return vectors.nearest(v, v.filter("id % 50 = 0"), 10)
