"""Queries on page text, URLs, tags, evidence and admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duecall.functions import dates as D
from duecall.functions import text as T
from duecall.operators import deadlines, merge
from duecall.operators import evidence as E
from duecall.sources.tables import PAPERS_SQL, papers, spread, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def inline(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, columns)


def values(rows: list[tuple], names: str) -> str:
    cell = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) v({names})"


_HOST = r"regexp_replace(lower(nullif(regexp_extract(url, '^(?i:https?)://(?:[^/?#@]*@)?([^/:?#]+)', 1), '')), '^www\.', '')"


@query(f"SELECT page_id, {_HOST} AS host, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page_no, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, {_HOST} = 'example.com' OR {_HOST} LIKE '%.example.com' AS on_list FROM pages")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    url, host = F.col("url"), T.host(F.col("url"))
    number = F.nullif(F.regexp_extract(url, "[?&]page=([^&#]*)", 1), F.lit(""))
    return table(spark, d, "pages").select("page_id", host.alias("host"), number.alias("page_no"), F.regexp_extract(url, "^([a-z]+)://", 1).alias("scheme"), T.allowed(host, ["example.com"]).alias("on_list"))


@query("""WITH a AS (SELECT page_id, regexp_replace(coalesce(html, ''), '<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'gsi') AS t FROM pages), b AS (SELECT page_id, regexp_replace(regexp_replace(t, '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM b) SELECT page_id, md5(t) AS text_md5, length(t) AS n_chars FROM c""")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "pages").select("page_id", T.html_text(F.col("html")).alias("t"))
    return t.select("page_id", F.md5(F.col("t").cast("binary")).alias("text_md5"), F.length("t").cast("long").alias("n_chars"))


@query("""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?is)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2)) AS txt FROM pages)
SELECT page_id, href, trim(regexp_replace(regexp_replace(txt, '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS anchor, regexp_extract(url, '^(https?://[^/?#]+)', 1) || href AS absolute FROM l WHERE href LIKE '/%'""")
def link_extract(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select("page_id", "url", F.inline(T.links(F.col("html")))).filter(F.col("href").startswith("/"))
    return rows.select("page_id", "href", F.col("text").alias("anchor"), T.resolved(F.col("href"), F.col("url")).alias("absolute"))


@query(f"WITH h AS (SELECT page_id, {_HOST} AS host FROM pages) SELECT page_id, host, count(*) OVER (PARTITION BY host) AS n, CASE WHEN count(*) OVER (PARTITION BY host) > 2 THEN 'directory' ELSE 'direct' END AS link_kind FROM h")
def shared_link_multiplicity(spark: SparkSession, d: str) -> DataFrame:
    """Counts are aggregated before they are joined back: a host with very many pages is one row."""
    pages = table(spark, d, "pages").select("page_id", T.host(F.col("url")).alias("host"))
    n = pages.groupBy("host").agg(F.count("*").alias("n"))
    return pages.join(n, "host").select("page_id", "host", "n", F.when(F.col("n") > 2, "directory").otherwise("direct").alias("link_kind"))


_RULES = [("Metals", "brass|copper|steel|tin|nickel"), ("Colours", "blue|red|green|white|black"), ("Sizes", "small|large|medium|economy|promo")]


def _case(col: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '{p}') THEN '{n}'" for n, p in _RULES) + " ELSE 'Other' END"


@query(f"SELECT {_case('lower(p_name || chr(32) || p_type)')} AS domain, count(*) AS n FROM part GROUP BY 1")
def macro_domain_case(spark: SparkSession, d: str) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    return table(spark, d, "part").groupBy(T.ruled(text, _RULES, "Other").alias("domain")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(p_name || ' ' || p_type), '{p}') THEN '{n}' END" for n, p in _RULES) + "], lambda x: x IS NOT NULL), '+') AS tags, CASE WHEN " + " OR ".join(f"regexp_matches(lower(p_name), '{p}')" for _, p in _RULES) + " THEN 'title' ELSE 'body' END AS evidence FROM part")
def multilabel_tags(spark: SparkSession, d: str) -> DataFrame:
    both, title = F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lower("p_name")
    seen = F.when(F.size(T.labels(title, _RULES)) > 0, "title").otherwise("body")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(T.labels(both, _RULES), "+").alias("tags"), seen.alias("evidence"))


@query(f"WITH {PAPERS_SQL} SELECT t AS label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, t) AS ord FROM (SELECT unnest(topics) AS t FROM papers) GROUP BY t")
def label_histogram(spark: SparkSession, d: str) -> DataFrame:
    n = papers(spark, d).select(F.explode("topics").alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return n.withColumn("ord", F.row_number().over(Window.orderBy(F.desc("n"), "label")).cast("long"))


@query(f"WITH {PAPERS_SQL} SELECT venue, min(year) AS start_year, max(year) AS end_year, count(*) AS n_papers, count(DISTINCT year) AS n_editions, bool_or(open_url IS NOT NULL) AS any_open, CASE WHEN count(*) > 0 THEN 'verified' ELSE 'partial' END AS status FROM papers GROUP BY venue")
def venue_insights(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d).groupBy("venue").agg(F.min("year").alias("start_year"), F.max("year").alias("end_year"), F.count("*").alias("n_papers"), F.count_distinct("year").alias("n_editions"), F.bool_or(F.col("open_url").isNotNull()).alias("any_open"), F.when(F.count("*") > 0, "verified").otherwise("partial").alias("status"))


@query(r"""SELECT p_partkey AS id, regexp_replace(lower(regexp_replace(p_brand, '(?:19|20)[0-9][0-9]', '', 'g')), '[^a-z0-9]', '', 'g') AS acronym, regexp_replace(substr(regexp_replace(lower(p_name || ' & ' || p_type), '[^a-z0-9]+', '-', 'g'), 1, 20), '^-+|-+$', '', 'g') AS slug,
 trim(regexp_replace(replace(lower(p_name || ' & ' || p_type), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS name FROM part""")
def normal_forms(spark: SparkSession, d: str) -> DataFrame:
    both = F.concat(F.col("p_name"), F.lit(" & "), F.col("p_type"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.acronym(F.col("p_brand")).alias("acronym"), T.slug(both, 20).alias("slug"), T.name_text(both).alias("name"))


_DIGITS = "lpad((p_partkey * 7919 % 10000000)::VARCHAR, 7, '0')"
_CHECK = "(11 - (" + " + ".join(f"{9 - k} * substr(s, {k}, 1)::INT" for k in range(1, 8)) + ") % 11) % 11"


@query(f"""WITH i AS (SELECT p_partkey AS id, p_size, {_DIGITS} AS s FROM part), c AS (SELECT *, CASE WHEN {_CHECK} = 10 THEN 'X' ELSE ({_CHECK})::VARCHAR END AS x, (({_CHECK}) + 1) % 10 AS wrong FROM i)
SELECT id, CASE id % 4 WHEN 0 THEN '10.1000/abc.' || id WHEN 1 THEN '10.5555/x_' || id END AS doi, CASE WHEN id % 3 <> 0 THEN s[1:4] || '-' || s[5:7] || x END AS issn FROM c""")
def doi_issn_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers in several spellings, right and wrong, made from each part's key."""
    n, text = F.col("p_partkey"), F.col("p_partkey").cast("string")
    s = F.lpad((n * 7919 % 10_000_000).cast("string"), 7, "0")
    total = sum((F.substring(s, k, 1).cast("int") * (9 - k) for k in range(1, 8)), F.lit(0))
    check = (11 - total % 11) % 11
    right = F.when(check == 10, "x").otherwise(check.cast("string"))
    issn = F.concat(F.substring(s, 1, 4), F.when(n % 2 == 0, "-").otherwise(""), F.substring(s, 5, 3), F.when(n % 3 == 0, ((check + 1) % 10).cast("string")).otherwise(right))
    doi = F.when(n % 4 == 0, F.concat(F.lit("https://doi.org/10.1000/ABC."), text)).when(n % 4 == 1, F.concat(F.lit("doi: 10.5555/x_"), text, F.lit(")."))).when(n % 4 == 2, "10.12/short")
    return table(spark, d, "part").select(n.alias("id"), T.doi(doi).alias("doi"), T.issn(issn).alias("issn"))


@query("WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM benchmark) SELECT item_id, string_agg(w, ' ' ORDER BY i) AS text FROM w GROUP BY item_id")
def inverted_index_text(spark: SparkSession, d: str) -> DataFrame:
    """A map word -> positions back into its text."""
    words = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("i", "w"))
    index = words.groupBy("item_id", "w").agg(F.collect_list("i").alias("at")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "at"))).alias("index"))
    places = F.flatten(F.transform(F.map_entries("index"), lambda e: F.transform(e["value"], lambda i: F.struct(i.alias("i"), e["key"].alias("w")))))
    return index.select("item_id", F.array_join(F.transform(F.sort_array(places), lambda x: x["w"]), " ").alias("text"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN make_timestamp(1700000000000000 + event_id * 1000000) WHEN 1 THEN make_timestamp((1700000000000 + event_id) * 1000) END AS at FROM events")
def epoch_coercion(spark: SparkSession, d: str) -> DataFrame:
    """Seconds, milliseconds, numbers that are no time, and nothing."""
    n = F.col("event_id")
    raw = F.when(n % 4 == 0, 1_700_000_000 + n).when(n % 4 == 1, 1_700_000_000_000 + n).when(n % 4 == 2, -n)
    return table(spark, d, "events").select("event_id", D.from_epoch(raw).alias("at"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN 'skipped' WHEN o_orderkey % 7 = 0 THEN 'unreachable' WHEN l.ship IS NULL THEN 'unverified' WHEN abs(epoch(l.ship) - epoch(o_orderdate)) / 86400 <= 1.5 THEN 'confirmed' ELSE 'mismatch' END AS verdict FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS ship FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey""")
def days_apart_verdict(spark: SparkSession, d: str) -> DataFrame:
    ship = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("ship"))
    o = table(spark, d, "orders").join(ship, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    verdict = E.deadline_verdict(F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderdate")), F.col("ship"), F.col("o_orderkey") % 7 != 0)
    return o.select(F.col("o_orderkey").alias("id"), verdict.alias("verdict"))


def _dated(spark: SparkSession, d: str) -> DataFrame:
    """orders as page texts that hold the order's date in several forms, moved to 2030."""
    at = F.date_add(F.col("o_orderdate").cast("date"), 0)
    day = lambda form, plus=0: F.date_format(F.date_add(at, plus), form.replace("yyyy", "'2030'"))
    text = F.concat(
        F.lit("Important dates 2030\nAbstract deadline: "), day("MMMM d, yyyy"), F.lit(" AoE. Full paper submission deadline "), day("d MMM yyyy", 7),
        F.lit(". Late-breaking submission deadline: "), day("yyyy-MM-dd", 30), F.lit("; Notification and camera-ready: "), day("MMM d yyyy", 40), F.lit(" and "), day("d MMMM yyyy", 50), F.lit(". Reviewers meet "), day("MMMM d, yyyy", 60),
    )
    return spread(table(spark, d, "orders").select("o_orderkey", "o_orderdate")).select(F.col("o_orderkey").alias("id"), at.alias("at"), text.alias("text"))


#: The years in the texts are all 2030, so days that 2030 lacks have no date.
_MOVED = "try_strptime(strftime({}, '2030-%m-%d') || ' 23:59', '%Y-%m-%d %H:%M')"


@query(f"""WITH o AS (SELECT DISTINCT o_orderdate::DATE AS dt FROM orders),
t AS (SELECT dt, 'abstract_submission' AS type, 2 AS p, {_MOVED.format('dt')} + INTERVAL 12 HOUR AS date FROM o UNION ALL SELECT dt, 'main_submission', 1, {_MOVED.format('dt + 7')} FROM o UNION ALL SELECT dt, 'late_breaking_submission', 3, {_MOVED.format('dt + 30')} FROM o
 UNION ALL SELECT dt, k, 99, d FROM (SELECT dt, unnest([{_MOVED.format('dt + 40')}, {_MOVED.format('dt + 50')}]) AS d FROM o), (VALUES ('notification'), ('camera_ready')) v(k)),
n AS (SELECT DISTINCT * FROM t WHERE date >= TIMESTAMP '2030-03-01' - INTERVAL 1 DAY AND date <= TIMESTAMP '2030-03-01' + INTERVAL 550 DAY),
c AS (SELECT dt, type, date FROM n WHERE p < 99 AND date > TIMESTAMP '2030-03-01' QUALIFY row_number() OVER (PARTITION BY dt ORDER BY p, date, type) = 1)
SELECT o_orderkey AS id, n.type, n.date, coalesce(n.type = c.type AND n.date = c.date, false) AS chosen FROM orders JOIN n ON n.dt = o_orderdate::DATE LEFT JOIN c ON c.dt = n.dt""")
def deadline_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Labelled deadlines in page texts, and the track to show."""
    now = F.lit("2030-03-01 00:00:00").cast("timestamp_ntz")
    return deadlines.tracks(_dated(spark, d).select("id", "text"), now).select("id", "type", "date", "chosen")


@query(f"""WITH o AS (SELECT o_orderkey AS id, o_orderdate::DATE AS dt FROM orders), p AS (SELECT id, {_MOVED.format('dt')} AS d FROM o)
SELECT id, CASE WHEN id % 4 <> 0 THEN d END AS book_due, CASE WHEN id % 2 = 0 THEN d END AS reviewer_due, CASE WHEN id % 3 = 0 THEN d END AS opens_at,
 CASE WHEN id % 3 = 0 THEN coalesce(d <= TIMESTAMP '2030-07-01', true) ELSE id % 3 = 1 END AS open_now FROM p""")
def labelled_deadlines(spark: SparkSession, d: str) -> DataFrame:
    """The dates that book, reviewer and opening announcements name."""
    now = F.lit("2030-07-01 00:00:00").cast("timestamp_ntz")
    on = F.regexp_replace(F.date_format(F.col("at"), "MMMM d, yyyy"), "[0-9]{4}", "2030")
    book = F.when(F.col("id") % 4 == 0, "Closing remarks of the book.").otherwise(F.concat(F.lit("Chapter proposals are due by "), on, F.lit(".")))
    reviewer = F.concat(F.lit("Reviewer "), F.when(F.col("id") % 2 == 0, "application").otherwise("dinner"), F.lit(" deadline: "), F.regexp_replace(F.date_format(F.col("at"), "d MMM"), "$", " 2030"))
    site = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Submissions open on "), on, F.lit("."))).when(F.col("id") % 3 == 1, "Submissions are now open.").otherwise("The submission site is closed. Submissions are closed.")
    rows = _dated(spark, d).select("id", D.labelled_date(book, D.BOOK_LABELS, now).alias("book_due"), D.labelled_date(reviewer, D.REVIEWER_LABELS, now).alias("reviewer_due"), D.opening(site, now).alias("o"))
    return rows.select("id", "book_due", "reviewer_due", "o.opens_at", "o.open_now")


@query(f"""WITH o AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%d %b 2030 at ') || lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':45 ' AS t, try_strptime(strftime(o_orderdate, '2030-%m-%d ') || lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':45', '%Y-%m-%d %H:%M') AS local FROM orders)
SELECT id, CASE id % 4 WHEN 0 THEN local + INTERVAL 4 HOUR WHEN 1 THEN local + INTERVAL 8 HOUR WHEN 2 THEN local + INTERVAL 12 HOUR ELSE NULL END AS due FROM o""")
def due_text_zones(spark: SparkSession, d: str) -> DataFrame:
    """The directory's due texts with named zones, in UTC."""
    zone = F.get(F.array(*map(F.lit, ["Eastern Daylight Time", "Pacific Standard Time", "AoE", "Nowhere Time"])), (F.col("o_orderkey") % 4).cast("int"))
    text = F.concat(F.lit("Due "), F.date_format("o_orderdate", "dd MMM"), F.lit(" 2030 at "), F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(":45 "), zone)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), D.due_text(text).alias("due"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 5 THEN '' ELSE p_name || CASE WHEN p_partkey % 6 = 4 THEN ' symposium 2030 superposters' ELSE ' symposium 2030' END END AS base, CASE WHEN p_partkey % 6 = 5 THEN '' ELSE replace(p_name, ' ', '') || '2030' || CASE WHEN p_partkey % 6 = 4 THEN 'superposters' ELSE '' END END AS key FROM part""")
def title_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Titles without the names of tracks at their end, whole words only."""
    n, tails = F.col("p_partkey"), ["", " - Research Track", ": Short Papers (Posters)", " demo track  submissions", " superposters"]
    title = F.when(n % 6 == 5, "Proceedings").otherwise(F.concat(F.col("p_name"), F.lit(" symposium  2030"), F.get(F.array(*map(F.lit, tails)), (n % 6).cast("int"))))
    return table(spark, d, "part").select(n.alias("id"), merge.base_title(title).alias("base"), merge.title_key(title).alias("key"))


@query("""WITH d AS (SELECT doc_id, text, lang, source, n_chars, contains(text, 'icense') AS lic, regexp_matches(text, '[A-Z]{12}') AS shout, l.quality, l.toxic FROM documents LEFT JOIN labels l USING (doc_id)),
r AS (SELECT doc_id, list_filter([CASE WHEN NOT n_chars > 500 THEN 'too-short' END, CASE WHEN shout THEN 'red-flag' END, CASE WHEN NOT coalesce(toxic = 0, false) THEN 'not-vetted' END, CASE WHEN NOT (coalesce(quality, 0) = 1 OR lic) THEN 'no-evidence' END, CASE WHEN lang NOT IN ('en', 'de') THEN 'off-scope' END], lambda x: x IS NOT NULL) AS r FROM d)
SELECT doc_id, array_to_string(r, ',') AS reasons, len(r) = 0 AS admitted FROM r""")
def admission_reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    rules = {
        "too-short": F.col("n_chars") > 500,
        "red-flag": ~F.col("text").rlike("[A-Z]{12}"),
        "not-vetted": F.col("toxic") == 0,
        "no-evidence": (F.coalesce("quality", F.lit(0)) == 1) | F.col("text").contains("icense"),
        "off-scope": F.col("lang").isin("en", "de"),
    }
    return E.assessed(rows, rules).select("doc_id", F.array_join("reasons", ",").alias("reasons"), "admitted")


@query(f"""WITH f AS (SELECT page_id, url LIKE 'https:%' AS secure, {_HOST} LIKE '%.org' AS approved, {_HOST} LIKE 'm.%' AS suspicious, length(html) > 3000 AS established, html LIKE '%<article>%' AS official, page_id % 9 = 0 AS unreachable FROM pages),
s AS (SELECT *, approved::INT + 3 * (established AND secure)::INT + 2 * official::INT AS g, 2 * suspicious::INT + unreachable::INT + (NOT established)::INT * 2 AS b, established AND secure AS dec FROM f)
SELECT page_id, CASE WHEN b >= 3 OR (b >= 2 AND NOT dec) THEN 'caution' WHEN dec AND g >= 3 AND b = 0 THEN 'trusted' ELSE 'review' END AS level, (g - b)::BIGINT AS score, CASE WHEN dec THEN 'corroborated' ELSE 'partial' END AS quality FROM s""")
def legitimacy_score(spark: SparkSession, d: str) -> DataFrame:
    host, url = T.host(F.col("url")), F.col("url")
    established, secure = F.length("html") > 3000, url.startswith("https:")
    good = {"approved-host": (host.endswith(".org"), 1), "established": (established & secure, 3), "official-page": (F.col("html").contains("<article>"), 2)}
    bad = {"suspicious-host": (host.startswith("m."), 2), "unreachable": (F.col("page_id") % 9 == 0, 1), "not-established": (~established, 2)}
    out = E.weighed(good, bad, established & secure)
    return table(spark, d, "pages").select("page_id", out.alias("s")).select("page_id", "s.level", "s.score", "s.quality")


@query("""WITH e AS (SELECT c_nationkey AS venue, c_mktsegment AS source, CASE WHEN o_orderkey % 3 = 0 THEN date_part('year', o_orderdate) END AS year, o_orderkey % 17 = 0 AS official, o_orderkey % 5 = 0 AS link FROM orders JOIN customer ON o_custkey = c_custkey),
a AS (SELECT venue, count(DISTINCT year) AS n_years, count(DISTINCT CASE WHEN year IS NOT NULL THEN source END) AS n_sources, count(DISTINCT CASE WHEN year >= 1996 AND year < 2000 THEN year END) AS n_recent, bool_or(official) AS o, bool_or(link) AS l FROM e GROUP BY venue)
SELECT venue, n_years, n_sources, n_recent, n_recent >= 1 AND (n_sources >= 2 OR (o AND l)) AS established FROM a""")
def evidence_fusion(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select(F.col("c_nationkey").alias("venue"), F.col("c_mktsegment").alias("source"), F.when(F.col("o_orderkey") % 3 == 0, F.year("o_orderdate")).alias("year"), (F.col("o_orderkey") % 17 == 0).alias("official"), (F.col("o_orderkey") % 5 == 0).alias("link"))
    return E.fused(rows, "venue", F.lit(2000))


@query("WITH w AS (SELECT doc_id, trim(regexp_replace(replace(strip_accents(lower(text)), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS w FROM documents) SELECT doc_id, round(least(1, CASE WHEN contains(' ' || w || ' ', ' mit ') THEN 0.55 ELSE 0 END + 0.45 * (contains(w, 'licens')::INT + contains(w, 'apache')::INT + contains(w, 'public')::INT + contains(w, 'work')::INT) / 4), 6)::DOUBLE AS score FROM w")
def venue_match_score(spark: SparkSession, d: str) -> DataFrame:
    score = T.let(T.name_text(F.col("text")), lambda t: E.venue_score("mit", "the licens apache of public work", t))
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.round(score, 6).alias("score"))


@query("SELECT doc_id, CASE WHEN length(text) <= 600 THEN text ELSE substr(text, 1, 170) || ' [...] ' || substr(text, (length(text) - 170) // 2 + 1, 170) || ' [...] ' || right(text, 170) END AS excerpt FROM documents")
def excerpt_thirds(spark: SparkSession, d: str) -> DataFrame:
    """Begin, middle and end of a long text, a third of the room each."""
    t, n, k = F.col("text"), F.length("text"), (600 - 90) // 3
    middle = F.substr(t, F.floor((n - k) / 2).cast("int") + 1, F.lit(k))
    return table(spark, d, "documents").select("doc_id", F.when(n <= 600, t).otherwise(F.concat(F.substring(t, 1, k), F.lit(" [...] "), middle, F.lit(" [...] "), F.substr(t, n - k + 1, F.lit(k)))).alias("excerpt"))


@query("WITH s AS (SELECT doc_id, list_filter(string_split(text, '. '), lambda s: contains(lower(s), 'licen') OR contains(lower(s), 'rights')) AS s FROM documents) SELECT doc_id, len(s) AS n, substr(array_to_string(s[1:18], ' | '), 1, 700) AS excerpt FROM s WHERE len(s) > 0")
def sentence_excerpts(spark: SparkSession, d: str) -> DataFrame:
    hits = F.filter(F.split("text", r"\. "), lambda s: F.lower(s).contains("licen") | F.lower(s).contains("rights"))
    rows = table(spark, d, "documents").select("doc_id", hits.alias("s")).filter(F.size("s") > 0)
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.substring(F.array_join(F.slice("s", 1, 18), " | "), 1, 700).alias("excerpt"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_exists(props, '$.missing') AS other FROM events")
def json_unwrap(spark: SparkSession, d: str) -> DataFrame:
    v = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "string").alias("k"), F.try_variant_get(v, "$.missing", "string").isNotNull().alias("other"))


@query("SELECT p_partkey AS id, p_brand || ': ' || p_name || ' & <' || p_type || '>' AS text FROM part")
def xml_entities(spark: SparkSession, d: str) -> DataFrame:
    xml = F.concat(F.lit("<h2 class='x'>"), F.col("p_brand"), F.lit(":\n <i>"), F.col("p_name"), F.lit("</i> &amp; &lt;"), F.col("p_type"), F.lit("&gt;</h2>"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.xml_text(xml).alias("text"))


@query("SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN '203.0.113.' || c_custkey % 250 WHEN 1 THEN '198.51.100.' || c_custkey % 250 WHEN 4 THEN '2001:db8::' || c_custkey % 250 ELSE 'anonymous' END AS client FROM customer")
def client_key(spark: SparkSession, d: str) -> DataFrame:
    """The right-most valid address of a forwarding header, of either kind."""
    n = (F.col("c_custkey") % 250).cast("string")
    heads = [("10.0.0.1, 203.0.113.", ""), ("198.51.100.", ", 999.1.1.1, bad"), ("unknown", ""), (None, ""), ("10.0.0.1 , 2001:db8::", "")]
    header = F.coalesce(*(F.when(F.col("c_custkey") % 5 == k, F.concat(F.lit(a).cast("string"), F.when(F.lit(k not in (2, 3)), n).otherwise(""), F.lit(b))) for k, (a, b) in enumerate(heads)))
    four = lambda x: x.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$") & F.forall(F.split(x, r"\."), lambda o: o.try_cast("int") <= 255)
    six = lambda x: x.contains(":") & x.rlike(r"^(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}$") & ~x.rlike(":::|::.*::")
    valid = F.filter(F.reverse(F.transform(F.split(header, ","), lambda x: F.trim(x))), lambda x: four(x) | six(x))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.coalesce(F.get(valid, F.lit(0)), F.lit("anonymous")).alias("client"))


@query("WITH a AS (SELECT o_custkey AS id, list(o_orderpriority ORDER BY o_orderkey) AS a FROM orders GROUP BY 1) SELECT id, CASE WHEN len(a) <= 3 THEN array_to_string(a, ', ') ELSE array_to_string(a[1:3], ', ') || ' et al.' END AS shown FROM a")
def author_display(spark: SparkSession, d: str) -> DataFrame:
    """The first three authors, and whether there are more: no more than four of a list are gathered."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey", "o_orderpriority")
    four = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority").withColumn("n", F.row_number().over(by)).filter("n <= 4")
    a = four.groupBy(F.col("o_custkey").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("a"))
    return a.select("id", F.when(F.size("a") <= 3, F.array_join("a", ", ")).otherwise(F.concat(F.array_join(F.slice("a", 1, 3), ", "), F.lit(" et al."))).alias("shown"))
