"""Queries of admission chains, link policies, scope, addresses, context lines.

The synthetic tables have no such pages, so each row becomes one: its text, links and URL are made from
its key. The SQL never reads these texts; it tells from the key what must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duecall.functions import text as T
from duecall.operators import admission as A
from duecall.operators import evidence as E
from duecall.operators import lifecycle as life
from duecall.operators import upserts
from duecall.sources.tables import CALLS_SQL, calls, papers, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


NOW = "2030-01-01 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def by(n: Column, *values: str | None) -> Column:
    """values[n mod their number]."""
    return F.get(F.array(*(F.lit(v).cast("string") for v in values)), F.pmod(n, F.lit(len(values))).cast("int"))


def joined(*parts: str) -> str:
    """SQL: the names whose condition holds, in order."""
    cases = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in (p.split(": ", 1) for p in parts))
    return f"array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ',')"


@query(f"""SELECT k AS id, CASE WHEN k % 3 = 0 THEN 'chapter-proposal' ELSE 'book-proposal' END AS kind, CASE WHEN k % 3 = 0 AND k % 11 <> 0 THEN make_timestamp(CASE WHEN k % 7 = 0 THEN 2029 ELSE 2031 END, 3, 3, 23, 59, 0) END AS due,
 {joined("approved-domain: k % 5 = 1", "https: k % 5 = 0", "reputation: k % 6 = 5", "no-red-flags: k % 4 = 0", "explicit-route: k % 3 = 2 AND k % 13 <> 0", "scope: k % 3 = 2 AND k % 17 <> 0", "chapter-deadline: k % 3 = 0 AND k % 11 = 0", "deadline-ahead: k % 3 = 0 AND k % 11 <> 0 AND k % 7 = 0", "peer-review: k % 2 <> 0 AND k % 9 <> 0")} AS reasons
FROM (SELECT p_partkey AS k FROM part)""")
def book_call_chain(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("k"))
    k = F.col("k")
    due = F.when(k % 11 == 0, "soon").when(k % 7 == 0, "by March 3, 2029").otherwise("by 3rd Mar 2031")
    body = F.when(k % 3 == 0, F.concat(F.lit("Call for chapters on machine learning and databases. Chapter proposals are due "), due, F.lit("."))).when(k % 3 == 1, "Send your book proposal on machine learning and the cloud.").otherwise("News of our press, mostly on gardens.")
    text = F.concat(body, F.when(k % 4 == 0, " Guaranteed publication!").otherwise(""), F.when(k % 2 == 0, " All of it is peer-reviewed.").otherwise(""))
    url = F.concat(by(k, "http://books.press.org/", "https://press.org.evil.net/", "https://www.press.org/", "HTTPS://press.org/", "https://a.b.press.org/"), k.cast("string"))
    kind, on, failed = A.book_rules(url, text, ["press.org"], ["quantum"], k % 6 != 5, k % 9 == 0, now(), k % 13 == 0, k % 17 == 0)
    return rows.select("id", kind.alias("kind"), on.alias("due"), F.array_join(failed, ",").alias("reasons"))


@query(f"""SELECT o_orderkey AS id, {joined("official-domain: k % 7 = 0", "recruitment: k % 3 = 2 OR k % 8 = 0", "venue-identity: k % 3 = 1", "application-route: k % 4 >= 2", "service-window: k % 5 = 0")} AS reasons,
 CASE k % 4 WHEN 0 THEN 'https://forms.gle/' || k WHEN 1 THEN 'https://conf.org/apply?n=' || k END AS application FROM (SELECT *, o_orderkey AS k FROM orders)""")
def reviewer_call_chain(spark: SparkSession, d: str) -> DataFrame:
    rows, k = table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), F.col("k")
    text = F.concat(by(k, "Call for reviewers: the ABC meeting.", "Apply to be a reviewer of the XYZ gathering.", "Papers are wanted for ABC."), F.when(k % 8 == 0, " Reviewer applications are now closed.").otherwise(""))
    link = lambda t, u: F.array(F.struct(F.lit(t).alias("text"), F.concat(F.lit(u), k.cast("string")).alias("href")))
    none = F.array().cast("array<struct<text:string,href:string>>")
    links = F.when(k % 4 == 0, F.concat(link("About", "https://conf.org/"), link("Reviewer interest form", "https://forms.gle/"))).when(k % 4 == 1, link("Here", "https://conf.org/apply?n=")).when(k % 4 == 2, link("Volunteer", "https://evil.net/")).otherwise(none)
    route = A.application(links, F.lit("https://conf.org/apply"), ["conf.org"])
    ends = F.when(k % 5 == 0, "2029-12-31").when(k % 5 > 1, "2030-06-01").cast("timestamp_ntz")
    url = by(k, "https://other.org/", *["https://www.conf.org/reviewers"] * 6)
    failed = A.reviewer_rules(url, text, F.array(F.lit("ABC"), F.lit("Symposium on Things"), F.lit("x")), route, ["conf.org"], ends, now())
    return rows.select(k.alias("id"), F.array_join(failed, ",").alias("reasons"), route.alias("application"))


@query(f"""WITH {CALLS_SQL} SELECT id, {joined("future-deadline: deadline IS NULL OR deadline <= TIMESTAMP '1998-06-01'", "deadline-on-official-page: NOT official", "official-page: id % 4 = 0", "not-a-lead-collection: id % 5 = 0", "trusted: id % 7 = 0", "corroborated: id % 8 = 0", "score: venue % 6 < 3",
 "venue-evidence: type NOT IN ('journal', 'special-issue') AND id % 2 = 0 AND id % 9 <> 0 AND id % 11 <> 0", "journal-identity: type IN ('journal', 'special-issue') AND id % 13 = 0")} AS reasons FROM calls""")
def external_admission(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("id")
    url = F.when(n % 5 == 0, "http://www.wikicfp.com/cfp").when(n % 5 == 1, "https://notwikicfp.com/x").otherwise("https://conf.org/cfp")
    failed = A.external_rules(F.col("type"), F.col("deadline"), F.col("official"), n % 4 != 0, url, F.when(n % 7 == 0, "review").otherwise("trusted"), F.when(n % 8 != 0, "corroborated"), F.col("venue") % 6, n % 2 != 0, n % 9 == 0, n % 11 == 0, n % 13 != 0, life.instant("1998-06-01 00:00:00"))
    return calls(spark, d).select("id", F.array_join(failed, ",").alias("reasons"))


@query("SELECT o_orderkey AS id, o_orderkey % 6 NOT IN (2, 5) AND o_orderkey % 5 <> 0 AND o_custkey % 7 <> 0 AND o_custkey % 11 <> 0 AND o_orderstatus <> 'P' AND o_custkey % 3 <> 0 AND o_orderkey % 13 <> 0 AS stands_in FROM orders")
def operator_fallback(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    error = by(k, "HTTP 403", "HTTP_503", "HTTP 404", "network is down", "Timeout after 12 s", "no such page")
    ok = A.operator_fallback(error, k % 5 != 0, F.when(c % 7 != 0, F.lit(True)), c % 11 != 0, F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")), c % 3 != 0, F.lit("https://press.org/call"), F.when(k % 13 == 0, "https://press.org.evil.net/").when(k % 2 == 0, "https://books.press.org/s"), ["press.org"])
    return table(spark, d, "orders").select(k.alias("id"), ok.alias("stands_in"))


_HITS = " + ".join(f"regexp_matches(t, '{p}')::INT" for p in A.SCOPE.values())


@query(f"SELECT doc_id, contains(t, 'apache') OR contains(t, 'the inin') OR {_HITS} >= 2 AS relevant, ({_HITS})::INT AS n_groups FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)")
def scope_evidence(spark: SparkSession, d: str) -> DataFrame:
    """A configured keyword or two subject groups, over whole documents."""
    s = A.scope(F.col("text"), ["Apache", "the inin"])
    return table(spark, d, "documents").select("doc_id", s["relevant"].alias("relevant"), F.size(s["groups"]).alias("n_groups"))


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'https://host.org/' WHEN 2 THEN 'http://host.org/?q=1' WHEN 3 THEN 'https://host.org/A%20b#F' END AS safe FROM pages""")
def safe_urls(spark: SparkSession, d: str) -> DataFrame:
    """Normal forms of http(s) URLs, null for others."""
    n = F.col("page_id")
    url = F.when(n % 6 == 0, F.col("url")).otherwise(by(n, "", " HTTPS://Host.ORG:443 ", "http://host.org:80?q=1", "https://HOST.org/A%20b#F", "javascript:alert(1)", "ftp://host.org/x"))
    return table(spark, d, "pages").select("page_id", T.normal_url(url).alias("safe"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE url END AS call, (1 + (page_id % 2 = 0)::INT)::INT AS n_links, 'main=' || url || CASE WHEN page_id % 2 = 0 THEN ';demo=' || url || 'x' ELSE '' END AS links FROM pages""")
def nested_links_safe(spark: SparkSession, d: str) -> DataFrame:
    """Unsafe URLs go from a record's nested links, and list entries that are left without one."""
    u = F.col("url")
    link = lambda label, url: F.struct(F.lit(label).alias("label"), url.alias("url"))
    links = F.array(link("main", u), link("bad", F.lit("data:text/html,x")), link("demo", F.when(F.col("page_id") % 2 == 0, F.concat(u, F.lit("x")))))
    rows = table(spark, d, "pages").withColumn("record", F.struct(F.when(F.col("page_id") % 3 == 0, "javascript:x").otherwise(u).alias("call"), links.alias("links")))
    rows = rows.withColumn("record", F.col("record").withField("call", T.normal_url(F.col("record.call"))).withField("links", A.safe_links(F.col("record.links"))))
    line = F.array_join(F.transform("record.links", lambda x: F.concat_ws("=", x["label"], x["url"])), ";")
    return rows.select("page_id", "record.call", F.size("record.links").alias("n_links"), line.alias("links"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'https://papers.example.org/' || p_partkey END AS open_url, p_name AS title, 2::BIGINT AS n_fields FROM part""")
def public_papers(spark: SparkSession, d: str) -> DataFrame:
    """The public form of a paper: unsafe URLs null, fields for internal use dropped."""
    p = papers(spark, d).select("id", F.struct(F.coalesce("open_url", F.lit("file:///etc/x")).alias("open_url"), "title", F.lit("https://toc.org/x.xml").alias("toc_url")).alias("paper"))
    p = p.withColumn("paper", F.col("paper").withField("open_url", T.normal_url(F.col("paper.open_url"))).dropFields("toc_url"))
    return p.select("id", "paper.open_url", "paper.title", F.lit(len(p.schema["paper"].dataType.fields)).cast("long").alias("n_fields"))


@query(f"""WITH {CALLS_SQL} SELECT id, CASE WHEN id % 3 = 0 AND type <> 'workshop' THEN 'https://a.org/call-for-workshops/' || id WHEN id % 4 = 1 THEN 'https://b.org/' || id WHEN id % 5 = 0 AND type <> 'workshop' THEN 'http://c.org/?p=workshop-proposals' WHEN id % 7 <> 0 THEN 'https://d.org/' END AS url FROM calls""")
def primary_call_url(spark: SparkSession, d: str) -> DataFrame:
    n, s = F.col("id"), F.col("id").cast("string")
    options = [F.when(n % 3 == 0, F.concat(F.lit("https://a.org/Call-for-Workshops/"), s)), F.concat(by(n, "mailto:x", "https://b.org/", "ftp://b.org/", "b.org/"), s), F.when(n % 5 == 0, "http://c.org?p=workshop-proposals"), F.when(n % 7 != 0, "https://d.org")]
    url = A.primary_url(F.col("type"), options, ["call-for-workshops", "workshop-proposals"])
    return calls(spark, d).select("id", F.replace(url, F.lit("Call-for-Workshops"), F.lit("call-for-workshops")).alias("url"))


@query("""SELECT c_custkey AS id, c_custkey % 2 = 0 AND c_custkey % 16 NOT IN (0, 2, 4, 8, 14) AS public FROM customer""")
def public_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Which URLs may be fetched: every odd one isn't public, and five of the even sixteen."""
    url = by(
        F.col("c_custkey"), "http://10.1.2.3/", "http://127.0.0.1/", "https://user:x@good.org/", "http://localhost/", "https://good.org:8080/", "file:///etc/passwd", "https://good.org/x?u=a@b", "http://169.254.169.254/latest",
        "http://172.20.0.9", "http://[::1]/", "https://93.184.216.34:443/", "http://192.168.0.1/", "http://[2606:2800:220:1::1]/", "http://999.1.1.1/", "http://metadata.google.internal/", "http://[::ffff:127.0.0.1]/",
    )
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), A.public_address(url).alias("public"))


@query("""SELECT page_id, CASE WHEN page_id % 3 <> 2 THEN (page_id % 90 + 1)::INT END AS edition, CASE WHEN page_id % 2 = 0 THEN '1999,2024' ELSE '1999' END AS years FROM pages""")
def edition_claims(spark: SparkSession, d: str) -> DataFrame:
    """The edition that a page claims, and the years near the venue's name."""
    n = F.col("page_id")
    claim = F.concat(F.lit("Welcome to the "), (n % 90 + 1).cast("string"), by(n, "th Annual International Conference", "st workshop", "nd best party"))
    text = F.concat(claim, F.lit(" ABCD 1999. "), F.repeat(F.lit("words "), F.lit(60)), F.when(n % 2 == 0, "ABCD was held in 2024.").otherwise("Nothing was held in 2024."), F.lit(" In 1999 too, ABCD."), F.repeat(F.lit(" more"), F.lit(60)), F.lit(" 2011"))
    text = F.when(n % 2 == 0, text).otherwise(F.replace(text, F.lit("2024. In"), F.concat(F.lit("2024."), F.repeat(F.lit(" gap"), F.lit(60)), F.lit(" In"))))
    return table(spark, d, "pages").select("page_id", A.claimed_edition(text).alias("edition"), F.array_join(A.years_near(text, F.lit("ABCD")), ",").alias("years"))


def context_line(c: str, fields: dict[str, str], topics: str) -> Column:
    """One line of a nested record, empty parts left out."""
    part = lambda label, x: F.when(F.coalesce(F.col(f"{c}.{x}").cast("string"), F.lit("")) != "", F.concat(F.lit(f"{label}="), F.col(f"{c}.{x}").cast("string")))
    inner = F.concat_ws(", ", *(part(k, x) for k, x in fields.items() if "." in x))
    outer = [part(k, x) for k, x in fields.items() if "." not in x]
    return F.concat_ws(" | ", F.concat(F.lit("["), F.col(f"{c}.id").cast("string"), F.lit("] "), F.col(f"{c}.name")), *outer, F.when(F.size(F.col(f"{c}.{topics}")) > 0, F.concat(F.lit("topics: "), F.array_join(F.col(f"{c}.{topics}"), ", "))), F.when(inner != "", F.concat(F.lit("metrics: "), inner)))


@query("""SELECT p_partkey AS id, '[' || p_partkey || '] ' || p_name || ' | type=' || p_type || CASE WHEN p_size % 2 = 0 THEN ' | publisher=' || p_brand ELSE '' END || ' | topics: ' || replace(p_name, ' ', ', ')
 || CASE WHEN p_size % 3 = 2 AND p_size % 5 = 0 THEN '' ELSE ' | metrics: ' || concat_ws(', ', CASE WHEN p_size % 3 <> 2 THEN 'IF=' || p_size END, CASE WHEN p_size % 5 <> 0 THEN 'OA=' || CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END END) END AS line FROM part""")
def venue_context_lines(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    metrics = F.struct(F.when(n % 3 != 2, n).alias("impact"), F.when(n % 5 != 0, n % 2 == 0).alias("open"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.when(n % 2 == 0, F.col("p_brand")).otherwise("").alias("publisher"), F.split("p_name", " ").alias("topics"), metrics.alias("metrics")).alias("c"))
    return rows.select("id", context_line("c", {"type": "type", "publisher": "publisher", "IF": "metrics.impact", "OA": "metrics.open"}, "topics").alias("line"))


@query("""SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'wikicfp' WHEN 1 THEN 'cmt' WHEN 2 THEN 'easychair' WHEN 3 THEN 'openreview' WHEN 4 THEN 'springer' ELSE 'web' END AS source FROM pages""")
def source_class(spark: SparkSession, d: str) -> DataFrame:
    """Where a lead comes from, by its host; the first rule that matches."""
    url = F.concat(by(F.col("page_id"), "http://www.wikicfp.com/", "https://cmt3.research.microsoft.com/", "https://EasyChair.org/", "https://openreview.net/", "https://link.springer.com/", "https://a.org/openreview.net/", None), F.lit("x"))
    return table(spark, d, "pages").select("page_id", T.ruled(F.coalesce(T.host(url), F.lit("")), A.SOURCES, "web").alias("source"))


@query("""SELECT p_partkey AS id, p_size % 3 <> 0 AND p_size % 4 <> 0 AND p_size % 5 <> 0 AND p_size % 7 <> 0 AS verified FROM part""")
def shard_verified(spark: SparkSession, d: str) -> DataFrame:
    """A written shard against its venue: same id, verified, papers in it, and the same external ids in any order."""
    n, s = F.col("p_size"), F.col("p_partkey").cast("string")
    ours = F.create_map(F.lit("dblp"), s, F.lit("issn"), F.lit("x"))
    theirs = F.when(n % 3 == 0, F.create_map(F.lit("issn"), F.lit("x"))).when(n % 2 == 0, F.create_map(F.lit("issn"), F.lit("x"), F.lit("dblp"), s)).otherwise(ours)
    ok = A.same_ids(ours, theirs) & F.when(n % 4 == 0, s.eqNullSafe(F.lit("other"))).otherwise(True) & (F.when(n % 5 == 0, "partial").otherwise("verified") == "verified") & (F.when(n % 7 == 0, 0).otherwise(n) > 0)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), ok.alias("verified"))


@query("""SELECT user_id, coalesce(string_agg(strftime(day, '%m-%d'), ',' ORDER BY day) FILTER (day <> first), '') AS others FROM (SELECT DISTINCT user_id, date_trunc('day', ts) AS day, min(date_trunc('day', ts)) OVER (PARTITION BY user_id) AS first FROM events) GROUP BY user_id""")
def distinct_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Of a call's dates those that differ from the one that is shown."""
    e = table(spark, d, "events").select("user_id", F.date_trunc("day", "ts").alias("day")).distinct()
    e = e.groupBy("user_id").agg(F.min("day").alias("first"), F.sort_array(F.collect_set("day")).alias("days"))
    other = F.filter("days", lambda x: ~x.eqNullSafe(F.col("first")))
    return e.select("user_id", F.array_join(F.transform(other, lambda x: F.date_format(x, "MM-dd")), ",").alias("others"))


@query("""WITH e AS (SELECT o_custkey AS venue, o_orderkey % 3 = 0 AS official, o_orderkey % 4 <> 0 AS named, date_part('year', o_orderdate) AS y, o_orderkey AS k FROM orders)
SELECT venue, bool_or(official AND named AND y = 1998) AS current_confirmed, least(2, count(*) FILTER (official AND named AND y < 1998))::BIGINT AS prior_pages, arg_min(k, k) FILTER (official AND named AND y = 1998) AS evidence FROM e GROUP BY venue""")
def listing_confirmed(spark: SparkSession, d: str) -> DataFrame:
    """Whether pages on approved hosts name the venue with this year, and up to two that do for earlier ones."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("venue"), F.col("o_orderkey").alias("k"), F.year("o_orderdate").alias("y"))
    url = F.when(F.col("k") % 3 == 0, "https://proceedings.acm.org/x").otherwise("https://acm.org.evil.net/x")
    text = F.concat(F.when(F.col("k") % 4 != 0, "Proceedings of ABCD ").otherwise("Proceedings of EFGH "), F.col("y").cast("string"))
    hit = T.allowed(T.host(url), ["acm.org"]) & T.search_text(text).contains("abcd")
    this = hit & text.contains("1998")
    return o.groupBy("venue").agg(F.bool_or(this).alias("current_confirmed"), F.least(F.lit(2), F.count_if(hit & (F.col("y") < 1998))).cast("long").alias("prior_pages"), F.min(F.when(this, F.col("k"))).alias("evidence"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN false WHEN o_orderkey % 4 = 0 THEN false WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 1 YEAR > TIMESTAMP '1998-06-01' WHEN o_orderkey % 5 = 0 THEN o_orderdate > TIMESTAMP '1998-06-01' ELSE o_orderpriority = '5-LOW' END AS active,
 CASE WHEN o_orderstatus = 'F' THEN 'status:closed' WHEN o_orderkey % 4 = 0 THEN 'invalid-deadline' WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderdate + INTERVAL 1 YEAR > TIMESTAMP '1998-06-01' THEN 'deadline' ELSE 'deadline-passed' END WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderdate > TIMESTAMP '1998-06-01' THEN 'deadline' ELSE 'deadline-passed' END WHEN o_orderpriority = '5-LOW' THEN 'rolling' ELSE 'no-deadline' END AS reason FROM orders""")
def closure_from_text(spark: SparkSession, d: str) -> DataFrame:
    """Whether a call is open by its texts: the first of closes, expires and deadline that isn't empty counts, readable or not."""
    k, date = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    closes, expires = F.when(k % 4 == 0, "next Tuesday").otherwise(" "), F.when(k % 3 == 0, F.date_format(F.add_months("o_orderdate", 12), "yyyy-MM-dd")).otherwise("")
    state = life.closure("1998-06-01 00:00:00", F.when(F.col("o_orderstatus") == "F", " Closed "), F.lit(False), F.lit(False), [], [closes, expires, F.when(k % 5 == 0, date)], F.col("o_orderpriority") == "5-LOW", F.lit(False))
    return table(spark, d, "orders").select(k.alias("id"), state["active"].alias("active"), state["reason"].alias("reason"))


@query(f"""WITH {CALLS_SQL}, b AS (SELECT *, id % 6 = 0 AS review FROM calls WHERE type = 'book-proposal' OR id % 9 = 0) SELECT id, 'trusted' AS tab FROM b WHERE NOT review AND status <> 'closed' AND NOT (source = 'seed' AND NOT official) AND (coalesce(expires_at, deadline) > TIMESTAMP '1998-06-01' OR (expires_at IS NULL AND deadline IS NULL))
 UNION ALL SELECT id, 'review' FROM b WHERE review""")
def book_tabs(spark: SparkSession, d: str) -> DataFrame:
    """The trusted tab shows open calls, the review tab all that await review, whatever their dates."""
    b = calls(spark, d).filter((F.col("type") == "book-proposal") | (F.col("id") % 9 == 0)).withColumn("review", F.col("id") % 6 == 0)
    open_ = life.judged(b.filter("not review"), "1998-06-01 00:00:00").filter("active")
    return open_.select("id", F.lit("trusted").alias("tab")).unionByName(b.filter("review").select("id", F.lit("review").alias("tab")))


@query("""SELECT event_id AS id, event_id % 4 = 0 AS organizers, event_id % 4 <> 0 AND (event_id % 3 = 0 OR (event_id % 3 = 1 AND ts > TIMESTAMP '2024-01-15')) AS admitted FROM events""")
def directory_admission(spark: SparkSession, d: str) -> DataFrame:
    """Directory entries that are open without a date or due later; calls for organizers go."""
    n = F.col("event_id")
    title = by(n, "Call for Workshops 2030", "Workshop on Things", "Call for Papers", "Conference on Workshop Methods")
    status = by(n, "Open for Submissions", "Due", "Closed")
    due = F.when(n % 3 == 1, F.col("ts"))
    ok = ~A.organizer_call(title) & ((status.contains("Open for") & due.isNull()) | F.coalesce(due > F.lit("2024-01-15").cast("timestamp_ntz"), F.lit(False)))
    return table(spark, d, "events").select(n.alias("id"), A.organizer_call(title).alias("organizers"), ok.alias("admitted"))


#: What a title says a call is and is about; the first rule that matches.
TYPE_RULES = [("special-issue", r"special issue"), ("workshop", r"workshop"), ("journal", r"journal|transactions|letters"), ("conference", r"conference|symposium|congress")]
AREA_RULES = [("Security", r"security|privacy"), ("Learning", r"learning|neural"), ("Data", r"data|query")]


@query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'workshop' WHEN 1 THEN 'journal' WHEN 2 THEN 'conference' WHEN 3 THEN 'special-issue' ELSE 'conference' END AS type, CASE p_partkey % 4 WHEN 0 THEN 'Data' WHEN 1 THEN 'Learning' WHEN 2 THEN 'Security' ELSE 'Other' END AS area,
 CASE WHEN p_partkey % 5 = 4 THEN 'Meeting' ELSE 'AB' || p_partkey END AS acronym FROM part""")
def title_inference(spark: SparkSession, d: str) -> DataFrame:
    """Type, area and acronym of a call by its title alone."""
    n = F.col("p_partkey")
    kind = by(n, "Workshop at the Conference", "Transactions", "Symposium", "Special Issue of a Journal", "on Things")
    title = F.concat(F.when(n % 5 == 4, "Meeting").otherwise(F.concat(F.lit("The AB"), n.cast("string"))), F.lit(" "), kind, F.lit(" "), by(n, "for Data", "for Neural Privacy-free Learning".replace("Privacy-free ", ""), "for Data Security", ""))
    short = F.coalesce(F.nullif(F.regexp_extract(title, r"\b([A-Z][A-Z0-9-]{2,12})\b", 1), F.lit("")), F.split(title, " ")[0])
    return table(spark, d, "part").select(n.alias("id"), T.ruled(F.lower(title), TYPE_RULES, "conference").alias("type"), T.ruled(F.lower(title), AREA_RULES, "Other").alias("area"), short.alias("acronym"))


_EV = f"""WITH {CALLS_SQL}, e AS (SELECT *, type IN ('journal', 'special-issue') AS j, type = 'workshop' AS w, id % 2 = 0 AS app, id % 7 = 0 AS ident, id % 3 = 0 AS lst, id % 5 = 0 AS idx, id % 19 = 0 AS conf, id % 3 <> 1 AS est, id % 4 <> 0 AS chk, id % 5 < 3 AS pri, venue % 6 = 0 AS pub, venue % 4 = 0 AS par, venue % 3 = 0 AS pcl, venue % 9 < 2 AS rnk, source = 'seed' AS orv, id % 23 = 0 AS unr, id % 11 = 0 AS sus, id % 29 = 0 AS nohost, id % 13 = 0 AS oth FROM calls),
p AS (SELECT id, app::INT + 2 * (j AND ident)::INT + 2 * (j AND lst)::INT + (j AND NOT lst AND idx)::INT + 3 * (NOT j AND est AND pri)::INT + (NOT j AND est AND NOT pri)::INT + 2 * (NOT j AND pub)::INT + 3 * (w AND par)::INT + (rnk AND (ident OR est))::INT + (orv AND NOT oth)::INT AS g,
 2 * sus::INT + nohost::INT + 3 * (j AND conf)::INT + 2 * (NOT j AND chk AND NOT est)::INT + (w AND pcl AND NOT par)::INT + unr::INT + (oth AND NOT app AND NOT ident AND NOT est)::INT AS b, CASE WHEN j THEN ident AND (lst OR idx) ELSE (est AND pri) OR pub OR par END AS dec FROM e)"""


@query(f"{_EV} SELECT id, CASE WHEN b >= 3 OR (b >= 2 AND NOT dec) THEN 'caution' WHEN dec AND g >= 3 AND b = 0 THEN 'trusted' ELSE 'review' END AS level, (g - b)::BIGINT AS score, CASE WHEN dec THEN 'corroborated' ELSE 'partial' END AS quality FROM p")
def legitimacy_rules(spark: SparkSession, d: str) -> DataFrame:
    """All evidence rules, journals and other venues each by their own."""
    n, v = F.col("id"), F.col("venue")
    x = F.struct(
        F.when(n % 29 != 0, "conf.org").alias("host"), (n % 2 == 0).alias("approved"), (n % 11 == 0).alias("suspicious"), F.col("type").alias("type"), F.when(v % 9 == 0, "A*").when(v % 9 == 1, "Q2").otherwise("D").alias("tier"),
        F.when(n % 13 == 0, "other").when(F.col("source") == "seed", "openreview").otherwise("agent").alias("source"), (n % 23 == 0).alias("unreachable"), (n % 7 == 0).alias("identity"), F.when(n % 3 == 0, F.lit(True)).alias("listed"), (n % 5 == 0).alias("indexed"),
        (n % 19 == 0).alias("conflict"), (n % 3 != 1).alias("established"), (n % 4 != 0).alias("checked"), (n % 5 < 3).alias("prior_publisher"), (v % 6 == 0).alias("publisher_now"), (v % 4 == 0).alias("parent"), (v % 3 == 0).alias("parent_claimed"),
    )
    return calls(spark, d).select("id", E.legitimacy(x).alias("s")).select("id", "s.level", "s.score", "s.quality")


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderdate + INTERVAL 1 MINUTE * (o_orderkey * 37 % 1440) AS t FROM orders), a AS (SELECT id, t, date_diff('second', TIMESTAMP '1998-01-31 06:00:00', t) AS left_s, (date_part('year', t) - 1998) * 12 + date_part('month', t) - 1 AS m0 FROM o WHERE t > TIMESTAMP '1998-01-31 06:00:00'),
b AS (SELECT *, m0 - CASE WHEN TIMESTAMP '1998-01-31 06:00:00' + INTERVAL 1 MONTH * m0::INT > t THEN 1 ELSE 0 END AS m FROM a), c AS (SELECT *, date_diff('second', TIMESTAMP '1998-01-31 06:00:00' + INTERVAL 1 MONTH * m::INT, t) AS r FROM b)
SELECT id, m::BIGINT AS months, (r // 86400)::BIGINT AS days, (r % 86400 // 3600)::BIGINT AS hours, CASE WHEN left_s < 3600 THEN greatest(1, ceil(left_s / 60.0))::BIGINT END AS minutes, left_s < 604800 AS soon FROM c""")
def countdown_parts(spark: SparkSession, d: str) -> DataFrame:
    """Months by the calendar, then days and hours; minutes in the final hour. A month that is too short ends on its last day."""
    at = F.lit("1998-01-31 06:00:00").cast("timestamp_ntz")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") * 37 % 1440).cast("int"))).alias("t"))
    rows = rows.filter(F.col("t") > at)
    later = lambda m: F.expr("timestamp_ntz'1998-01-31 06:00:00'") + F.make_ym_interval(months=m)
    m0 = ((F.year("t") - 1998) * 12 + F.month("t") - 1).cast("int")
    rows = rows.withColumn("m", m0 - F.when(later(m0) > F.col("t"), 1).otherwise(0))
    seconds = lambda a: F.timestamp_diff("SECOND", a, F.col("t"))
    rows = rows.withColumns({"r": seconds(later(F.col("m"))), "s": seconds(at)})
    minutes = F.when(F.col("s") < 3600, F.greatest(F.lit(1), F.ceil(F.col("s") / 60))).cast("long")
    return rows.select("id", F.col("m").cast("long").alias("months"), F.floor(F.col("r") / 86_400).alias("days"), F.floor(F.col("r") % 86_400 / 3600).alias("hours"), minutes.alias("minutes"), (F.col("s") < 604_800).alias("soon"))


# A call's area as one of ten domains, on text in lower case; the first rule that matches.
DOMAINS = [
    ("Computer Vision", r"comput.*vision|vision|image|document ai|pattern recognition"),
    ("NLP & Speech", r"nlp|natural language|language|speech|audio|signal|linguistic"),
    ("Robotics", r"robot"),
    ("Data, Web & IR", r"data|mining|information retrieval|web|database|knowledge|graph"),
    ("Systems & Architecture", r"system|architecture|hpc|storage|network|cloud|systems"),
    ("Security & Privacy", r"secur|privacy|crypto"),
    ("HCI", r"human-computer|hci|interface|interaction"),
    ("Theory & Statistics", r"theory|learning theory|mathematic|statistic"),
    ("Applied & Responsible AI", r"medical|health|clinical|education|finance|hospitality|tourism|senior|population|iot|federated|blockchain|responsible|fairness|affective|social|environment|energy"),
    ("Machine Learning & AI", r"machine learning|artificial intelligence|deep learning|neural|multi-agent|agent|reinforcement|evolutionary|ml systems|intelligent"),
]
_AREAS = [
    ("Medical Image Analysis", "Computer Vision"), ("Natural Language", "NLP & Speech"), ("Robot Learning", "Robotics"), ("Graph Mining", "Data, Web & IR"), ("Cloud and Energy", "Systems & Architecture"), ("Privacy", "Security & Privacy"),
    ("Human-Computer Interaction", "HCI"), ("Learning Theory", "Theory & Statistics"), ("Clinical Learning", "Applied & Responsible AI"), ("Neural Agents", "Machine Learning & AI"), ("Poetry", "Other"), ("Database Systems", "Data, Web & IR"),
    ("Tourism and Hospitality", "Applied & Responsible AI"), ("Blockchain", "Applied & Responsible AI"), ("Affective Computing", "Applied & Responsible AI"), ("Senior IoT", "Applied & Responsible AI"), ("Learning to learn", "Other"), ("Reinforcement", "Machine Learning & AI"), ("", "Other"),
]


@query("SELECT c_custkey AS id, [" + ", ".join(f"'{y}'" for _, y in _AREAS) + f"][c_custkey % {len(_AREAS)} + 1] AS domain FROM customer")
def macro_domains(spark: SparkSession, d: str) -> DataFrame:
    area = by(F.col("c_custkey"), *(x for x, _ in _AREAS))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), T.ruled(F.lower(area), DOMAINS, "Other").alias("domain"))


@query("SELECT o_orderstatus AS status, count(*) AS n, max(o_orderdate) AS newest FROM orders GROUP BY 1")
def freshness_asserted(spark: SparkSession, d: str) -> DataFrame:
    """The audit as an assertion: the job fails where a store is empty, too old, or from the future."""
    rows = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("newest"))
    age = F.timestamp_diff("MINUTE", F.col("newest"), F.lit("2001-08-02").cast("timestamp_ntz"))
    return upserts.asserted(rows, age.between(-5, 60 * 24 * 60) & (F.col("n") > 0), F.concat(F.lit("stale: "), F.col("status")))


@query("SELECT p_partkey AS id FROM part WHERE p_size % 3 = 0 AND p_size % 4 <> 0 AND p_partkey % 5 <> 0")
def issn_members(spark: SparkSession, d: str) -> DataFrame:
    """Items of a journal: one of its ISSNs, the year asked for, and a valid DOI."""
    n, k = F.col("p_size"), F.col("p_partkey")
    issns = F.array(F.lit("2049-3630"), F.when(n % 3 == 0, "00280836").otherwise("0028-0837"))
    mine = F.array(F.lit("0028-0836"), F.lit("1050-124X"))
    known = F.filter(F.transform(issns, T.issn), lambda x: x.isNotNull())
    doi = F.when(k % 5 == 0, "10.1/x").otherwise(F.concat(F.lit("https://doi.org/10.1000/"), k.cast("string")))
    year = F.when(n % 4 == 0, 2029).otherwise(2030)
    return table(spark, d, "part").filter(F.arrays_overlap(known, mine) & (year == 2030) & T.doi(doi).isNotNull()).select(k.alias("id"))


@query("""SELECT user_id, arg_min(event_id, (ts, event_id)) AS invitation, min(ts) AS due FROM events WHERE event_type IN ('purchase', 'signup') AND event_id % 3 <> 0 AND event_id % 4 <> 0 AND ts > TIMESTAMP '2024-01-10' AND event_id % 7 <> 0 GROUP BY user_id""")
def open_invitations(spark: SparkSession, d: str) -> DataFrame:
    """Of each group the earliest invitation to submit that is open: by its id's form, not a review's or a revision's, due later, opened before."""
    n, at = F.col("event_id"), F.lit("2024-01-10").cast("timestamp_ntz")
    kind = F.when(~F.col("event_type").isin("purchase", "signup"), "Comment").when(n % 3 == 0, "Camera_Ready_Revision").when(n % 4 == 0, "Official_Review").when(n % 2 == 0, "Submission").otherwise("Blind_Submission")
    invitation = F.concat(F.lit("host.org/"), F.col("user_id").cast("string"), F.lit("/-/"), kind)
    opened = F.when(n % 7 == 0, at + F.expr("INTERVAL 1 DAY")).when(n % 2 == 0, at - F.expr("INTERVAL 9 DAY"))
    fit = invitation.rlike(r"/-/.*(?:Submission|Paper|Abstract)") & ~invitation.rlike(r"Review|Revision|Camera|Comment|Withdraw") & (F.col("ts") > at) & (opened.isNull() | (opened <= at))
    return table(spark, d, "events").filter(fit).groupBy("user_id").agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("invitation"), F.min("ts").alias("due"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://a.org/x?y=' || page_id WHEN 1 THEN 'https://b.org/' || page_id WHEN 2 THEN NULL ELSE 'https://c.org/it''s' END AS target, CASE WHEN page_id % 2 = 0 THEN '0000-0002-1825-0097' END AS orcid, CASE WHEN page_id % 3 = 0 THEN '{"a": {"b": ' || page_id || '}}' END AS json FROM pages""")
def found_in_text(spark: SparkSession, d: str) -> DataFrame:
    """Targets of redirecting links in either kind of quotes, but not on the search engine's own host; an ORCID; loose JSON."""
    n = F.col("page_id").cast("string")
    href = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("<a class='q' href='/url?sa=t&q=https%3A%2F%2Fa.org%2Fx%3Fy%3D"), n, F.lit("&z=1'>A</a>"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit('<a href="https://b.org/'), n, F.lit('">B</a>'))).when(F.col("page_id") % 4 == 2, '<a href="https://www.engine.org/help">C</a>').otherwise("<a href=\"https://c.org/it's\">D</a>")
    target = F.get(F.filter(F.transform(T.links(href), lambda x: T.redirected(x["href"], "q")), lambda u: T.host(u) != "engine.org"), F.lit(0))
    orcid = by(F.col("page_id"), "see https://orcid.org/0000-0002-1825-0097.", "0000-0002-1825-0098")
    loose = F.concat(F.lit("Sure, here: "), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('{"a": {"b": '), n, F.lit("}} I hope"))).when(F.col("page_id") % 3 == 1, "{no json}").otherwise("none"))
    return table(spark, d, "pages").select("page_id", target.alias("target"), T.orcid(orcid).alias("orcid"), T.loose_json(loose).alias("json"))
