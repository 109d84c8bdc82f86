"""Queries of the two rankers, facets, orders, pages and shortlists."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duecall.functions import taxonomy
from duecall.functions import text as T
from duecall.functions.parse import parse
from duecall.operators import lifecycle, page_index, postings
from duecall.operators import search as S
from duecall.sources.tables import CALLS_SQL, NOW, PAPERS_SQL, calls, papers, spread, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _bm25(terms: dict[str, float], high: float, floor: float = 0.0) -> str:
    """SQL over c(id, h, b): arrays of tokens of the high field and the body."""
    parts = " + ".join(f"CASE WHEN tf{k} > 0 THEN {w}::DOUBLE * ln(1 + (n - df{k} + 0.5) / (df{k} + 0.5)) * tf{k} * 2.2::DOUBLE / (tf{k} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / av)) ELSE 0 END" for k, w in enumerate(terms.values()))
    tfs = ", ".join(f"{high}::DOUBLE * len(list_filter(h, lambda x: x = '{t}')) + len(list_filter(b, lambda x: x = '{t}')) AS tf{k}" for k, t in enumerate(terms))
    dfs = ", ".join(f"count(*) FILTER (tf{k} > 0) AS df{k}" for k in range(len(terms)))
    return f"""tf AS (SELECT *, greatest({high}::DOUBLE * len(h) + len(b), {floor}) AS len, {tfs} FROM c),
st AS (SELECT count(*)::DOUBLE AS n, greatest(avg(len), 1) AS av, {dfs} FROM tf),
sc AS (SELECT tf.*, {parts} AS score FROM tf, st)"""


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


def _norm(expr: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower(coalesce({expr}, ''))), '[^a-z0-9+#./-]+', ' ', 'g'))"


def _tok(expr: str) -> str:
    return f"list_filter(list_transform(string_split({_norm(expr)}, ' '), lambda w: regexp_replace(w, '^[./-]+|[./-]+$', '', 'g')), lambda w: w <> '' AND (length(w) >= 2 OR regexp_matches(w, '^[0-9]+$')) AND NOT list_contains({_STOP}, w))"


# What a source's number stands for, as its records' domain and, three further, their series.
_DOMAINS = ["machine learning privacy", "computer vision", "privacy and cryptography", "digital health", "natural language processing", "data mining", "human computer interaction", "responsible ai", "software engineering", "graph theory"]
_DOMAINS_SQL = "[" + ", ".join(f"'{x}'" for x in _DOMAINS) + "]"
_N_SQL = "coalesce(try_cast(regexp_extract(source, '[0-9]+') AS INT), 0)"
_HIGH_SQL, _BODY_SQL = f"concat_ws(' ', source, lang, {_DOMAINS_SQL}[{_N_SQL} % 10 + 1])", f"concat_ws(' ', text, {_DOMAINS_SQL}[({_N_SQL} + 3) % 10 + 1])"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """documents as the catalogue's records: source, lang and domain are the high field, text and series the body."""
    docs = spread(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source"))
    n = F.coalesce(F.regexp_extract("source", "[0-9]+", 0).try_cast("int"), F.lit(0))
    domain = lambda k: F.get(F.array(*map(F.lit, _DOMAINS)), (n + k) % len(_DOMAINS))
    none = {"type": F.lit("conference"), "deadline": F.lit(None).cast("timestamp_ntz"), "rolling": F.lit(False), "official": F.lit(True)}
    return docs.withColumns({**none, "_high": T.search_text(F.concat_ws(" ", "source", "lang", domain(0))), "_body": T.search_text(F.concat_ws(" ", "text", domain(3)))}).drop("text")


_ASKED, _WHEN = "show me machine learning privacy work", datetime(1998, 6, 1)
_Q = parse(_ASKED, _WHEN)


def _search(q, where: str = "true") -> str:
    """SQL of a whole search over the documents, from what its string was understood as."""
    has = lambda p: f"contains(ht || ' ' || bt, '{p}')"
    phrases = [p for some in q.concepts.values() for p in some]
    kept = f" AND ({' OR '.join(map(has, phrases))})" if phrases else ""
    hits = [" + ".join(f"{has(p)}::INT" for p in some) for some in q.concepts.values()]
    boost = "".join(f" + CASE WHEN {h} > 0 THEN 2 + 0.75::DOUBLE * least({h} - 1, 3) ELSE 0 END" for h in hits)
    phrase = f" + CASE WHEN contains(ht, '{q.text}') THEN 5 WHEN contains(bt, '{q.text}') THEN 2 ELSE 0 END" if len(q.text) >= 3 else ""
    return f"""c0 AS (SELECT doc_id, {_norm(_HIGH_SQL)} AS ht, {_norm(_BODY_SQL)} AS bt, {_tok(_HIGH_SQL)} AS h, {_tok(_BODY_SQL)} AS b FROM documents WHERE {where}),
c AS (SELECT * FROM c0 WHERE true{kept}), {_bm25(S.expansion(q.terms, q.concepts), 2.4)},
found AS (SELECT doc_id, round(score{phrase}{boost}, 6) AS score FROM sc WHERE round(score{phrase}{boost}, 6) > 0)"""


@query(f"WITH {_search(_Q)} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS ord FROM found QUALIFY ord <= 1000")
def bm25_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """The whole catalogue search, the flagship: from a plain string to the best thousand rows."""
    rows, _ = S.searched(_docs(spark, d), _ASKED, _WHEN)
    top = rows.select(F.col("id").alias("doc_id"), "score").limit(1000)
    return top.withColumn("ord", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).cast("long"))


_MIT = parse("the license mit", _WHEN)


@query(f"""WITH {_search(_MIT, "lang = 'en'")} SELECT doc_id, score FROM found""")
def bm25_filtered_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Statistics over the filtered rows only."""
    return S.searched(_docs(spark, d).filter("lang = 'en'"), "the license mit", _WHEN)[0].select(F.col("id").alias("doc_id"), "score")


@query(f"""WITH c AS (SELECT doc_id, {_tok(_HIGH_SQL)} AS h, {_tok(_BODY_SQL)} AS b FROM documents), l AS (SELECT doc_id, 2.4::DOUBLE * len(h) + len(b) AS len FROM c), st AS (SELECT count(*) AS n, greatest(avg(len), 1) AS av FROM l),
x AS (SELECT doc_id, t, sum(w) AS tf FROM (SELECT doc_id, unnest(h) AS t, 2.4::DOUBLE AS w FROM c UNION ALL SELECT doc_id, unnest(b), 1 FROM c) GROUP BY ALL), q AS (SELECT DISTINCT item_id, unnest({_tok('text')}) AS t FROM benchmark), df AS (SELECT t, count(*) AS df FROM x GROUP BY t),
s AS (SELECT item_id, x.doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / av))), 6) AS score FROM q JOIN x ON q.t = x.t JOIN df ON df.t = q.t JOIN l ON l.doc_id = x.doc_id, st GROUP BY item_id, x.doc_id)
SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS ord FROM s QUALIFY ord <= 10""")
def bm25_indexed_all(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark item as a query against all documents, by the stored index: the ten best of each."""
    index = postings.build(_docs(spark, d), T.tokens(F.col("_high")), T.tokens(F.col("_body")), 2.4)
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("q"), F.explode(T.tokens(T.search_text(F.col("text")))).alias("term"), F.lit(1.0).alias("w"))
    return postings.search(index, asked, 10).select(F.col("q").alias("item_id"), F.col("id").alias("doc_id"), "score", "ord")


_PHRASES = {"legal": ["license", "public license", "apache"], "speech": ["langua", "words of"]}


@query(f"""WITH t AS (SELECT doc_id, {_norm(_BODY_SQL)} AS t FROM documents), h AS (SELECT doc_id, contains(t, 'license')::INT + contains(t, 'public license')::INT + contains(t, 'apache')::INT AS h, contains(t, 'langua')::INT + contains(t, 'words of')::INT AS g FROM t)
SELECT doc_id, (CASE WHEN h > 0 THEN 2 + 0.75::DOUBLE * least(h - 1, 3) ELSE 0 END + CASE WHEN g > 0 THEN 2 + 0.75::DOUBLE * least(g - 1, 3) ELSE 0 END)::DOUBLE AS boost FROM h WHERE h > 0 OR g > 0""")
def concept_boost(spark: SparkSession, d: str) -> DataFrame:
    """Rows that meet any concept, with their boost."""
    every = [p for some in _PHRASES.values() for p in some]
    boost = T.let(F.col("_body"), lambda t: F.when(S.concept_hits(t, every) > 0, S.concept_bonus(t, _PHRASES)))
    return _docs(spark, d).select(F.col("id").alias("doc_id"), boost.alias("boost")).filter("boost is not null")


# Queries without terms, and what each asks for on 1998-06-01, told by hand: types, first moment, last moment, moment before which, rolling, trusted.
_MANY = [
    ("conferences", ["conference"], None, None, None, False, False),
    ("venues", ["conference"], None, None, None, False, False),
    ("show me all the workshops", ["workshop"], None, None, None, False, False),
    ("journals", ["journal", "special-issue"], None, None, None, False, False),
    ("Special Issue", ["special-issue"], None, None, None, False, False),
    ("books", ["book-proposal"], None, None, None, False, False),
    ("a monograph proposal", ["book-proposal"], None, None, None, False, False),
    ("chapter proposals", ["chapter-proposal"], None, None, None, False, False),
    ("book chapters", ["book-proposal", "chapter-proposal"], None, None, None, False, False),
    ("call for reviewers", ["reviewer-call"], None, None, None, False, False),
    ("reviewer opportunities", ["reviewer-call"], None, None, None, False, False),
    ("propose a workshop", ["workshop-proposal"], None, None, None, False, False),
    ("workshop proposals", ["workshop-proposal"], None, None, None, False, False),
    ("workshops or conferences", ["workshop", "conference"], None, None, None, False, False),
    ("conferences and journals", ["journal", "special-issue", "conference"], None, None, None, False, False),
    ("special issues of journals", ["special-issue", "journal"], None, None, None, False, False),
    ("calls with a deadline at least one week away", [], "1998-06-08", None, None, False, False),
    ("atleast 3 days from now", [], "1998-06-04", None, None, False, False),
    ("minimum of two weeks", [], "1998-06-15", None, None, False, False),
    ("more than 10 days", [], "1998-06-11", None, None, False, False),
    ("no sooner than a month", [], "1998-07-01", None, None, False, False),
    ("at least six months away", [], "1998-12-01", None, None, False, False),
    ("at least a year", [], "1999-06-01", None, None, False, False),
    ("within 5 days", [], None, "1998-06-06", None, False, False),
    ("in the next two weeks", [], None, "1998-06-15", None, False, False),
    ("within the next three months", [], None, "1998-09-01", None, False, False),
    ("Deadline in less than 30 days", [], None, None, "1998-07-01", False, False),
    ("less than a week", [], None, None, "1998-06-08", False, False),
    ("under twelve weeks", [], None, None, "1998-08-24", False, False),
    ("closing in the next six months", [], None, "1998-12-01", None, False, False),
    ("within 1 year", [], None, "1999-06-01", None, False, False),
    ("within 0 days", [], None, "1998-06-02", None, False, False),
    ("after July 4", [], "1998-07-04", None, None, False, False),
    ("deadline after march 1", [], "1999-03-01", None, None, False, False),
    ("later than Dec 24, 1998", [], "1998-12-24", None, None, False, False),
    ("no earlier than jan 31 1997", [], "1997-01-31", "1997-01-31", None, False, False),
    ("before August 1", [], None, "1998-08-01", None, False, False),
    ("deadline earlier than Sep 9 1998", [], None, "1998-09-09", None, False, False),
    ("deadline before Oct 15", [], None, "1998-10-15", None, False, False),
    ("before may 5", [], None, "1999-05-05", None, False, False),
    ("after June 1 before June 30", [], "1998-06-01", "1998-06-30", None, False, False),
    ("at least 2 weeks, under 3 months", [], "1998-06-15", None, "1998-09-01", False, False),
    ("at least one month before february 31 1999", [], "1998-07-01", "1999-03-03", None, False, False),
    ("within 2 months before july 20", [], None, "1998-07-20", None, False, False),
    ("rolling", [], None, None, None, True, False),
    ("rolling submissions", [], None, None, None, True, False),
    ("rolling book proposals", ["book-proposal"], None, None, None, True, False),
    ("rolling calls for trusted journals", ["journal", "special-issue"], None, None, None, True, True),
    ("trusted only", [], None, None, None, False, True),
    ("only verified", [], None, None, None, False, True),
    ("verified conferences within 4 weeks", ["conference"], None, "1998-06-29", None, False, True),
    ("legitimate publishers", [], None, None, None, False, True),
    ("trusted only workshops or conferences at least two weeks away, under three months", ["workshop", "conference"], "1998-06-15", None, "1998-09-01", False, True),
    ("open workshops closing within eight weeks", ["workshop"], None, "1998-07-27", None, False, False),
    ("I am looking for any journal with a deadline after november 11 1998", ["journal", "special-issue"], "1998-11-11", None, None, False, False),
]


def _asked_sql() -> str:
    stamp = lambda x: f"TIMESTAMP '{x}'" if x else "NULL::TIMESTAMP"
    rows = (f"('{q}', {kinds}::VARCHAR[], {stamp(least)}, {stamp(most)}, {stamp(before)}, {rolling}, {trusted})" for q, kinds, least, most, before, rolling, trusted in _MANY)
    return f"asked AS (SELECT * FROM (VALUES {', '.join(rows)}) v(query, kinds, least_, most_, before_, rolling_, trusted_))"


@query(f"""WITH {CALLS_SQL}, {_asked_sql()}, t AS (SELECT query, id, deadline FROM asked JOIN calls ON (len(kinds) = 0 OR list_contains(kinds, type)) AND (NOT trusted_ OR official) AND (NOT rolling_ OR rolling)
  AND ((least_ IS NULL AND most_ IS NULL AND before_ IS NULL) OR (NOT rolling AND deadline IS NOT NULL AND deadline >= coalesce(least_, deadline) AND deadline <= coalesce(most_, deadline) AND deadline < coalesce(before_, deadline + INTERVAL 1 DAY))))
SELECT query, id, deadline, row_number() OVER (PARTITION BY query ORDER BY deadline, id) AS ord FROM t QUALIFY ord <= 200""")
def plain_language_search(spark: SparkSession, d: str) -> DataFrame:
    """Many queries without terms at once: each call goes to the queries whose constraints it meets, the soonest two hundred of each first.

    The queries are a parameter and enter as constants; only each task's first rows of a query are shuffled."""
    asked = [(q, parse(q, _WHEN)) for q, *_ in _MANY]
    if any(p.terms or p.concepts for _, p in asked):
        raise ValueError("a query has terms")
    c = calls(spark, d)
    hits = F.array(*(F.when(lifecycle.meets(p.types, p.trusted, p.rolling, *(str(x) if x else None for x in (p.least, p.most, p.before))), F.lit(q)) for q, p in asked))
    rows = c.select("id", "deadline", F.explode(F.array_compact(hits)).alias("query"))
    by = Window.partitionBy("query").orderBy(F.col("deadline").asc_nulls_last(), "id")
    return rows.withColumn("ord", F.row_number().over(by).cast("long")).filter("ord <= 200").select("query", "id", "deadline", "ord")


_PT = {"blue": 1.0, "steel": 1.0, "small": 1.0, "copper": 1.0}
_P = f"{PAPERS_SQL}, c AS (SELECT id, title, year, citations, topics, method, venue, open_url, list_concat(string_split(lower(title), ' '), list_concat(list_transform(topics, lambda x: lower(x)), string_split(lower(method), ' '))) AS h, string_split(lower(venue), '#') AS b FROM papers)"


def _scored_papers(rows: DataFrame) -> DataFrame:
    high = F.concat(F.split(F.lower("title"), " "), F.transform("topics", F.lower), F.split(F.lower("method"), " "))
    return S.scored(rows, high, F.split(F.lower("venue"), "#"), _PT, 2.5, floor=1.0).withColumn("score", F.round("score", 4))


@query(f"WITH {_P}, {_bm25(_PT, 2.5, 1.0)}, r AS (SELECT *, round(score, 4) AS s FROM sc) SELECT id, s AS score, row_number() OVER (ORDER BY s DESC, year DESC, title, id) AS ord, (SELECT count(*) FROM r) AS total, 30::BIGINT AS next_offset FROM r QUALIFY ord BETWEEN 11 AND 30")
def bm25_papers(spark: SparkSession, d: str) -> DataFrame:
    return S.page(_scored_papers(papers(spark, d)), S.SORTS["relevance"](), 10, 20).select("id", "score", "ord", "total", "next_offset")


@query(f"WITH {PAPERS_SQL}, f AS (SELECT * FROM papers WHERE year = 2001 AND open_url IS NOT NULL), r AS (SELECT id, year, title, row_number() OVER (ORDER BY year DESC, title, id) AS ord, count(*) OVER () AS total FROM f) SELECT id, ord, total, CASE WHEN total > 25 THEN 25 END::BIGINT AS next_offset FROM r WHERE ord <= 25")
def papers_recent(spark: SparkSession, d: str) -> DataFrame:
    return S.page(S.faceted(papers(spark, d), year=2001, open_only=True), S.SORTS["recent"](), 0, 25).select("id", "ord", "total", "next_offset")


@query(f"""WITH {PAPERS_SQL}, o AS (SELECT id, venue, citations, row_number() OVER (PARTITION BY venue ORDER BY coalesce(citations, 0) DESC, year DESC, id) AS ord, count(*) OVER (PARTITION BY venue) AS total FROM papers),
q AS (SELECT * FROM (VALUES (0, 10), (10, 20), (37, 50), (60, 1)) v(off, lim))
SELECT venue, off::BIGINT AS "offset", id, citations, ord, total, CASE WHEN total > off + lim THEN off + lim END::BIGINT AS next_offset FROM o, q WHERE ord > off AND ord <= off + lim""")
def paper_pages_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Four pages of each venue's most cited papers, out of the stored order."""
    p = papers(spark, d).withColumn("_cited", F.coalesce("citations", F.lit(0)))
    stored = page_index.build(p, "venue", [("_cited", True), ("year", True), ("id", False)], 32)
    asked = F.inline(F.array(*(F.struct(F.lit(o).cast("long").alias("offset"), F.lit(n).cast("long").alias("limit")) for o, n in ((0, 10), (10, 20), (37, 50), (60, 1)))))
    found = page_index.many(stored, p.select("venue").distinct().select("venue", asked))
    return found.select("venue", "offset", "id", "citations", "ord", "total", "next_offset")


@query(f"WITH {PAPERS_SQL}, r AS (SELECT id, citations, row_number() OVER (ORDER BY coalesce(citations, 0) DESC, year DESC, id) AS ord FROM papers WHERE list_contains(topics, 'blue')) SELECT id, citations, ord FROM r WHERE ord <= 50")
def papers_cited(spark: SparkSession, d: str) -> DataFrame:
    return S.page(S.faceted(papers(spark, d), topic="blue"), S.SORTS["cited"](), 0, 50).select("id", "citations", "ord")


@query(f"WITH {PAPERS_SQL} SELECT 'year' AS facet, year::VARCHAR AS value, count(*) AS n FROM papers GROUP BY ALL UNION ALL SELECT 'method', method, count(*) FROM papers GROUP BY ALL UNION ALL SELECT 'topic', t, count(*) FROM (SELECT id, unnest(list_distinct(topics)) AS t FROM papers) GROUP BY ALL")
def facet_values(spark: SparkSession, d: str) -> DataFrame:
    """All facets in one pass: each paper becomes its (facet, value) pairs."""
    pair = lambda n, v: F.struct(F.lit(n).alias("facet"), v.cast("string").alias("value"))
    pairs = F.concat(F.array(pair("year", F.col("year")), pair("method", F.col("method"))), F.transform(F.array_distinct("topics"), lambda t: pair("topic", t)))
    return papers(spark, d).select(F.inline(pairs)).groupBy("facet", "value").agg(F.count("*").alias("n"))


@query(f"WITH {PAPERS_SQL}, r AS (SELECT id, venue, year, row_number() OVER (PARTITION BY venue, year ORDER BY citations DESC, id) AS n FROM papers) SELECT id, venue, year FROM r WHERE n <= 2")
def per_year_cap(spark: SparkSession, d: str) -> DataFrame:
    return S.capped(papers(spark, d), ["venue", "year"], 2, F.desc("citations"), F.col("id")).select("id", "venue", "year")


@query(f"WITH {PAPERS_SQL}, a AS (SELECT id, row_number() OVER (ORDER BY citations DESC, id) AS ord FROM papers WHERE method LIKE 'P%' QUALIFY ord <= 10), b AS (SELECT id, row_number() OVER (ORDER BY id) AS ord FROM papers QUALIFY ord <= 40), u AS (SELECT id, 0 AS p, ord FROM a UNION ALL SELECT id, 1, ord FROM b WHERE id NOT IN (SELECT id FROM a)) SELECT id, o AS ord FROM (SELECT id, row_number() OVER (ORDER BY p, ord) AS o FROM u) WHERE o <= 18")
def shortlist_18(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d)
    number = lambda df, *o: df.withColumn("ord", F.row_number().over(Window.orderBy(*o)))
    best = number(p.filter(F.col("method").startswith("P")).orderBy(F.desc("citations"), "id").limit(10), F.desc("citations"), "id")
    return S.shortlist(best, number(p.orderBy("id").limit(40), "id"), 18)


@query()
def diversify_greedy(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty of each venue, chosen for score and novelty, and after them all others by rank."""
    return S.diversified(_scored_papers(papers(spark, d)), "venue", 50, tail=True)


@query(f"""WITH {PAPERS_SQL}, m AS (SELECT venue, max(n) AS top FROM (SELECT venue, t, count(*) AS n FROM (SELECT venue, unnest(topics) AS t FROM papers) GROUP BY ALL) GROUP BY venue),
k AS (SELECT venue, t, count(*) AS n FROM (SELECT venue, unnest(topics) AS t FROM papers) GROUP BY ALL), r AS (SELECT k.venue, t, n, greatest(5, round(n * 100.0::DOUBLE / top, 4))::DOUBLE AS pct, row_number() OVER (PARTITION BY k.venue ORDER BY n DESC, t) AS ord FROM k JOIN m ON k.venue = m.venue)
SELECT venue, t AS label, n, pct, ord FROM r WHERE ord <= 8""")
def histogram_pct_of_max(spark: SparkSession, d: str) -> DataFrame:
    n = papers(spark, d).select("venue", F.explode("topics").alias("label")).groupBy("venue", "label").agg(F.count("*").alias("n"))
    by = Window.partitionBy("venue")
    out = n.withColumns({"pct": F.greatest(F.lit(5.0), F.round(F.col("n") * 100.0 / F.max("n").over(by), 4)), "ord": F.row_number().over(by.orderBy(F.desc("n"), "label")).cast("long")})
    return out.filter("ord <= 8")


def _labels_sql(rules: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{n}' END" for n, p in rules) + "], lambda x: x IS NOT NULL)"


_CLASSIFIED_SQL = f"""p AS (SELECT doc_id, source, text, lower(concat({_DOMAINS_SQL}[{_N_SQL} % 10 + 1], ' ', CASE WHEN doc_id % 9 = 0 THEN '' ELSE coalesce(text, '') END)) AS t FROM documents),
k AS (SELECT doc_id, source, {_labels_sql(taxonomy.TOPICS)} AS topics, {_labels_sql(taxonomy.METHODS)} AS methods, CASE WHEN doc_id % 9 = 0 OR coalesce(text, '') = '' THEN 'title-only' ELSE 'title-and-abstract' END AS evidence FROM p)"""


def _classified(spark: SparkSession, d: str) -> DataFrame:
    """documents as papers: the source's domain is the title, the text the abstract, which each ninth one lacks."""
    n = F.coalesce(F.regexp_extract("source", "[0-9]+", 0).try_cast("int"), F.lit(0))
    title = F.get(F.array(*map(F.lit, _DOMAINS)), n % len(_DOMAINS))
    rows = spread(table(spark, d, "documents").select("doc_id", "source", "text"))
    return rows.select("doc_id", "source", taxonomy.classified(title, F.when(F.col("doc_id") % 9 != 0, F.col("text"))).alias("c")).select("doc_id", "source", "c.*")


@query(f"WITH {_CLASSIFIED_SQL} SELECT doc_id, array_to_string(topics, '; ') AS topics, array_to_string(methods, '; ') AS methods, evidence FROM k")
def paper_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """All topics and methods that whole papers name."""
    return _classified(spark, d).select("doc_id", F.array_join("topics", "; ").alias("topics"), F.array_join("methods", "; ").alias("methods"), "evidence")


@query(f"""WITH {_CLASSIFIED_SQL}, u AS (SELECT source, 'theme' AS kind, unnest(topics) AS label FROM k UNION ALL SELECT source, 'method', unnest(methods) FROM k), n AS (SELECT source, kind, label, count(*) AS n FROM u GROUP BY ALL)
SELECT source, kind, label, n, row_number() OVER (PARTITION BY source, kind ORDER BY n DESC, label) AS ord FROM n""")
def venue_themes(spark: SparkSession, d: str) -> DataFrame:
    """How often each venue's papers have each theme and method."""
    pairs = lambda kind, c: F.transform(c, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("label")))
    n = _classified(spark, d).select("source", F.inline(F.concat(pairs("theme", "topics"), pairs("method", "methods")))).groupBy("source", "kind", "label").agg(F.count("*").alias("n"))
    return n.withColumn("ord", F.row_number().over(Window.partitionBy("source", "kind").orderBy(F.desc("n"), "label")).cast("long"))
