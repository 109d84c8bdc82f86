"""Quality rules: rules on each text, and the frequency of lines across documents. DataFrame functions only.

Base rules, on the words ``[^\\x20\\x09-\\x0D]+`` of the whole text: fewer than 20 words,
or more than 30 % of the words in 8-word windows that the text holds twice or more.

Lines across documents: lines are normalised (lower case, white space collapsed) and
hashed with the document's host. A line is boilerplate where more than ``MAX_DOCUMENTS``
distinct documents of one host hold it, whatever stands around it. Documents of equal
text count as one: exact copies of a document don't make its lines boilerplate. Near
copies count each. Boilerplate lines are removed; a document is depleted, and rejected,
where fewer than ``LEAST_LEFT`` % of its words are left.

A null text has no words and fails the base rules; a null source is a host of its own.
Rows equal in doc_id and text are one document and get the same verdict. Lines without
a word don't count. An empty table gives no rows. Extra columns, whatever their names,
pass through ``cleaned`` unchanged.

Each text is read once: its figures and its lines' hashes are written, and the counts,
the verdicts and the numbers of the lines to remove come from that narrow table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duecall.llm.common import ROW, SPACE, documents, let, packed, text_key, unpacked, words, written

MIN_WORDS, MAX_REPEAT, WINDOW = 20, 30, 8
MAX_DOCUMENTS, LEAST_LEFT = 25, 20
_DOC = ("doc_id", "tkey")


def repeat_words(found: Column) -> Column:
    """How many words lie in windows of WINDOW words that occur twice or more, the first included.

    Texts whose windows all differ, as nearly all do, are told by one hash set; only
    the others sort their windows by hash and place.
    """

    def covered(places: Column) -> Column:
        return F.aggregate(
            F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW)))),
            F.lit(0).cast("long"),
            lambda n, x: n + x,
        )

    def twice(pairs: Column) -> Column:
        hits = F.filter(pairs, lambda p, i: F.coalesce(F.get(pairs, i - 1)["h"] == p["h"], F.lit(False)) | F.coalesce(F.get(pairs, i + 1)["h"] == p["h"], F.lit(False)))
        return let(F.sort_array(F.transform(hits, lambda p: p["i"])), covered)

    def of(w: Column) -> Column:
        hashed = F.transform(w, lambda x: F.xxhash64(x))
        windows = let(hashed, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW)))))
        pairs = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        some = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs(h), twice)))
        return F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(some)

    return let(found, of)


def base(text: Column) -> list[Column]:
    """n_words, n_repeat_words, word_chars, n_symbols and n_dup_lines of a text that isn't null."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r")))
    return [
        counts.alias("counts"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    ]


def normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACE, " ")))


def lines(text: Column, host: Column) -> Column:
    """array<struct(at, line, words)>: the normalised lines with a word, by number in the
    text; line is hashed with the host."""

    def rows(found: Column) -> Column:
        row = lambda x: F.struct(
            x["at"].alias("at"),
            F.xxhash64(host.isNull(), host, x["line"]).alias("line"),
            (F.length(x["line"]) - F.length(F.translate(x["line"], " ", "")) + 1).cast("long").alias("words"),
        )
        return F.transform(found, row)

    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.struct(normal(x).alias("line"), i.alias("at")))
    return let(F.filter(numbered, lambda x: x["line"] != ""), rows)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, n_words, n_repeat_words, word_chars, n_symbols, n_dup_lines, base_failed, lines) of each row, written."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", text_key(F.col("text")).alias("tkey"), *base(text), lines(text, F.col("source")).alias("lines"))
    out = out.select("doc_id", "tkey", F.col("counts.n").alias("n_words"), F.col("counts.r").alias("n_repeat_words"), "word_chars", "n_symbols", "n_dup_lines", "lines")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return written(out.withColumn("base_failed", failed), "measured")


def boilerplate(found: DataFrame, limit: int = MAX_DOCUMENTS) -> DataFrame:
    """The lines, hashed with their host, that more than limit distinct documents hold."""
    votes = found.select("line", "tkey").distinct()
    return votes.groupBy("line").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("line")


def removed(rows: DataFrame, limit: int = MAX_DOCUMENTS) -> DataFrame:
    """(doc_id, tkey, at, words) of the boilerplate lines of measured rows; each once where rows repeat.

    The boilerplate is written first: Spark then knows its size, and broadcasts it or
    joins by sorting, where it can split the partition of a very common line.
    """
    found = rows.select("doc_id", "tkey", F.inline("lines"))
    common = written(boilerplate(found, limit), "boilerplate")
    hits = found.join(common, "line", "left_semi")
    return hits.groupBy(*_DOC, "at").agg(F.max("words").alias("words"))


def judged(docs: DataFrame, limit: int = MAX_DOCUMENTS) -> DataFrame:
    """measured() with n_removed_lines, words_left, kept and the numbers of the removed lines."""
    rows = measured(docs)
    gone = removed(rows, limit).groupBy(*_DOC).agg(F.count("*").alias("n_removed_lines"), F.sum("words").alias("_gone"), F.sort_array(F.collect_list("at")).alias("removed_at"))
    gone = gone.withColumnsRenamed({"doc_id": "_d", "tkey": "_t"})
    out = rows.drop("lines").join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tkey") == F.col("_t")), "left").drop("_d", "_t")
    out = out.withColumn("n_removed_lines", F.coalesce("n_removed_lines", F.lit(0))).withColumn("words_left", F.col("n_words") - F.coalesce("_gone", F.lit(0)))
    return out.drop("_gone").withColumn("kept", ~F.col("base_failed") & (100 * F.col("words_left") >= LEAST_LEFT * F.col("n_words")))


def cleaned(docs: DataFrame, limit: int = MAX_DOCUMENTS) -> DataFrame:
    """The kept rows of docs, all columns, without their boilerplate lines."""
    verdict = judged(docs.select("doc_id", "text", "source"), limit).filter("kept").groupBy(*_DOC).agg(F.first("removed_at").alias("at"))
    text = F.col("text")
    rows = packed(docs, d=F.col("doc_id"), k=text_key(text))
    out = rows.join(verdict, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("tkey")))
    text = F.col(f"{ROW}.text")
    kept = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("at")), lambda i: F.get(x, i))
    left = F.array_join(let(F.split(text, "\n"), kept), "\n")
    return unpacked(out, docs.columns, text=F.when(F.size("at") > 0, left).otherwise(text))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "words_left")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (SELECT doc_id, i, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g, count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS n FROM w),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g WHERE n = 8),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM t, (SELECT unnest(range(8)) AS k) WHERE c > 1 GROUP BY doc_id),
l0 AS (SELECT doc_id, source, md5(text) AS tkey, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
l1 AS (SELECT doc_id, source, tkey, raw, pos, lower(trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line FROM l0 WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n_dup_lines FROM l1 GROUP BY doc_id),
b AS (SELECT source, line FROM l1 GROUP BY ALL HAVING count(DISTINCT tkey) > 25),
x AS (SELECT doc_id, count(*) AS n, sum(length(l1.line) - length(replace(l1.line, ' ', '')) + 1) AS gone FROM l1 JOIN b ON l1.line = b.line AND l1.source IS NOT DISTINCT FROM b.source GROUP BY doc_id),
m AS (SELECT doc_id, (SELECT count(*) FROM w WHERE w.doc_id = d.doc_id) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols FROM d)
SELECT m.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words) AND 100 * (n_words - coalesce(gone, 0)) >= 20 * n_words AS kept,
  coalesce(x.n, 0)::BIGINT AS n_removed_lines, (n_words - coalesce(gone, 0))::BIGINT AS words_left
FROM m LEFT JOIN dup USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN x USING (doc_id)
"""
