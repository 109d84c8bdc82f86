"""Benchmark decontamination by winnowing: fingerprints of test items met in texts, extended to whole windows. DataFrame functions only.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text in which A-Z is lower case. Any ``SPAN``
words in a row of an item are a window; an item of fewer words, but not none, is one window.
Of the ``GRAM``-word grams in a window the one with the least hash is its fingerprint, so a
passage of ``SPAN`` words that stands in an item and in a text has the same fingerprint in both:
none is missed. A window of a short item is its own gram.

Texts are cut into blocks that begin every ``BLOCK`` words and overlap by a window less a word, so
that a row never grows with its text. The distinct fingerprints of each block are joined to the
items'. A hit is extended to the windows that chose it, and these are joined to the items' windows
by a 128-bit hash of all their words. Neither join has more than one partner for a text's row,
however often a passage recurs in texts or items. What is met is gathered by text, not by row,
and items are gathered for each distinct set of windows, so that copies of a passage are worked once.

The items' distinct fingerprints are counted: up to ``BROADCAST`` of them (16 MB) are broadcast, more are
joined by a shuffle of the texts' fingerprints, and the blocks then follow.

A null text has no words, and so no hits; so does an item. Repeated rows have equal results, each
its own. Items are told apart by item_id, a null one being an empty string: rows of one id are one item. An
empty table of documents gives no rows, an empty one of items no hits. Extra columns pass
through, whatever their names; one named leaks is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duecall.llm.common import documents, let, packed, unpacked, written

SPAN, GRAM, BLOCK = 10, 4, 512
BROADCAST = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words: all of ASCII but digits and letters.
_SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def folded_words(text: Column) -> Column:
    """The words of a text: every separator becomes a blank, at which a split is fast."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER + _SEPARATORS, _LOWER + " " * len(_SEPARATORS)), " "), "")


def hashes(text: Column) -> Column:
    """The words of a text, each as its hash."""
    return F.transform(folded_words(text), lambda w: F.xxhash64(w))


def every(h: Column, n: int, of) -> Column:  # noqa: ANN001
    """of(start) for each start of n elements in a row; empty if there are fewer."""
    return F.transform(F.when(F.size(h) >= n, F.sequence(F.lit(0), F.size(h) - n)).otherwise(F.array().cast("array<int>")), of)


def grams(h: Column, n: int) -> Column:
    """The hash of every n words in a row; n enters, so that lengths don't mix."""
    return every(h, n, lambda i: F.xxhash64(F.lit(n), *(F.get(h, i + k) for k in range(n))))


def paired(values: Column, apart: int, of) -> Column:  # noqa: ANN001
    """of(value, the one so far behind it), in order; the last ones meet a null."""
    return let(values, lambda a: F.zip_with(a, F.slice(a, apart + 1, F.size(a)), lambda x, y: of(x, y)))


def prints(h: Column, n: int) -> Column:
    """The fingerprint of every window of n words, in order.

    Grams of 4 words and least values of 7 grams come from pairs of pairs; what
    the nulls behind the end would spoil is cut off.
    """
    if n < SPAN:
        return grams(h, n)
    four = paired(paired(h, 1, F.xxhash64), 2, F.xxhash64)
    least = paired(paired(paired(four, 1, F.least), 2, F.least), 3, F.least)
    return F.slice(least, F.lit(1), F.greatest(F.size(h) - (SPAN - 1), F.lit(0)))


def identity(h: Column, i: Column, n: int) -> list[Column]:
    """Two 64-bit hashes of the n words from i on."""
    own = [F.get(h, i + k) for k in range(n)]
    return [F.xxhash64(F.lit(n), *own).alias("a"), F.xxhash64(F.lit(-n), *own).alias("b")]


def windows(h: Column, n: int) -> Column:
    """array<struct(at, f, a, b)>: every window of n words with its fingerprint and identity."""
    return let(prints(h, n), lambda f: F.transform(f, lambda x, i: F.struct(i.alias("at"), x.alias("f"), *identity(h, i, n))))


def items(benchmark: DataFrame) -> DataFrame:
    """(id, cls, h): the items with a word; equal texts have one class."""
    found = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), hashes(F.col("text")).alias("h"))
    return found.filter(F.size("h") > 0).withColumn("cls", F.md5(F.array_join(F.transform("h", lambda x: x.cast("string")), " ")))


def chunks(docs: DataFrame) -> DataFrame:
    """(k, j, base, h): the blocks of each text, by two hashes of it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    block = lambda w, at: F.struct(at.alias("base"), F.slice(w, at + 1, F.lit(BLOCK + SPAN - 1)).alias("h"))
    cut = let(hashes(text), lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(BLOCK)), lambda at: block(w, at)))
    return docs.select(F.xxhash64(text).alias("k"), F.xxhash64(F.lit(1), text).alias("j"), F.inline(cut))


def met(blocks: DataFrame, known: DataFrame, lengths: list[int]) -> DataFrame:
    """blocks with (f, n) of each of their distinct fingerprints that known holds."""
    own = F.array_distinct(F.concat(*(prints(F.col("h"), n) for n in lengths)))
    if known.limit(BROADCAST + 1).count() <= BROADCAST:
        return blocks.select("*", F.explode(own).alias("f")).join(F.broadcast(known), "f")
    named = blocks.select("k", "j", "base", F.explode(own).alias("f")).join(known, "f").distinct()
    return blocks.join(named, ["k", "j", "base"])


def chosen(n: int) -> Column:
    """array<struct(at, a, b)>: the windows of n words in block h that chose the fingerprint f."""
    places = let(prints(F.col("h"), n), lambda p: F.filter(F.transform(p, lambda x, i: F.when(x == F.col("f"), i)), lambda i: i.isNotNull()))
    return F.transform(places, lambda i: F.struct((F.col("base") + i).alias("at"), *identity(F.col("h"), i, n)))


def spans(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((k, j, at, n, a, b) of each window in docs that an item holds, (a, b, cls) of the items' windows)."""
    known = written(items(benchmark).groupBy("cls").agg(F.first("h").alias("h")), "classes")
    lengths = sorted(r[0] for r in known.select(F.least(F.size("h"), F.lit(SPAN)).alias("n")).distinct().collect())  # ten at most
    parts = [known.filter(F.least(F.size("h"), F.lit(SPAN)) == n).select("cls", F.lit(n).alias("n"), F.inline(windows(F.col("h"), n))) for n in lengths]
    none = "cls string, n int, at int, f long, a long, b long"
    own = docs.sparkSession.createDataFrame([], none)
    for p in parts:
        own = own.union(p)
    own = written(own.drop("at").distinct(), "windows")
    if not lengths:
        return docs.sparkSession.createDataFrame([], "k long, j long, at int, n int, a long, b long"), own
    hits = met(chunks(docs), own.select("f", "n").distinct(), lengths)
    wide = hits.select("k", "j", "n", F.inline(F.coalesce(*(F.when(F.col("n") == n, chosen(n)) for n in lengths))))
    return wide.join(own.select("a", "b").distinct(), ["a", "b"]), own.select("a", "b", "cls").distinct()


def covered(found: Column) -> Column:
    """How many words lie in any of the spans, an array<struct(at, n)> in order."""

    def add(done: Column, s: Column) -> Column:
        end = s["at"] + s["n"]
        return F.struct(F.greatest(done["end"], end).alias("end"), (done["sum"] + F.greatest(F.lit(0), end - F.greatest(done["end"], s["at"]))).alias("sum"))

    return F.aggregate(found, F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")), add, lambda done: done["sum"].cast("long"))


LEAKS = "struct<n_words:long,n_hit:long,spans:array<struct<at:int,n:int>>,items:array<string>>"


def leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(k, j, n_hit, spans, items) of each text with a hit."""
    found, members = spans(docs, benchmark)
    found = found.groupBy("k", "j").agg(F.sort_array(F.collect_set(F.struct("at", "n"))).alias("spans"), F.sort_array(F.collect_set(F.struct("a", "b"))).alias("held"))
    found = written(found.select("k", "j", covered(F.col("spans")).alias("n_hit"), "spans", "held", F.md5(F.to_json("held")).alias("set")), "leaks")
    sets = found.groupBy("set").agg(F.first("held").alias("held")).select("set", F.inline("held"))
    classes = sets.join(members, ["a", "b"]).select("set", "cls").distinct()
    named = classes.join(items(benchmark).select("cls", "id").distinct(), "cls").groupBy("set").agg(F.sort_array(F.collect_set("id")).alias("items"))
    return found.select("k", "j", "n_hit", "spans", "set").join(written(named, "items"), "set").drop("set")


def joined(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs packed, with n_words and, null where nothing is hit, n_hit, spans and items."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n_words = F.size(folded_words(text)).cast("long")
    found = written(leaked(docs.select("text"), benchmark), "leaked")
    rows = packed(docs, _k=F.xxhash64(text), _j=F.xxhash64(F.lit(1), text), n_words=n_words)
    return rows.join(found, (F.col("_k") == F.col("k")) & (F.col("_j") == F.col("j")), "left")


def scanned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with a column ``leaks``: its words, those that are hit, the windows met, and the items' ids."""
    empty = F.array().cast("array<struct<at:int,n:int>>")
    leaks = F.struct("n_words", F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("spans", empty), F.coalesce("items", F.array().cast("array<string>"))).cast(LEAKS)
    return unpacked(joined(docs, benchmark), docs.columns, leaks=leaks)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, in which no window of an item stands."""
    return unpacked(joined(docs, benchmark).filter("n_hit is null"), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "leaks.n_words", "leaks.n_hit", F.size("leaks.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leaks.items", ","), 256).alias("items_sha256"), (F.col("leaks.n_hit") > 0).alias("contaminated"),
    )


#: Every window of every text against every window of the items, by their words.
ORACLE = r"""
WITH i AS (SELECT coalesce(item_id::VARCHAR, '') AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda x: array_to_string(w[x:x + n - 1], ' '))) AS g FROM (SELECT id, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT r, n, unnest(range(len(w) - n + 1)) AS at_, unnest(list_transform(range(1, len(w) - n + 2), lambda x: array_to_string(w[x:x + n - 1], ' '))) AS g FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n),
h AS (SELECT r, n, at_, g FROM dw WHERE (n, g) IN (SELECT n, g FROM iw)),
p AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(at_, at_ + n)) AS x FROM h) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, id FROM h JOIN iw USING (n, g)) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN m USING (r)
"""
