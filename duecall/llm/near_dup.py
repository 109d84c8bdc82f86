"""MinHash near-dedup by an inverted join over signature coordinates.

A document's set holds its distinct shingles of ``words`` words (A-Z in lower case, parted
by ``[\\x20\\x09-\\x0D]+``); with fewer words the whole sequence is its one shingle, and
without words the set is empty and linked with nothing. Two documents are linked where
|A & B| / |A | B| >= 0.8, and a component is what links reach.

1. Equal sets form a class; one row for each class goes on.
2. Each class has ``COORDINATES`` min-hashes, and is posted under each coordinate and value.
   Linked classes agree in at least ``MATCHES`` coordinates (but for a chance under 1e-7,
   the binomial tail at 0.8). So in any order of the postings, two linked classes meet
   in a list even if each leaves out its last ``MATCHES - 1``: each leaves out its most
   frequent ones (prefix merging). These long lists are never merged: for a pair that met in
   a short one, the whole count of collisions is looked up in the two signatures (skip
   merging), and pairs under MATCHES go. Classes with fewer than MATCHES shared coordinates go altogether.
3. A class also carries the parity of its shingles' counts in ``BITS`` buckets. Two parities
   differ in no more bits than the sets in elements, so a pair whose bits differ more than
   0.8 allows is no link: that bound is exact, loses nothing, and holds before pairs are emitted.
4. Stars: in each list every class is paired with one centre, drawn by hash. Pairs that
   can be links are confirmed on the full sets, and the links' components
   are found. A large group of near copies thus takes a few pairs for each copy.
5. The rest: in lists with more than one component, the classes outside the list's largest
   component are compared with those of other components, all of them; only pairs within
   the parity bound are emitted, and confirmed likewise. Near copies share most of their lists, so a class
   carries the tokens of its long lists, and a pair is emitted in the first that it shares only. No link between components is
   lost; links within one need no pair.

Nothing is capped or sampled. A null text is an empty one. Each row is a node of its own
by its text: rows that share a doc_id aren't linked by that. A null doc_id has a null
component unless it is linked to others. Ties go to the smallest doc_id. An empty table
gives no rows; extra columns, whatever their names, pass through ``representatives``.
Sets are told apart by 64-bit hashes of shingles and of sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duecall.llm.common import documents, packed, small_batches, text_key, unpacked, written

COORDINATES, MATCHES = 32, 12
#: Bits of a parity sketch; a power of two.
BITS = 1024
#: Sets of fewer shingles are linked with equal ones only: 4 of 5 is the first other way to 0.8.
SMALLEST = 4
#: In lists of so many classes a pair is emitted once, whatever the number of such lists that it shares.
LONG_LIST = 64
KEPT_WORDS = 1_000_000
_A = np.array([xxhash.xxh64_intdigest(b"a%d" % k) | 1 for k in range(COORDINATES)], np.uint64)
_B = np.array([xxhash.xxh64_intdigest(b"b%d" % k) for k in range(COORDINATES)], np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every bit depends on all (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    """Word -> its hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, words: int, hashes: Hashes) -> np.ndarray:
    """The sorted distinct shingles of a text, hashed."""
    found = text.encode().lower().split()
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, n)
    width = min(words, n)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : n - width + 1 + k])
    return np.unique(out)


def signature(x: np.ndarray) -> np.ndarray:
    """COORDINATES numbers, each with its coordinate in the low bits: equal for two sets with a chance of their similarity."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(x), 2048):
        np.minimum(least, (x[k : k + 2048, None] * _A + _B).min(axis=0), out=least)
    low = np.uint64(COORDINATES - 1)
    return (mixed(least) & ~low) | np.arange(COORDINATES, dtype=np.uint64)


def set_key(x: np.ndarray) -> int:
    return np.uint64(xxhash.xxh3_64_intdigest(x.tobytes())).astype(np.int64).item()


def parity(x: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles in each of BITS buckets, as longs; a set's sketch xor
    another's has at most as many bits as the sets' symmetric difference has elements."""
    odd = np.bincount((x & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


SIGNED = "doc_id long, tkey long, n long, key long, signature array<long>, parity array<long>"


def signed(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, tkey, n, key, signature, parity) of each row; no signature and parity for sets under SMALLEST."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            sets = [shingles(x or "", words, hashes) for x in b.column(2).to_pylist()]
            sigs = [signature(x).view(np.int64) if len(x) >= SMALLEST else None for x in sets]
            bits = [parity(x) if len(x) >= SMALLEST else None for x in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), b.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array([set_key(x) if len(x) else None for x in sets], pa.int64()), pa.array(sigs, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                ["doc_id", "tkey", "n", "key", "signature", "parity"],
            )

    small_batches(docs.sparkSession)
    return docs.select("doc_id", text_key(F.col("text")).alias("tkey"), "text").mapInArrow(run, SIGNED)


#: Up to so many keys, 16 bytes each, are sent to all executors to find their texts; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(key, shingles) of the keys in wanted, a written frame of (tkey, key) with one text for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            sets = [shingles(x or "", words, hashes) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["key", "shingles"])

    few = wanted.count() <= BROADCAST_KEYS
    texts = docs.select(text_key(F.col("text")).alias("tkey"), "text").join(F.broadcast(wanted) if few else wanted, "tkey").select("key", "text")
    return texts.mapInArrow(run, "key long, shingles array<long>").dropDuplicates(["key"])


def postings(classes: DataFrame) -> DataFrame:
    """(token, key, centre): lists of two classes or more, without each class's most frequent MATCHES - 1.

    Lists are counted with map-side sums and written, then joined back: the join is between
    two plain shuffles, so that Spark can split a long list.
    """
    posted = classes.select(F.explode("signature").alias("token"), "key")
    lists = posted.groupBy("token").agg(F.count("*").alias("n"), F.min_by("key", F.xxhash64("token", "key")).alias("centre")).filter("n > 1")
    shared = posted.join(written(lists, "lists"), "token")
    by_length = Window.partitionBy("key").orderBy(F.desc("n"), F.desc("token"))
    return shared.withColumn("_place", F.row_number().over(by_length)).filter(F.col("_place") >= MATCHES).select("token", "key", "centre")


def pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def near(a_n: Column, b_n: Column, a_parity: Column, b_parity: Column) -> Column:
    """Whether sizes and parities allow 0.8: the symmetric difference of linked sets is at most a ninth of both sizes."""
    differ = sum((F.bit_count(F.get(a_parity, F.lit(k)).bitwiseXOR(F.get(b_parity, F.lit(k)))) for k in range(1, BITS // 64)), F.bit_count(F.get(a_parity, F.lit(0)).bitwiseXOR(F.get(b_parity, F.lit(0)))))
    return (F.least(a_n, b_n) * 5 >= F.greatest(a_n, b_n) * 4) & (differ * 9 <= a_n + b_n)


def side(t: DataFrame, c: str) -> DataFrame:
    return t.select(*(F.col(x).alias(c if x == "key" else f"{c}_{x}") for x in t.columns))


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that can be links, with their sizes: by sizes and parities, then by the count of all collisions."""
    sig = classes.select("key", "n", "signature", "parity")
    both = pairs.join(side(sig, "a"), "a").join(side(sig, "b"), "b").filter(near(F.col("a_n"), F.col("b_n"), F.col("a_parity"), F.col("b_parity")))
    return both.filter(F.size(F.array_intersect("a_signature", "b_signature")) >= MATCHES).select("a", "b", "a_n", "b_n")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """The links among pairs (a, b, a_n, b_n), a written frame: by the full sets, made from the texts of these alone."""
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    sets = written(full_sets(docs, written(classes.select("tkey", "key").join(keys, "key"), "wanted"), words), "sets")
    both = pairs.join(side(sets, "a"), "a").join(side(sets, "b"), "b")
    common = F.size(F.array_intersect("a_shingles", "b_shingles")).cast("long")
    return both.filter(common * 100 >= (F.col("a_n") + F.col("b_n") - common) * 80).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(key, component) of the keys in links (a, b): one key of each group that links reach.

    Each round a key hooks on to the least key next to it, and the hooks are followed to
    their roots; then the links between roots take their place. A root is less than all
    next to it, so at least half of the keys go each round, and links within a group at once.
    """
    links, names = written(links.select(*pair(F.col("a"), F.col("b"))).filter("a <> b").distinct(), "links"), None
    while True:
        both = links.union(links.select("b", "a"))
        hooks = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("next")).withColumnRenamed("a", "key"), "hooks")
        while True:
            after = written(hooks.join(hooks.select(F.col("key").alias("next"), F.col("next").alias("root")), "next"), "roots")
            hooks = after.select("key", F.col("root").alias("next"))
            if after.filter("next <> root").isEmpty():
                break
        roots = hooks.withColumnRenamed("next", "component")
        names = roots if names is None else written(renamed(names, roots), "names")
        ends = links.join(roots.select(F.col("key").alias("a"), F.col("component").alias("x")), "a").join(roots.select(F.col("key").alias("b"), F.col("component").alias("y")), "b")
        links = written(ends.filter("x <> y").select(*pair(F.col("x"), F.col("y"))).distinct(), "links")
        if links.isEmpty():
            return names


def renamed(names: DataFrame, roots: DataFrame) -> DataFrame:
    """names (key, component) with components that are keys of roots renamed to theirs."""
    new = roots.select(F.col("key").alias("component"), F.col("component").alias("new"))
    rest = [c for c in names.columns if c != "component"]
    return names.join(new, "component", "left").select(*rest, F.coalesce("new", "component").alias("component"))


def met(left: DataFrame) -> DataFrame:
    """The pairs (a, b) within the parity bound of classes of different components that share a list: once if they share a long one, and once for each short one."""
    rest = left.filter("outer").drop("outer")
    other = left.select("token", F.col("key").alias("k2"), F.col("component").alias("c2"), F.col("n").alias("n2"), F.col("parity").alias("p2"), F.col("long").alias("long2"), F.col("outer").alias("outer2"))
    fit = (F.col("component") != F.col("c2")) & (~F.col("outer2") | (F.col("component") < F.col("c2"))) & near(F.col("n"), F.col("n2"), F.col("parity"), F.col("p2"))
    first = F.col("long").isNull() | (rest["token"] == F.array_min(F.array_intersect("long", "long2")))
    return rest.join(other, (rest["token"] == other["token"]) & fit & first).select(*pair(F.col("key"), F.col("k2")))


def grouped(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, tkey, n_shingles, component_id) of each row of docs (doc_id, text)."""
    rows = written(signed(docs, words), "signed")
    by_key = rows.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.min("tkey").alias("tkey"))
    by_key = written(by_key, "classes")
    one = by_key.select("key", F.col("tkey").alias("_t"))
    classes = rows.filter(f"n >= {SMALLEST}").join(one, "key").filter("tkey = _t").select("key", "n", "tkey", "signature", "parity")
    classes = written(classes.dropDuplicates(["key"]), "signatures")
    lists = written(postings(classes), "postings")
    stars = lists.filter("key <> centre").select(*pair(F.col("key"), F.col("centre"))).distinct()
    links = written(confirmed(written(likely(written(stars, "stars"), classes), "likely"), classes, docs, words), "star_links")
    found = components(links)
    # lists in which more than one component is left, and the largest of each
    named = lists.join(found, "key", "left").select("token", "key", F.coalesce("component", "key").alias("component"))
    named = written(named, "named")
    sizes = named.groupBy("token", "component").agg(F.count("*").alias("m"))
    open_lists = sizes.groupBy("token").agg(F.max(F.struct("m", "component")).alias("top"), F.count("*").alias("k"), F.sum("m").alias("rows")).filter("k > 1").select("token", F.col("top.component").alias("top"), "rows")
    long = F.when(F.col("rows") >= LONG_LIST, F.col("token"))
    left = named.join(written(open_lists, "open"), "token").withColumn("long", F.when(long.isNotNull(), F.collect_list(long).over(Window.partitionBy("key"))))
    left = left.join(classes.select("key", "n", "parity"), "key").select("token", "key", "component", "n", "parity", "long", (F.col("component") != F.col("top")).alias("outer"))
    left = written(left, "left")
    cross = written(met(left).distinct(), "cross")
    more = written(confirmed(written(likely(cross, classes), "cross_likely"), classes, docs, words), "cross_links")
    joined = None
    if not more.isEmpty():
        ends = more.join(side(found, "a"), "a", "left").join(side(found, "b"), "b", "left")
        joined = components(ends.select(F.coalesce("a_component", "a").alias("a"), F.coalesce("b_component", "b").alias("b")))
    # the smallest doc_id of each component; keys with one row of their own need no entry
    whole = by_key.join(found, "key", "left").withColumn("component", F.coalesce("component", "key"))
    if joined is not None:
        whole = renamed(whole, joined)
    least = written(whole.groupBy("component").agg(F.min("least_id").alias("component_id"), F.sum("copies").alias("rows")).filter("rows > 1"), "least")
    ids = written(whole.join(least, "component").select("key", "component_id"), "ids")
    out = rows.select("doc_id", "tkey", "n", "key").join(ids, "key", "left")
    return out.select("doc_id", "tkey", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grouped(documents(spark, sf_dir).select("doc_id", "text"), 2)
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def representatives(docs: DataFrame, words: int = 5) -> DataFrame:
    """docs, all columns, with one document of each component: the one with the smallest doc_id, once if its row repeats."""
    kept = grouped(docs.select("doc_id", "text"), words).filter("doc_id is null or doc_id = component_id")
    kept = kept.select("doc_id", "tkey").distinct()
    rows = packed(docs, d=F.col("doc_id"), k=text_key(F.col("text")))
    rows = rows.join(kept, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("tkey")), "left_semi")
    return unpacked(rows.dropDuplicates(["d", "k"]), docs.columns)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON m.x = d.doc_id
"""
