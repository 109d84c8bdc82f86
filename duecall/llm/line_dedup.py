"""Line dedup by winnowing over line hashes.

A text's lines are normalised (lower case, white space collapsed), those without a word
are passed over, and the others are hashed. A window is the shortest run of lines with at
least ``MIN_WORDS`` words from a line on, or up to a line. Of each window the line with the
least hash, the rightmost if tied, is its fingerprint. Two texts that share a run of
lines with ``MIN_WORDS`` words share its windows, and so a fingerprint at the same place
in the run: none is missed.

A row goes out for each selected fingerprint only: its place, the hashes of the lines
around it as far as its windows reach, and the windows' extents. Fingerprints that occur
once are dropped. The positions of the others are joined to the first position of the
same fingerprint, by doc_id (null last), text and line, and the match is extended both
ways as long as the line hashes agree. Windows within the extended match occur earlier,
so their lines go. A window of which the first position isn't the origin, as other lines
stand there, is joined likewise to the first position of its own lines; none is passed over. A run of any
length is made of such windows, so exactly the lines in later runs of ``MIN_WORDS`` words
or more go. Fingerprints and windows are compared by 128 bits, extended lines by 64 each.

A null text stays null, an empty one empty; lines without a word stay. Rows equal in
doc_id and text are one document and get the same result. Runs may overlap: the first
window stays, whatever lies only in later ones goes. An empty table gives no rows. Extra
columns pass through, whatever their names; one named removed_lines is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duecall.llm.common import ROW, documents, let, packed, small_batches, text_key, unpacked, written

MIN_WORDS = 50


def normal_lines(text: str) -> list[tuple[int, bytes, int]]:
    """(number, normalised line, words) of each line with a word."""
    out = []
    for at, line in enumerate(text.encode().split(b"\n")):
        words = line.lower().split()
        if words:
            out.append((at, b" ".join(words), len(words)))
    return out


def windows(words: np.ndarray, least: int) -> np.ndarray:
    """(first, last) of the shortest runs with at least ``least`` words from each line on and up to each line, each once."""
    ends = np.cumsum(words)
    starts = ends - words
    n = len(words)
    last = np.searchsorted(ends, starts + least, "left")
    first = np.searchsorted(starts, ends - least, "right") - 1
    lines = np.arange(n)
    onward, back = last < n, first >= 0
    runs = np.concatenate([np.stack([lines[onward], last[onward]], 1), np.stack([first[back], lines[back]], 1)])
    return np.unique(runs, axis=0) if len(runs) else runs.reshape(0, 2)


def fingerprints(hashes: list[int], runs: list[list[int]]) -> list[int]:
    """For each run the line with the least hash in it, the rightmost if tied.

    Runs are sorted by their ends, both of which only rise, so the minimum slides along.
    """
    out, queue, head, fed = [], [], 0, 0
    for a, b in runs:
        while fed <= b:
            while len(queue) > head and hashes[queue[-1]] >= hashes[fed]:
                queue.pop()
            queue.append(fed)
            fed += 1
        while queue[head] < a:
            head += 1
        out.append(queue[head])
    return out


POSITIONS = "doc_id long, tkey long, f long, g long, mark int, before array<long>, after array<long>, windows array<struct<l:int,r:int,first:int,last:int>>"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.struct([(x, pa.int32()) for x in ("l", "r", "first", "last")])))
_NAMES = ("doc_id", "tkey", "f", "g", "mark", "before", "after", "windows")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def marked(text: str, least: int) -> Iterator[tuple]:
    """(f, g, mark, before, after, windows) of each selected fingerprint of a text: its hash, its
    line's number, the hashes of the lines before (nearest first) and after it, and its windows:
    how many lines they go left and right, and their first and last lines' numbers."""
    found = normal_lines(text)
    if not found:
        return
    at, lines, words = zip(*found, strict=True)
    wide = [xxhash.xxh3_128_intdigest(x) for x in lines]
    low = [signed(x & (1 << 64) - 1) for x in wide]
    spans = windows(np.array(words, np.int64), least)
    spans = spans[np.lexsort((spans[:, 0], spans[:, 1]))].tolist()
    by_mark: dict[int, list] = {}
    for (a, b), m in zip(spans, fingerprints(low, spans), strict=True):
        by_mark.setdefault(m, []).append((a, b))
    for m, own in by_mark.items():
        first, last = min(a for a, _ in own), max(b for _, b in own)
        ways = [{"l": m - a, "r": b - m, "first": at[a], "last": at[b]} for a, b in own]
        yield low[m], signed(wide[m] >> 64), at[m], low[first:m][::-1], low[m + 1 : last + 1], ways


def positions(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """The selected fingerprints of each document."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(doc, key, *x) for doc, key, text in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in marked(text or "", least)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], list(_NAMES))

    small_batches(docs.sparkSession)
    return docs.select("doc_id", text_key(F.col("text")).alias("tkey"), "text").mapInArrow(of, POSITIONS)


def agreeing(a: Column, b: Column) -> Column:
    """How many elements two arrays have in common from the start on."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return let(same, lambda s: let(F.array_position(s, False).cast("int"), lambda p: F.when(p == 0, F.size(s)).otherwise(p - 1)))


def place(line: str) -> Column:
    return F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "tkey", F.col(line).alias("line"))


def first_places(found: DataFrame, keys: tuple[str, str], line: str, name: str) -> DataFrame:
    """(*keys, origin): the first place of what occurs at two places or more. Aggregated before the
    shuffle, and written, so that a join with it can split the partition of a very common key."""
    ends = found.groupBy(*keys).agg(F.min(place(line)).alias("origin"), F.max(place(line)).alias("z"))
    return written(ends.filter("origin <> z").drop("z"), name)


def later(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, tkey, ranges): for each document with later runs their (first, last) line numbers."""
    found = written(positions(docs, least), "positions")
    found = written(found.join(first_places(found, ("f", "g"), "mark", "origins"), ["f", "g"]), "repeated")
    origin = found.filter(place("mark") == F.col("origin")).groupBy("f", "g").agg(F.first("before").alias("o_before"), F.first("after").alias("o_after"))
    met = found.filter(place("mark") > F.col("origin")).join(written(origin, "around"), ["f", "g"])
    met = met.withColumn("l", agreeing(F.col("before"), F.col("o_before"))).withColumn("r", agreeing(F.col("after"), F.col("o_after")))
    inside = lambda w: (w["l"] <= F.col("l")) & (w["r"] <= F.col("r"))
    of = lambda w: F.concat(F.reverse(F.slice("before", F.lit(1), w["l"])), F.array("f", "g"), F.slice("after", F.lit(1), w["r"]))
    own = lambda w: let(of(w), lambda x: F.struct(F.xxhash64(x).alias("u"), F.xxhash64(w["l"], x).alias("v"), w["first"].alias("first"), w["last"].alias("last")))
    met = met.select(
        "doc_id", "tkey",
        F.transform(F.filter("windows", inside), lambda w: F.struct(w["first"].alias("first"), w["last"].alias("last"))).alias("within"),
        F.transform(F.filter("windows", lambda w: ~inside(w)), own).alias("rest"),
    )
    met = written(met, "extended")
    rest = met.select("doc_id", "tkey", F.inline("rest"))
    again = rest.join(first_places(rest, ("u", "v"), "first", "others"), ["u", "v"]).filter(F.col("origin") < place("first"))
    ranges = met.select("doc_id", "tkey", F.inline("within")).union(again.select("doc_id", "tkey", "first", "last"))
    return ranges.groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))


def shortened(docs: DataFrame, least: int) -> DataFrame:
    """The packed rows of docs with their new text and how many lines went."""
    gone = later(docs.select("doc_id", "text"), least)
    rows = packed(docs, d=F.col("doc_id"), k=text_key(F.col("text")))
    out = rows.join(gone, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("tkey")), "left")
    text = F.col(f"{ROW}.text")
    out = out.withColumn("left", F.when(F.col("ranges").isNotNull(), cut(text, F.col("ranges"))))
    n = F.when(F.col("ranges").isNotNull(), F.size(F.split(text, "\n")) - F.size("left")).otherwise(0).cast("long")
    return out.select(ROW, F.when(F.col("ranges").isNotNull(), F.array_join("left", "\n")).otherwise(text).alias("new"), n.alias("n"))


def deduplicated(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """docs, all columns, with later runs taken out of text, and ``removed_lines``: how many lines went."""
    return unpacked(shortened(docs, least), docs.columns, text=F.col("new"), removed_lines=F.col("n"))


def cleaned(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """docs, all columns, with later runs taken out of text, without the documents of which they leave no word."""
    out = shortened(docs, least).filter((F.col("n") == 0) | F.col("new").rlike(r"[^\x20\x09-\x0D]"))
    return unpacked(out, docs.columns, text=F.col("new"))


def cut(text: Column, ranges: Column) -> Column:
    """The lines of text outside all ranges, and those without a word; in time linear in the lines."""

    def of(lines: Column) -> Column:
        within = F.array_distinct(F.flatten(F.transform(ranges, lambda r: F.sequence(r["first"], r["last"]))))
        gone = F.filter(within, lambda i: F.get(lines, i).rlike(r"[^\x20\x09-\x0D]"))
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i))

    return let(F.split(text, "\n"), of)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "removed_lines", "text")
