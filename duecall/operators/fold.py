"""The ordered merge of equal calls as a stream over sorted rows, which holds one record at a time.

Rows are dealt by key and sorted by (key, order) within their partition, which Spark does on disk if need be;
a task then reads them batch by batch, merges each row into the record so far, and gives the record out
when the key changes. Absorbed rows go out at once, so a key of any number of rows takes as
much memory as one record. Each merge depends on all before it, so the rows of one key are one task's.

The row takes over if it is strictly richer than what is merged so far, weighed anew each time. What the
preferred one lacks comes from the other; arrays are united, the preferred one's elements first;
maps are overlaid key by key, the preferred one's values above, nulls too. A null array or map is an empty one.
A null key is a key. Ties in order go by id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duecall.sources.staging import written


@dataclass(frozen=True)
class Shape:
    """The columns of a call: its key, order and id, and what becomes of the others; points are what a true flag adds to richness."""

    key: str
    order: str
    ident: str
    scalars: list[str]
    unions: list[str] = field(default_factory=list)
    maps: list[str] = field(default_factory=list)
    present: list[str] = field(default_factory=list)
    topics: str = "topics"
    points: dict[str, float] = field(default_factory=dict)

    def weigh(self, x: dict) -> float:
        """A point for each present field, half a point for up to six topics, and the flags' points."""
        return sum(x[c] is not None for c in self.present) + min(6, len(x.get(self.topics) or ())) / 2 + sum(n for c, n in self.points.items() if x[c])

    def over(self, a: dict, b: dict) -> dict:
        """a preferred over b."""
        out = {c: b[c] if a[c] is None else a[c] for c in self.scalars}
        out |= {c: list(dict.fromkeys([*a[c], *b[c]])) for c in self.unions}
        out |= {c: {**b[c], **a[c]} for c in self.maps}
        return out | {self.key: a[self.key], self.order: a[self.order], self.ident: a[self.ident], "n_merged": a["n_merged"] + b["n_merged"]}

    def taken(self, row: dict) -> dict:
        """A row as a record of its own."""
        return row | {c: list(dict.fromkeys(row[c] or ())) for c in self.unions} | {c: dict(row[c] or ()) for c in self.maps} | {"n_merged": 1}


def streamed(rows: DataFrame, shape: Shape) -> tuple[DataFrame, DataFrame]:
    """((*columns, n_merged) of each key's record, (id, merged_into, key) of each row that was absorbed)."""
    names = [shape.key, shape.order, shape.ident, *shape.scalars, *shape.unions, *shape.maps]
    names = list(dict.fromkeys(names))
    kinds = rows.select(*names).schema
    out = T.StructType([*(T.StructField(f.name, f.dataType) for f in kinds.fields), T.StructField("merged_into", kinds[shape.ident].dataType), T.StructField("n_merged", T.LongType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None
        weight, given, schema = 0.0, [], None
        for b in batches:
            schema = schema or pa.schema([*b.schema, pa.field("merged_into", b.schema.field(shape.ident).type), pa.field("n_merged", pa.int64())])
            for row in b.to_pylist():
                x = shape.taken(row)
                own = shape.weigh(x)
                if now is None or x[shape.key] != now[shape.key]:
                    if now is not None:
                        given.append(now)
                    now, weight = x, own
                    continue
                best, other = (x, now) if own > weight else (now, x)
                given.append({shape.key: x[shape.key], shape.ident: other[shape.ident], "merged_into": best[shape.ident]})
                now = shape.over(best, other)
                weight = shape.weigh(now)
            if given:
                yield listed(given, schema)
                given = []
        if now is not None:
            yield listed([now], schema)

    def listed(found: list[dict], schema: pa.Schema) -> pa.RecordBatch:
        plain = [{k: list(v.items()) if isinstance(v, dict) else v for k, v in x.items()} for x in found]
        return pa.RecordBatch.from_pylist(plain, schema)

    dealt = rows.select(*names).repartition(F.col(shape.key)).sortWithinPartitions(shape.key, F.col(shape.order).asc_nulls_last(), shape.ident)
    done = written(dealt.mapInArrow(fold, out), "folded")
    unique = done.filter("merged_into is null").drop("merged_into")
    return unique, done.filter("merged_into is not null").select(shape.ident, "merged_into", shape.key)
