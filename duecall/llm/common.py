"""What several corpus operators share: shared-folder tables, word splitting, bound expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duecall.sources.staging import shared_path, written  # noqa: F401

#: The white space that parts words: blank and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows that cross to Python at once; texts may be long, so a batch stays small.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of an Arrow batch, so that long texts don't pile up in a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda variable, which no optimizer rule inlines."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text, null for none: an array that may be empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """Tells rows apart that share a doc_id: a 64-bit hash of the text. Rows equal in
    both doc_id and text are one document."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


#: The one name that a column of an operator's input must not have.
ROW = "_row"


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """docs as one struct column ROW, and more columns: no name of docs can clash with an operator's own."""
    if ROW in docs.columns:
        raise ValueError(f"a column is named {ROW}")
    row = F.struct(*(F.col(name(c)) for c in docs.columns))
    return docs.select(row.alias(ROW), *(c.alias(k) for k, c in more.items()))


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def unpacked(rows: DataFrame, columns: list[str], **own: Column) -> DataFrame:
    """The columns of a packed frame, in order. own has columns that replace those of the
    same name; those that have none come last."""
    old = [own.get(c, F.col(ROW).getField(c)).alias(c) for c in columns]
    return rows.select(*old, *(v.alias(k) for k, v in own.items() if k not in columns))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
