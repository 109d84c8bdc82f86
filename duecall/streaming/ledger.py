"""A stream whose batches can be replayed: repeats are dropped, deferred rows come first, results are written once.

Rows that repeat an id within the watermark are dropped by the stream's own state. Each batch writes its results and what it defers to
folders named by its number, and then its number to the ledger. A batch that is run again, as after a crash
between its write and Spark's own note of it, reads the same deferred rows, those of the batch before, and overwrites its
own folders: nothing changes. A row that fails is tried first in the next batch, and given up after ``tries``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duecall.sources.sinks import _fs, moved


def _there(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def batch(folder: str, accepted: Callable[[], Column], tries: int) -> Callable[[DataFrame, int], None]:
    """What is done with a batch: the deferred rows of the one before and its own rows are judged by accepted()."""

    def run(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        work = rows.withColumns({"attempt": F.lit(1), "first_batch": F.lit(number).cast("long")})
        before = f"{folder}/deferred/batch={number - 1}"
        if number and _there(spark, before):
            again = spark.read.schema(work.schema).parquet(before).withColumn("attempt", F.col("attempt") + 1)
            work = again.unionByName(work)
        good = F.coalesce(accepted(), F.lit(False))
        work = work.withColumn("state", F.when(good, "accepted").when(F.col("attempt") >= tries, "given up").otherwise("deferred"))
        work.filter("state <> 'deferred'").write.mode("overwrite").parquet(f"{folder}/results/batch={number}")
        work.filter("state = 'deferred'").drop("state").write.mode("overwrite").parquet(f"{folder}/deferred/batch={number}")
        moved(spark, f"{folder}/LEDGER", str(number))

    return run


def ingest(events: DataFrame, folder: str, accepted: Callable[[], Column], key: str = "event_id", late: str = "1 hour", tries: int = 3, checkpoint: str | None = None) -> None:
    """Runs a stream of (key, ts, ...) to what is there now; later calls on the same folder go on from there."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    stream = rows.writeStream.foreachBatch(batch(folder, accepted, tries)).option("checkpointLocation", checkpoint or f"{folder}/checkpoint").trigger(availableNow=True)
    stream.start().awaitTermination()


def state(spark: SparkSession, folder: str) -> DataFrame:
    """All rows with their state: the results of the batches up to the ledger's number, and what the last one deferred."""
    number = int(spark.read.text(f"{folder}/LEDGER").first()[0])
    done = spark.read.parquet(f"{folder}/results").filter(F.col("batch") <= number).drop("batch")
    last = spark.read.parquet(f"{folder}/deferred").filter(F.col("batch") == number).drop("batch").withColumn("state", F.lit("deferred"))
    return done.unionByName(last.select(*done.columns))
