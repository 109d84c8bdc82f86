"""JSON stores read by their files' times: what hasn't changed isn't read again, what is broken keeps its last good rows.

A store is a JSON envelope {updatedAt, source, items[]} in a file of a folder. The files are listed with their modification times
and without their content; those that the cache has with the same time aren't opened. Each file that is read either parses or gives a
corrupt record; then its last good rows stand in and the file is tried again next time. A file that is gone takes its rows along.
The cache is a snapshot: a new version is written beside the old one and the pointer is moved.

An empty folder gives no rows. A file without items has none, which isn't an error. Files are told by path.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duecall.sources.sinks import _fs, moved
from duecall.sources.staging import written
from duecall.sources.tables import CALL

STATES = "path string, modified timestamp, state string, good timestamp"


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified) of the stores; their content isn't read."""
    p, fs = _fs(spark, folder)
    if not fs.exists(p):
        return spark.createDataFrame([], "path string, modified timestamp")
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path", F.col("modificationTime").alias("modified"))


def refreshed(spark: SparkSession, folder: str, cache: str, item: T.StructType = CALL) -> tuple[DataFrame, DataFrame]:
    """(rows of all stores with their path, (path, modified, state, good) of each store), kept in cache for the next time.

    state is "read" where the file was read anew, "same" where it wasn't opened, and "broken" where it was and
    doesn't parse; good is the time of the file whose rows stand there, null where there are none.
    """
    rows_schema = T.StructType([*item.fields, T.StructField("path", T.StringType())])
    pointer, fs = _fs(spark, f"{cache}/CURRENT")
    if fs.exists(pointer):
        old = spark.read.text(f"{cache}/CURRENT").first()[0]
        known, kept = spark.read.schema(STATES).parquet(f"{cache}/{old}/files"), spark.read.schema(rows_schema).parquet(f"{cache}/{old}/rows")
    else:
        known, kept = spark.createDataFrame([], STATES), spark.createDataFrame([], rows_schema)
    had = known.select("path", F.col("modified").alias("_modified"), F.col("state").alias("_state"), F.col("good").alias("_good"))
    files = written(listed(spark, folder).join(had, "path", "left"), "files")
    same = (F.col("modified") == F.col("_modified")) & (F.col("_state") != "broken")
    stale = [r[0] for r in files.filter(~F.coalesce(same, F.lit(False))).select("path").collect()]  # paths of stores, a few dozen, not rows
    envelope = T.StructType([T.StructField("updatedAt", T.StringType()), T.StructField("source", T.StringType()), T.StructField("items", T.ArrayType(item)), T.StructField("_broken", T.StringType())])
    if stale:
        reader = spark.read.schema(envelope).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken")
        fresh = written(reader.json(stale).select("items", F.col("_broken").isNotNull().alias("broken"), F.col("_metadata.file_path").alias("path")), "fresh")
    else:
        fresh = spark.createDataFrame([], T.StructType([T.StructField("items", T.ArrayType(item)), T.StructField("broken", T.BooleanType()), T.StructField("path", T.StringType())]))
    parsed = fresh.groupBy(F.col("path").alias("_path")).agg(F.max("broken").alias("broken"))
    here = F.regexp_replace("path", "^file:/+", "file:///") == F.regexp_replace("_path", "^file:/+", "file:///")
    states = files.join(parsed, here, "left").select(
        "path", "modified",
        F.when(F.col("broken"), "broken").when(F.col("broken").isNotNull(), "read").otherwise(F.when(same, "same").otherwise("read")).alias("state"),
        F.when(F.coalesce("broken", F.lit(False)), F.col("_good")).otherwise(F.col("modified")).alias("good"),
    )
    states = written(states, "states")
    good = fresh.filter(~F.col("broken")).select(F.inline("items"), F.regexp_replace("path", "^file:/+", "file:///").alias("path")).join(states.select(F.regexp_replace("path", "^file:/+", "file:///").alias("_path"), F.col("path").alias("_own")), F.col("path") == F.col("_path")).drop("path", "_path").withColumnRenamed("_own", "path")
    stand = kept.join(states.filter("state <> 'read'").select("path"), "path", "left_semi").select(*rows_schema.names)
    version = uuid.uuid4().hex[:12]
    good.select(*rows_schema.names).unionByName(stand).write.parquet(f"{cache}/{version}/rows")
    states.write.parquet(f"{cache}/{version}/files")
    moved(spark, f"{cache}/CURRENT", version)
    return spark.read.schema(rows_schema).parquet(f"{cache}/{version}/rows"), spark.read.schema(STATES).parquet(f"{cache}/{version}/files")
