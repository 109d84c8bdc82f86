"""Streams with state that lapses, cut into batches and restarted, against plain Python."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from duecall.streaming import leases, ledger

T0 = datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    old = {k: spark.conf.get(k) for k in (leases.STORE[0], "spark.sql.shuffle.partitions")}
    spark.conf.set(*leases.STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def drained(spark, make, source, schema, out, checkpoint, **trigger):
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start(out).awaitTermination()


def test_leases_lapse_whatever_the_batches(rocks, tmp_path):
    rng = random.Random(5)
    events = sorted((T0 + timedelta(seconds=rng.randrange(40_000)), k, rng.randrange(6)) for k in range(200))
    source, out, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    schema = "ts timestamp, event_id long, user_id long"
    run = lambda: drained(rocks, lambda s: leases.lapses(s, "user_id", 1800), source, schema, out, check)
    for part in (events[:70], events[70:71], events[71:150]):
        rocks.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.02)
    run()
    rocks.createDataFrame(events[150:], schema).coalesce(1).write.mode("append").parquet(source)  # after a restart
    run()
    want = []
    for user in range(6):
        own = [t for t, _, u in events if u == user]
        for a, b in zip(own, [*own[1:], None], strict=True):
            end = a + timedelta(seconds=1800)
            if b > end if b else end <= events[-1][0]:
                want.append((user, end))
    got = sorted((r.user_id, r.lapsed_at) for r in rocks.read.parquet(out).collect())
    assert got == sorted(want) and len(want) > 10


def test_a_cache_forgets_by_the_clock(rocks, tmp_path):
    source, out, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    schema = "user_id long, event_id long"
    run = lambda: drained(rocks, lambda s: leases.cached(s, "user_id", 3), source, schema, out, check, once=True)
    rocks.createDataFrame([(1, 1), (1, 2), (2, 3)], schema).coalesce(1).write.parquet(source)
    run()
    time.sleep(4)
    rocks.createDataFrame([(1, 4), (2, 5), (2, 6)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    got = {r.event_id: (r.answered_by, r.fresh) for r in rocks.read.parquet(out).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (3, True), 4: (4, True), 5: (5, True), 6: (5, False)}


def test_a_replayed_batch_changes_nothing(rocks, tmp_path):
    spark = rocks
    folder, source = f"file://{tmp_path}/ledger", f"file://{tmp_path}/in"
    schema = "event_id long, ts timestamp, kind string"
    rows = [(k, T0 + timedelta(minutes=k), "bad" if k % 3 == 0 else "good") for k in range(30)]
    ok = lambda: F.col("kind") == "good"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    spark.createDataFrame(rows[:20] + rows[5:8], schema).coalesce(1).write.parquet(source)
    ledger.ingest(stream(), folder, ok, tries=50)
    spark.createDataFrame(rows[18:], schema).coalesce(1).write.mode("append").parquet(source)  # two ids again
    ledger.ingest(stream(), folder, ok, tries=50)
    found = lambda: sorted((r.event_id, r.state, r.attempt) for r in ledger.state(spark, folder).collect())
    first = found()
    assert [x[:2] for x in first] == [(k, "deferred" if k % 3 == 0 else "accepted") for k in range(30)]
    assert all(n > 1 for k, s, n in first if s == "deferred" and k < 18) and all(n == 1 for _, s, n in first if s == "accepted")
    number = int(spark.read.text(f"{folder}/LEDGER").first()[0])
    for again in (number, number):
        results = spark.read.parquet(f"{folder}/results/batch={again}")
        own = results.unionByName(spark.read.parquet(f"{folder}/deferred/batch={again}").withColumn("state", F.lit("")).select(*results.columns))
        batch = own.filter(F.col("first_batch") == again).select("event_id", "ts", "kind")
        ledger.batch(folder, ok, 50)(spark.createDataFrame(batch.collect(), schema), again)  # as if Spark hadn't noted it
        assert found() == first
    given = ledger.batch(f"{folder}-2", ok, 1)
    given(spark.createDataFrame(rows[:4], schema), 0)
    assert {r.state for r in ledger.state(spark, f"{folder}-2").collect()} == {"accepted", "given up"}
