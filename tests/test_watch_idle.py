"""Watching with state that ends."""

import random
import time

import pytest
from pyspark.sql import functions as F

from maskwright.streaming import watch

SCHEMA = "session STRING, seq LONG, text STRING"
TEXTS = ["", "x", "password=hunter2", "[REDACTED]", "10.0.0.1", "[IP_ADDRESS]", None]


@pytest.fixture()
def rocksdb(spark):
    before = spark.conf.get(watch._STORE)
    spark.conf.set(watch._STORE, watch.ROCKSDB)
    yield
    spark.conf.set(watch._STORE, before)


def feed(spark, folder, n, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{n}")


def run(spark, tmp_path, **more):
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = watch.start_watch(watch.watch_stream_idle(raw, "session", "seq", "text", **more), f"{tmp_path}/out", f"{tmp_path}/cp", available_now=True)
    query.awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    return query, sorted((r.session, r.seq, r.text, r.clean_text) for r in rows)


def test_equals_the_batch_form_from_a_given_state(spark, tmp_path, rocksdb):
    rng = random.Random(2)
    events = [(rng.choice("ab"), i, rng.choice(TEXTS)) for i in range(60)]
    whole = watch.watch_table(spark.createDataFrame(events, SCHEMA), "session", "seq", "text").collect()
    want = sorted((r.session, r.seq, r.text, r.clean_text) for r in whole if r.masked and r.seq >= 20)
    held = {}
    for r in sorted(whole, key=lambda r: r.seq):
        if r.seq < 20:
            held[r.session] = r.clean_text if r.processed else r.text
    initial = spark.createDataFrame(list(held.items()), "session STRING, last STRING")
    for n, part in enumerate((events[20:35], events[35:])):
        feed(spark, f"{tmp_path}/in", n, part)
    assert run(spark, tmp_path, initial=initial)[1] == want


def test_idle_sessions_leave_the_state(spark, tmp_path, rocksdb):
    """The polled form: a stream with state that ends always has a next batch, so it is stopped, not awaited."""
    feed(spark, f"{tmp_path}/in", 0, [("a", 1, "10.0.0.1"), ("b", 1, "10.0.0.1")])
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = watch.start_watch(watch.watch_stream_idle(raw, "session", "seq", "text", idle_ms=3_000), f"{tmp_path}/out", f"{tmp_path}/cp")

    def wait(n, held):
        end = time.time() + 90
        while time.time() < end and query.isActive:
            seen = [p for p in query.recentProgress if p.numInputRows or p.stateOperators]
            if sum(p.numInputRows for p in seen) >= n and seen[-1].stateOperators[0].numRowsTotal <= held:
                return
            time.sleep(0.3)
        raise AssertionError(f"{query.exception()} {query.lastProgress}")
    try:
        wait(2, 99)
        time.sleep(5)
        feed(spark, f"{tmp_path}/in", 1, [("a", 2, "[IP_ADDRESS]"), ("a", 3, "10.0.0.1"), ("c", 1, "x")])
        wait(5, 99)
        time.sleep(5)
        feed(spark, f"{tmp_path}/in", 2, [("d", 1, "y")])
        wait(6, 4)  # with the index of its time to live, only d is held
    finally:
        query.stop()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    # [IP_ADDRESS] came after the state was gone, is clean, and is then what the session holds
    assert sorted((r.session, r.seq) for r in rows) == [("a", 1), ("a", 3), ("b", 1)]


def test_the_store_must_be_on_disk(spark):
    df = spark.createDataFrame([("a", 1, "x")], SCHEMA)
    with pytest.raises(ValueError, match="stateStore"):
        watch.watch_stream_idle(df, "session", "seq", "text")
