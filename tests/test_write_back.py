"""Failing writes, and windows with late and repeated events."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import maskwright as mw
from maskwright.streaming import write_back

SCHEMA = "k STRING, seq LONG, text STRING"


def feed(spark, folder, n, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{n}")


def stream(spark, folder):
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
    return mw.sanitize(raw, "text").select("k", "seq", "clean_text")


@pytest.mark.parametrize("fails", ["before the data", "halfway", "before the checkpoint"])
def test_a_failed_write_is_neither_lost_nor_repeated(spark, tmp_path, monkeypatch, fails):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    feed(spark, source, 0, [("a", 1, "password=hunter2secret"), ("b", 1, "x")])
    feed(spark, source, 1, [("a", 2, "10.0.0.1")])
    write_back.start_write_back(stream(spark, source), out, checkpoint, True).awaitTermination()
    feed(spark, source, 2, [("a", 3, "later 10.0.0.2"), ("c", 1, "pwd=1")])
    real, calls = write_back._write_batch, []

    def broken(batch, path, number):
        calls.append(number)
        if fails == "halfway":
            batch.limit(1).write.mode("overwrite").parquet(f"{path}/data/batch={number}")
        elif fails == "before the checkpoint":
            real(batch, path, number)
        raise OSError("disk is gone")

    monkeypatch.setattr(write_back, "_write_batch", broken)
    with pytest.raises(Exception, match="disk is gone"):
        write_back.start_write_back(stream(spark, source), out, checkpoint, True).awaitTermination()
    assert len(calls) == 1
    if fails == "halfway":  # nobody sees what the failed batch left
        assert write_back.written(spark, out).count() == 3
    monkeypatch.setattr(write_back, "_write_batch", real)
    write_back.start_write_back(stream(spark, source), out, checkpoint, True).awaitTermination()
    rows = sorted((r.k, r.seq, r.clean_text) for r in write_back.written(spark, out).collect())
    assert rows == [("a", 1, "[REDACTED]"), ("a", 2, "[IP_ADDRESS]"), ("a", 3, "later [IP_ADDRESS]"), ("b", 1, "x"), ("c", 1, "[REDACTED]")]
    last = sorted((r.k, r.clean_text) for r in write_back.current_texts(spark, out, ["k"], "seq").collect())
    assert last == [("a", "later [IP_ADDRESS]"), ("b", "x"), ("c", "[REDACTED]")]


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_windows_of_a_stream_with_late_and_repeated_events(spark, tmp_path):
    schema = "ts TIMESTAMP, text STRING"
    batches = [[(at(1, 1), "10.0.0.1"), (at(1, 2), "10.0.0.1 pwd=1"), (at(1, 2), "10.0.0.1 pwd=1"), (None, "10.0.0.9")], [(at(2, 5), "10.0.0.2"), (at(1, 23), "pwd=1")],
               [(at(5), "10.0.0.3")], [(at(5, 2), "z")], [(at(1, 3), "10.0.0.4"), (at(5, 1), "pwd=2")], [(at(9), "x")], [(at(9, 1), "y")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    counted = write_back.masked_by_window(raw, "ts", "text", delay="1 day")
    query = counted.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(tuple(r) for r in spark.table("windows").select("window_start", "label", "n").collect())
    in_time = [r for i, rows in enumerate(batches) for r in rows if (i, r[0]) != (4, at(1, 3))]
    whole = write_back.masked_by_window(spark.createDataFrame(in_time, schema), "ts", "text")
    want = sorted(tuple(r) for r in whole.where(F.col("window_end") <= at(8)).select("window_start", "label", "n").collect())
    assert got == want and (at(1), "ipv4_address", 3) in got
    assert write_back.late_rows(query) == 1


def test_session_windows(spark):
    df = spark.createDataFrame([("u", at(1, 1), "10.0.0.1"), ("u", at(1, 2), "10.0.0.2"), ("u", at(1, 9), "10.0.0.3"), ("v", at(1, 2), "x")], "u STRING, ts TIMESTAMP, text STRING")
    rows = write_back.masked_by_window(df, "ts", "text", gap="3 hours", by=["u"]).orderBy("window_start").collect()
    assert [(r.u, r.window_start, r.n) for r in rows] == [("u", at(1, 1), 2), ("u", at(1, 9), 1)]
