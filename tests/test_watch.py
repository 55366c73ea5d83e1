"""Change detection: table form, bucketed table form and stream against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

import model
from maskwright import default_rules
from maskwright.rules import Rule
from maskwright.streaming.watch import on_demand, start_watch, watch_stream, watch_table, watched

# Not idempotent: masking A gives B, masking B gives C.
CHAIN = [Rule("custom", "a", "A", "B", 0.9, 10), Rule("custom", "b", "B", "C", 0.8, 10)]


def loop(events, rules):
    last, out = "", []
    for text in events:
        text = text or ""
        clean = model.sanitize(text, rules)[0]
        if text and text != last:
            out.append((clean, True, clean != text))
            last = clean
        else:
            out.append((clean, False, False))
            last = text
    return out


def sessions(words, n, seed):
    rnd = random.Random(seed)
    return {f"s{k}": [rnd.choice(words) for _ in range(rnd.randint(1, 60))] for k in range(n)}


def frame(spark, data):
    rows = [(s, i * 3, t) for s, texts in data.items() for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "session STRING, seq BIGINT, text STRING").repartition(4)


@pytest.mark.parametrize("width", [None, 10, 1000])
@pytest.mark.parametrize("rules,words", [
    (CHAIN, ["A", "B", "C", "", None, "AB"]),
    (default_rules(pii=False), ["password=secret123", "[REDACTED]", "password=1.2.3.4", "password=[IP_ADDRESS]", "hi", ""]),
])
def test_table_equals_loop(spark, width, rules, words):
    data = sessions(words, 12, 5)
    got = {}
    for r in watch_table(frame(spark, data), "session", "seq", "text", rules, width).orderBy("session", "seq").collect():
        got.setdefault(r.session, []).append((r.clean_text, r.processed, r.masked))
    assert got == {s: loop(texts, rules) for s, texts in data.items()}


def test_own_output_is_not_processed_again(spark):
    df = frame(spark, {"s": ["password=secret123", "[REDACTED]", "password=secret123", "", "password=secret123"]})
    out = watch_table(df, "session", "seq", "text").orderBy("seq").collect()
    assert [r.processed for r in out] == [True, False, True, False, True]
    assert [r.masked for r in out] == [True, False, True, False, True]


def test_stream_equals_table(spark, tmp_path):
    data = sessions(["A", "B", "C", "", "AB"], 6, 9)
    df = frame(spark, data)
    for part in range(3):  # three micro-batches, each later than the one before
        df.where((F.col("seq") >= part * 60) & (F.col("seq") < (part + 1) * 60)).coalesce(1).write.json(
            str(tmp_path / "in" / str(part)))
    stream = (spark.readStream.schema("session STRING, seq BIGINT, text STRING").option("maxFilesPerTrigger", 1)
              .json(str(tmp_path / "in" / "*")))
    query = start_watch(watch_stream(stream, "session", "seq", "text", CHAIN), str(tmp_path / "out"),
                        str(tmp_path / "cp"), available_now=True)
    query.awaitTermination(120)
    got = sorted((r.session, r.seq, r.clean_text) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted((r.session, r.seq, r.clean_text)
                  for r in watch_table(df, "session", "seq", "text", CHAIN).where("masked").collect())
    assert got == want


def test_watch_mode_gate_and_on_demand(spark):
    df = frame(spark, {"on": ["pwd=x1"], "off": ["pwd=x2"], "none": [""]})
    settings = spark.createDataFrame([("on", True), ("off", False)], "session STRING, watch_mode BOOLEAN")
    assert [r.session for r in watched(df, settings, "session").collect()] == ["on"]
    assert sorted((r.session, r.clean_text) for r in on_demand(df, "text").collect()) == [
        ("off", "[REDACTED]"), ("on", "[REDACTED]")]
