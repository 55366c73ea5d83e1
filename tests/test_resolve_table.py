"""Resolution over a findings table against the row form and the model."""

import random
import time

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import model
from maskwright.functions.expr import computed_once
from maskwright.operators.resolve_table import _Kept, resolve_findings, with_blocks

SCHEMA = "doc STRING, start INT, end INT, confidence DOUBLE, label STRING, rank INT"


def survivors(rows):
    """By the model: (start, end, text, replacement, category, label, confidence) in rank order."""
    by_doc = {}
    for doc, s, e, c, label, rank in sorted(rows, key=lambda r: r[5]):
        by_doc.setdefault(doc, []).append((s, e, "", "", "", label, c))
    return sorted((str(doc), s[0], s[1], s[5]) for doc, found in by_doc.items() for s in model.resolve(found))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 5)), max_size=25))
def test_kept_spans(spans):
    """Taken in the order given: what is left never overlaps, what goes does."""
    kept, taken = _Kept(), []
    for s, n in spans:
        clash = any(s < b and a < s + n for a, b in taken)
        assert kept.take(s, s + n) != clash
        if not clash:
            taken.append((s, s + n))


@pytest.mark.parametrize("width", [1, 7, 100_000])
def test_equals_the_model(spark, width):
    rng = random.Random(width)
    rows = []
    for i in range(1500):
        s = rng.randrange(400) if i % 3 else 1000 + 10 * (i % 200)  # many with the same place
        rows.append((rng.choice(["a", "b", None, ""]), s, s + rng.choice([0, 1, 2, 3, 8, 60]), rng.choice([1.0, 0.9, 0.5]), f"l{i}", i))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((str(r.doc), r.start, r.end, r.label) for r in resolve_findings(df, ["doc"], "rank", width).collect())
    assert got == survivors(rows)


def test_blocks_never_overlap_and_split_a_hot_text(spark):
    df = spark.range(200_000).selectExpr("1 AS doc", "int(id * 10) AS start", "int(id * 10 + id % 13) AS end", "0.5D AS confidence", "string(id) AS label", "int(id) AS rank")
    blocks = with_blocks(df, ["doc"], 10_000).groupBy("doc", "block").agg(F.count("*").alias("n"), F.min("start").alias("lo"), F.max("end").alias("hi"))
    rows = blocks.orderBy("block").collect()
    assert len(rows) > 100_000 and max(r.n for r in rows) < 10
    assert all(a.hi <= b.lo for a, b in zip(rows, rows[1:]))


def test_one_span_over_all_others(spark):
    df = spark.range(100_000).selectExpr("1 AS doc", "int(id * 3) AS start", "int(id * 3 + 2) AS end", "0.9D AS confidence", "string(id) AS label", "int(id) AS rank")
    wide = spark.createDataFrame([(1, 0, 300_000, 0.5, "wide", -1)], df.schema)
    start = time.time()
    assert resolve_findings(df.union(wide), ["doc"], "rank").count() == 100_000
    sure = wide.withColumn("confidence", F.lit(1.0))
    assert [r.label for r in resolve_findings(df.union(sure), ["doc"], "rank", 1_000).collect()] == ["wide"]
    assert time.time() - start < 60


def test_findings_that_are_none(spark):
    rows = [("a", 5, 3, 1.0, "x", 1), ("a", None, 3, 1.0, "x", 2), ("a", 1, None, 1.0, "x", 3), ("a", 1, 3, None, "x", 4), ("a", 1, 3, 0.1, "kept", 5),
            ("a", 3, 3, 0.1, "empty", 6), ("a", 3, 4, 0.1, "touches", 7)]
    got = resolve_findings(spark.createDataFrame(rows, SCHEMA), ["doc"], "rank")
    assert got.columns == ["doc", "start", "end", "confidence", "label", "rank"]
    assert sorted(r.label for r in got.collect()) == ["empty", "kept", "touches"]
    assert resolve_findings(spark.createDataFrame([], SCHEMA), ["doc"]).count() == 0
    with pytest.raises(ValueError, match="block"):
        resolve_findings(spark.createDataFrame(rows, SCHEMA).withColumn("BLOCK", F.lit(1)), ["doc"])


def test_findings_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(x):
        made.add(1)
        return x

    df = computed_once(spark.range(300), "start", counted((F.col("id") * 5).cast("int"))).select(
        (F.col("id") % 7).alias("doc"), "start", F.lit(0.5).alias("confidence"), F.col("id").alias("rank"))
    found = df.withColumn("end", F.col("start") + 3)
    assert resolve_findings(found, ["doc"], "rank", 1000).count() == 300 and made.value == 300
