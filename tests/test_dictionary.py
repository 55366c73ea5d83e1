"""Large dictionaries: what is moved, and that the filter changes nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.functions import bloom
from maskwright.functions.phrases import CHUNK
from maskwright.operators.external import attach_entities, dictionary_entities


def test_filters_hold_what_was_put_in(spark):
    for log2_bits in (10, 16, 27):
        hashes = spark.range(2_000).select(F.xxhash64("id").alias("h"))
        table = bloom.build(hashes, log2_bits)
        inside = np.array([r.h for r in hashes.collect()])
        outside = np.array([r.h for r in spark.range(10_000, 30_000).select(F.xxhash64("id").alias("h")).collect()])
        assert bloom.found(table, inside, log2_bits).all()
        if log2_bits == 27:
            assert bloom.found(table, outside, log2_bits).mean() < 0.001
    assert not bloom.found(bloom.build(spark.range(0).select(F.xxhash64("id").alias("h"))), outside).any()


@pytest.mark.parametrize("longest", [False, True])
def test_the_filter_changes_nothing(spark, longest):
    texts = ["Ann Lee met ann lee smith.", "", None, "ANN", "lee, Lee; é-Zoë", "no name here", "Ann  Lee"]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING")
    terms = spark.createDataFrame([("Ann Lee",), ("ann lee smith",), ("LEE",), ("Zoë",), ("zoë",), ("",), (None,), ("--",)], "t STRING")

    def found(few):
        rows = dictionary_entities(df, "id", "text", terms, "PERSON", few=few, longest_only=longest)
        return sorted((r.id, r.start, r.end, r.entity_type, r.score) for r in rows.collect())
    assert found(0) == found(100)
    spans = {(i, texts[i][s:e].lower()) for i, s, e, *_ in found(0)}
    assert spans >= {(0, "ann lee smith"), (0, "lee"), (4, "lee"), (4, "zoë")} and ((0, "ann lee") in spans)
    assert len(found(0)) == (8 if longest else 9)


def test_a_million_names_move_few_rows(spark):
    terms = spark.range(1_000_000).selectExpr("concat('name', id, ' of', id % 1000) AS t")
    words = 20_000 * 12
    df = spark.range(20_000).selectExpr("id", "concat('some words go here name', id * 100, ' of', (id * 100) % 1000, ' and name', id, ' offering no', id) AS text")
    out = dictionary_entities(df, "id", "text", terms, "PERSON")
    hits = out.count()
    assert hits == 10_000  # ids below a million, divided by a hundred
    table = bloom.build(terms.select(F.xxhash64(F.lower("t")).alias("h")))
    phrases = df.selectExpr("id", "regexp_extract_all(text, '[a-z0-9]+', 0) AS w").selectExpr("inline(transform(w, (x, i) -> struct(concat_ws(' ', x, get(w, i + 1)) AS p)))")
    h = np.array([r.h for r in phrases.select(F.xxhash64("p").alias("h")).collect()])
    assert len(h) > 0.8 * words and bloom.found(table, h).sum() - hits < 0.02 * words


@pytest.mark.parametrize("longest", [False, True])
def test_the_size_of_the_list_changes_nothing(spark, longest):
    """Lists held by tasks against the join: words over ends of texts, equal rows and ids, other letters, long texts."""
    texts = ["Ann Lee met ann lee smith.", "Ann", "Lee", "", None, "ANN LEE", "lee, Lee; é-Zoë", "ann\u00a0lee Ann Lee", "Ann_Lee ann-lee", "x" * CHUNK + " ann lee",
             "ann lee " * (CHUNK // 4), "ann lee" * 3, "Ann Lee", "ΑΣ ας ann lee", "_ann lee_ ann  lee", "Ann Lee smit"]
    rows = [(i % 13, t) for i, t in enumerate(texts)] + [(None, "ann lee"), (1, "Ann")]
    df = spark.createDataFrame(rows, "id INT, text STRING").repartition(2)
    terms = spark.createDataFrame([("Ann Lee",), ("ann lee",), ("ann lee smith",), ("LEE",), ("Zoë",), ("ann-lee",), ("ΑΣ",), ("",), (None,), ("--",)], "t STRING")

    def found(**how):
        return sorted((str(r.id), r.start, r.end, r.entity_type, r.score) for r in dictionary_entities(df, "id", "text", terms, "PERSON", longest_only=longest, **how).collect())
    in_tasks = found()
    assert len(in_tasks) > CHUNK // 4 and in_tasks == found(held=0) == found(held=0, few=0)
    assert dictionary_entities(df, "id", "text", terms.limit(0), "PERSON").count() == 0
    plan = dictionary_entities(df, "id", "text", terms, "PERSON")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange hashpartitioning" not in plan


def test_phrases_with_one_hash_are_told_apart(spark):
    from maskwright.functions.phrases import Hasher, Phrases, found_lists
    import pyarrow as pa

    class Shared:
        value = Phrases.of(pa.array(["ann lee", "bob", "zoë"]), [1, 2])
    Shared.value.hashes[:] = Shared.value.hashes[0]  # every hit has to be compared
    Shared.value.seen[:] = 255
    none = pa.array([[], []], pa.list_(pa.struct([("start", pa.int32()), ("len", pa.int32()), ("phrase", pa.string())])))
    got = found_lists(Shared, pa.array(["Ann Lee or ann bob", "Bob"]), none, Hasher()).to_pylist()
    assert all(t[x["start"]:x["start"] + x["len"]].lower() in ("ann lee", "bob", "zoë") for t, f in zip(["Ann Lee or ann bob", "Bob"], got) for x in f)
    assert Phrases.of(pa.array(["a", "a"]), [1]) is None


def test_entities_of_equal_keys(spark):
    """Entities go to every text with their key, null keys get none, and equal findings are masked once."""
    import maskwright as mw
    df = spark.createDataFrame([(1, "ann at a@b.org"), (1, "ann at a@b.org"), (2, "bob"), (None, "ann")], "id INT, text STRING")
    terms = spark.createDataFrame([("ann",), ("bob",)], "t STRING")
    out = mw.sanitize(attach_entities(df, "id", "text", dictionary_entities(df, "id", "text", terms, "PERSON")), external="external")
    assert sorted((str(r.id), r.clean_text, len(r.external)) for r in out.collect()) == [
        ("1", "[PERSON] at [EMAIL]", 2), ("1", "[PERSON] at [EMAIL]", 2), ("2", "[PERSON]", 1), ("None", "ann", 0)]
