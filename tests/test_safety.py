"""Inputs that could leak, crash, stall or silently change results."""

import json
import re
import time

import pytest
from pyspark.sql import functions as F

import maskwright as mw
from maskwright.functions.dialect import runs_on_jvm
from maskwright.operators import external, policy, redact
from maskwright.rules import Rule, default_rules
from maskwright.sources.patterns import read_patterns
from maskwright.streaming.watch import watch_table

# Truncated characters of two, three and four bytes, a lone continuation byte, and valid ones.
BROKEN = ["C3", "E2", "E282", "F0", "F09F", "F09F98", "80", "C3A9", "F09F9880"]


def broken(spark):
    rows = ", ".join(f"({i}, '{b}')" for i, b in enumerate(BROKEN))
    return spark.sql(f"""SELECT id, concat(repeat(concat(CAST(unhex(b) AS STRING), 'ab '), 20), 'password=hunter2secret 10.0.0.1 and a tail that stays',
        CAST(unhex(b) AS STRING)) AS text FROM VALUES {rows} t(id, b)""")


def shown(b):
    return bytes.fromhex(b).decode("utf-8", "replace").replace("�" * 3, "�").replace("�" * 2, "�")


def test_invalid_utf8_never_moves_the_mask(spark):
    df = broken(spark)
    want = [f"{(shown(b) + 'ab ') * 20}[REDACTED] [IP_ADDRESS] and a tail that stays{shown(b)}" for b in BROKEN]
    masked = mw.sanitize(df)
    assert [r.clean_text for r in masked.orderBy("id").collect()] == want
    assert {s.original for r in masked.collect() for s in r.spans} == {"password=hunter2secret", "10.0.0.1"}
    # the Python engine, the SQL function, the line review, and entities
    python = Rule("custom", "p", r"(?P<k>password)=\w+ [\d.]+", "[X]", 1.0, 10)
    assert all("[X] and a tail that stays" in r.clean_text for r in mw.sanitize(df, "text", [python]).collect())
    mw.register_sql(spark, name="mask_broken")
    df.createOrReplaceTempView("broken")
    assert [r.c for r in spark.sql("SELECT mask_broken(text) AS c FROM broken ORDER BY id").collect()] == want
    assert [r.after for r in redact.line_changes(masked, ["id"], "text").orderBy("id").collect()] == want
    found = external.dictionary_entities(df, "id", "text", spark.createDataFrame([("hunter2secret",)], "t STRING"), "PERSON")
    tied = mw.sanitize(external.attach_entities(df, "id", "text", found), "text", [Rule("custom", "none", "no such", "", 1.0, 10)], external="external")
    assert all("password=[PERSON] 10.0.0.1" in r.clean_text for r in tied.collect())


def test_invalid_utf8_can_fail_the_job(spark):
    with pytest.raises(Exception, match="INVALID_UTF8_STRING"):
        mw.sanitize(broken(spark), on_invalid="raise").select("clean_text").collect()
    with pytest.raises(ValueError, match="on_invalid"):
        mw.sanitize(broken(spark), on_invalid="ignore")


def test_output_names_must_be_free(spark):
    df = spark.createDataFrame([("pwd=1", 7)], "text STRING, Report INT")
    with pytest.raises(ValueError, match="report"):
        mw.sanitize(df)
    with pytest.raises(ValueError, match="clean_text"):
        watch_table(df.withColumnRenamed("Report", "clean_text").withColumn("s", F.lit(1)), "s", "s", "text")


@pytest.mark.parametrize("pattern,unit", [(r"(?:a|bc){9000}", "bc"), (r"(?:(?:a|b){1,150}x?){1,150}y", "ab")])
def test_nested_repeats_do_not_stop_the_session(spark, pattern, unit):
    assert not runs_on_jvm(pattern)
    texts = ["bc" * 9_500, "bc" * 20_000] if unit == "bc" else ["ab" * 4_500 + "y"]
    rows = mw.sanitize(spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING"), "text", [Rule("custom", "r", pattern, "[R]", 1.0, 10)]).orderBy("id").collect()
    assert [r.clean_text for r in rows] == [re.sub(pattern, "[R]", t) for t in texts]
    assert runs_on_jvm(r"(?:(?:ab){1,10}c){1,20}")


def test_pattern_folder_is_read_whole(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([{"pattern": "bbb"}]))
    (tmp_path / "a.json").write_text(json.dumps([{"pattern": "aaa"}, {"pattern": "ccc"}]))
    assert [r.pattern for r in read_patterns(spark, str(tmp_path))] == ["aaa", "ccc", "bbb"]
    assert [r.pattern for r in read_patterns(spark, str(tmp_path / "b*"))] == ["bbb"]
    with pytest.raises(FileNotFoundError):
        read_patterns(spark, str(tmp_path / "none"))
    assert read_patterns(spark, str(tmp_path / "none"), on_error="drop_all") == []
    with pytest.raises(Exception, match="UNSUPPORTED|No FileSystem|scheme"):  # a fault of storage is not a missing file
        read_patterns(spark, "nosuchscheme://x/y", on_error="drop_all")


def test_two_policies_for_a_source(spark):
    df = spark.createDataFrame([("a", "pwd=1 10.0.0.1"), (None, "pwd=2")], "source STRING, text STRING")
    twice = spark.createDataFrame([("a", "secrets", 0.0), ("a", "network", 0.0)], "source STRING, profile STRING, min_confidence DOUBLE")
    with pytest.raises(ValueError, match="more than one policy"):
        policy.sanitize_by_policy(df, "text", "source", twice)
    one = policy.sanitize_by_policy(df, "text", "source", twice.limit(1))
    assert sorted(r.clean_text for r in one.collect()) == ["[REDACTED]", "[REDACTED] 10.0.0.1"]


@pytest.mark.parametrize("width", [None, 1, 7, 1000])
def test_ties_and_nulls_in_change_detection(spark, width):
    rows = [("s", 1, "pwd=1"), ("s", 2, None), ("s", 3, "pwd=1"), ("s", 4, "[REDACTED]"), ("t", 1, None)]
    df = spark.createDataFrame(rows, "session STRING, seq BIGINT, text STRING")
    out = watch_table(df, "session", "seq", "text", bucket_width=width).orderBy("session", "seq").collect()
    assert [(r.session, r.seq, r.text) for r in out] == rows
    assert [r.masked for r in out] == [True, False, True, False, False]
    with pytest.raises(Exception, match="two events of one session"):
        watch_table(df.union(df.limit(1)), "session", "seq", "text", bucket_width=width).collect()


@pytest.mark.parametrize("unit,tail", [("a.", ""), ("a.", " x@y.org"), ("._", "a@y.org"), ("a.", "@"), ("a@", ""), ("-----BEGIN RSA PRIVATE KEY----- ", ""), ("é.", "b@y.org")])
def test_worst_texts_take_linear_time(spark, unit, tail):
    rules = [r for r in default_rules() if r.label in ("email_address", "private_key")]
    seconds = []
    for n in (50_000, 400_000):
        text = unit * (n // len(unit)) + tail
        df = spark.createDataFrame([(text,)], "text STRING")
        start = time.time()
        got = mw.sanitize(df, "text", rules).first()
        seconds.append(time.time() - start)
        if n == 50_000 and unit != "a.":
            assert got.clean_text == re.sub(rules[1].pattern, "[EMAIL]", text) if "@" in tail and len(tail) > 1 else True
    assert seconds[1] < 16 * max(seconds[0], 0.5)
