"""Keyed hashes against the standard's module, digests of logs, strict addresses against ipaddress."""

import hashlib
import hmac
import random
import re

import pytest
from pyspark.sql import functions as F

import maskwright as mw
import model
from maskwright.functions.keyed import hmac_sha256
from maskwright.operators.policy import audit_buckets, audit_log, audit_roots
from maskwright.rules import rules_for_profile, strict_ipv6


def test_hmac_is_the_standard_one(spark):
    values = ["", "what do ya want for nothing?", "é😀", "x" * 500]
    df = spark.createDataFrame([(v,) for v in values], "v STRING")
    for key in (b"Jefe", b"\x0b" * 20, b"\xaa" * 131, b"k" * 64):
        got = {r.v: r.h for r in df.select("v", hmac_sha256(F.col("v"), key).alias("h")).collect()}
        assert got == {v: hmac.new(key, v.encode(), hashlib.sha256).hexdigest() for v in values}
    with pytest.raises(ValueError, match="empty key"):
        hmac_sha256(F.col("v"), b"")


def test_a_changed_log_is_found(spark):
    texts = [(i % 3, f"10.0.{i % 250}.{i // 250} and password=secret{i}") for i in range(600)]
    spans = mw.with_spans(spark.createDataFrame(texts, "batch INT, text STRING"), "text")
    log = audit_log(spans, ["batch"], key=b"k")
    rows = log.collect()
    log = spark.createDataFrame(rows, log.schema)
    assert "original" not in log.columns and len(rows) == 1200
    whole, roots = audit_buckets(log, ["batch"]), lambda d: {r.batch: (r.n, r.root) for r in audit_roots(audit_buckets(d, ["batch"]), ["batch"]).collect()}
    before = roots(log)
    assert before == roots(log.repartition(7)) and {n for n, _ in before.values()} == {400}
    gone = spark.createDataFrame(rows[1:], log.schema)
    after = roots(gone)
    assert [b for b in before if before[b] != after[b]] == [rows[0].batch]
    changed = whole.exceptAll(audit_buckets(gone, ["batch"])).collect()
    assert len(changed) == 1 and changed[0].batch == rows[0].batch
    twice = spark.createDataFrame(rows + rows[:1], log.schema)
    assert roots(twice)[rows[0].batch] != before[rows[0].batch]


def test_strict_addresses_are_those_of_ipaddress(spark):
    rng = random.Random(5)
    tokens = ["::", "1::", "::1", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "14:32:01", ":1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:", "::1.2.3.4", "::01.2.3.4", "1::1.2.3.256",
              "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", ":::", "1:::2", "12345::", "g::1", "1:2:3:4:5:6:7:8:9"]
    for _ in range(3000):
        n = rng.choice([3, 7, 8, 9])
        groups = [rng.choice(["", "0", "a", "FFfe", "12", "db8", "00001"] if rng.random() < 0.4 else ["1", "ab", "9"]) for _ in range(n)]
        tokens.append(":".join(groups) + (f":{rng.randrange(300)}.0.0.1" if rng.random() < 0.15 else ""))
    tokens = [t for t in tokens if t.count(":") > 1]
    rule = [r for r in strict_ipv6(rules_for_profile("network")) if r.label == "ipv6_address"]
    assert rule[0].resolved_engine() == "jvm"
    df = spark.createDataFrame([(i, f"x {t} y,{t}") for i, t in enumerate(tokens)], "id INT, text STRING").repartition(4)
    got = {r.id: [s.original for s in r.spans] for r in mw.with_spans(df, "text", rule).collect()}
    wrong = [(t, got[i]) for i, t in enumerate(tokens) if got[i] != ([t, t] if model.CHECKS["ipv6"](t) else [])]
    assert not wrong
    assert sum(map(bool, got.values())) > 100 and re.compile(rule[0].pattern)
