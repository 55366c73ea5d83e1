"""Rule tables against a loop over their rules; literals; the length of an address."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import maskwright as mw
import model
from maskwright.functions.literals import folded, required_literals
from maskwright.rules import Rule, default_rules


@pytest.mark.parametrize("pattern, want", [
    (r"ticket-\d{6}", ["ticket-"]), (r"(?i)ABC[0-9]", ["abc"]), (r"(?:foo|barbar)\d", ["barbar", "foo"]), (r"x?yes", ["yes"]), (r"(?:abc)?d", None),
    (r"\d+", None), (r"a|bcd", None), (r"(abcd){2,}x", ["abcd"]), (r"ab.cdefg", ["cdefg"]), (r"(?=secret)\w+", None), (r"é{3}abc", ["abc"]), (r"", None),
])
def test_required_literals(pattern, want):
    assert required_literals(pattern) == want


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_every_match_holds_a_literal(data):
    parts = st.sampled_from(["abc", "ABC", "[a-c]", r"\d", "(?:abc|bcd)", "(?:ab|c)", "(abcd)+", "x{0,2}", "x{2,3}", ".", r"\b", "k", "s"])
    pattern = data.draw(st.sampled_from(["", "(?i)"])) + "".join(data.draw(st.lists(parts, min_size=1, max_size=5)))
    text = data.draw(st.text(alphabet="abcdABCDxX1 .ksſKİı", max_size=40))
    literals = required_literals(pattern)
    for m in re.finditer(pattern, text):
        assert literals is None or any(x in folded(text) for x in literals), (pattern, text, m)


def some_rules(n, rng):
    out = []
    for i in range(n):
        key = f"{rng.choice(['ref', 'Case', 'job_', 'x-'])}{i:04d}"
        out.append(Rule("custom", f"l{i % 7}", rng.choice([key, rf"(?i){key}\b", rf"{key}(?:a|bb)?", rf"(?P<n>{key})\d", rf"\b{key}|never{i}", rf"{key}\s*=\s*\w+"]),
                        f"[{i}]$1", rng.choice([1.0, 0.75, 0.5]), 10))
    return out + [Rule("custom", "open", r"\d{7}", "[D]", 0.6, 10), Rule("custom", "empty", r"(?m)^", "[^]", 0.4, 10), Rule("custom", "word", r"\bzz+\b", "[Z]", 1.0, 10)]


@pytest.mark.parametrize("slice_rules", [50_000, 700])
def test_five_thousand_rules_equal_the_loop(spark, slice_rules):
    rng = random.Random(1)
    rules = some_rules(5_000, rng)
    words = [f"{p}{rng.randrange(5_400):04d}{t}" for p in ("ref", "REF", "Case", "job_", "x-") for t in ("", "a", "bb", "7", " = v", "=10.0.0.1") for _ in range(40)]
    texts = [" ".join(rng.choices([*words, "1234567", "zz", "password=ref0001"], k=rng.randrange(12))) for _ in range(150)] + ["", None, "none of them"]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING").repartition(4)
    table = mw.RuleTable.of(spark, rules, slice_rules=slice_rules)
    assert len(table) == len(rules)
    for listed, floor in (([], 0.0), (default_rules(), 0.7)):
        got = {r.id: (r.clean_text, [s.label for s in r.spans]) for r in mw.sanitize(df, "text", [*listed, table], floor).collect()}
        compiled = [(re.compile(r.pattern), r) for r in sorted([*listed, *rules], key=lambda r: r.priority) if r.confidence >= floor]
        for i, text in enumerate(texts):
            if text is None:
                assert got[i] == (None, [])
                continue
            found = [(m.start(), m.end(), m.group(), r.replacement, r.category, r.label, r.confidence)
                     for rx, r in compiled for m in rx.finditer(text) if model.CHECKS[r.check](m.group())]
            spans = model.resolve(found)
            assert got[i] == (model.splice(text, spans), [s[5] for s in spans])


def test_a_large_table_is_joined(spark):
    """Rules stay on the cluster: none in the plan or in a slice, but those that need no literal; the result is that of slices."""
    rules = some_rules(300, random.Random(3)) + [Rule("custom", "long", "a" * 70 + r"\d", "[L]", 1.0, 10), Rule("custom", "two", "abcde|fghij", "[2]", 1.0, 10)]
    table, whole = mw.RuleTable.of(spark, rules, slice_rules=100), mw.RuleTable.of(spark, rules)
    assert len(table) == len(whole) == len(rules) and sum(map(len, table.slices)) == 3 and table.sliced().slices[0][:5] == whole.slices[0][:5]
    texts = ["é" + "a" * 75 + "1", "abcde and fghij", "ſ REF0001 Ref0002 job_0003 = x\u00e4", "x" * 300_000 + " ref0007 CASE0009", "ref0001" * 3, "", None, "1234567"] * 2
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id INT, text STRING").repartition(3)
    one, other = (sorted((r.id, r.clean_text, [s.label for s in r.spans]) for r in mw.sanitize(df, "text", [*default_rules(), t], 0.5).collect())
                  for t in (table, whole))
    assert one == other and one[1][1] == "[2] and [2]" and one[0][1].endswith("[L]")
    with pytest.raises(ValueError, match="rule_ord"):
        mw.RuleTable.of(spark, spark.createDataFrame([(1, "aaa"), (1, "bbb")], "rule_ord LONG, pattern STRING"), slice_rules=1)
    bad = spark.createDataFrame([(1, "aaa"), (2, "(")], "rule_ord LONG, pattern STRING")
    assert len(mw.RuleTable.of(spark, bad, on_error="drop_all", slice_rules=1)) == 0
    with pytest.raises(Exception, match="unterminated"):
        mw.RuleTable.of(spark, bad, slice_rules=1)


def test_windows():
    from maskwright.functions import windows

    data = np.frombuffer(b"the quick brown fox jumps over the lazy dog" * 3, np.uint8)
    for size, got in zip(windows.SIZES, windows.hashes(data, list(windows.SIZES))):
        assert [windows.literal_hash(bytes(data[i:i + size]).decode()) for i in range(len(data) - size + 1)] == got.tolist()
        assert len(set(got.tolist())) == len({bytes(data[i:i + size]) for i in range(len(data) - size + 1)})


def test_the_plan_does_not_grow(spark):
    df = spark.createDataFrame([("a ref0001",)], "text STRING")

    def plan(n):
        out = mw.sanitize(df, "text", [mw.RuleTable.of(spark, some_rules(n, random.Random(2)))])
        return len(out._jdf.queryExecution().optimizedPlan().toString())
    assert plan(3_000) < 1.05 * plan(30)


def test_tables_of_rules(spark):
    rows = [(2, "bbb", None, "b", 0.5), (1, "aaa+", "[A]", None, None)]
    rules = spark.createDataFrame(rows, "rule_ord LONG, pattern STRING, replacement STRING, label STRING, confidence DOUBLE")
    clean, report = mw.sanitize_text(spark, "xaaaabbb", [mw.RuleTable.of(spark, rules)])
    assert clean == "x[A][CUSTOM]" and report["by_label"] == {"custom": 1, "b": 1}
    bad = rules.unionByName(spark.createDataFrame([(3, "(", "x", "y", 1.0)], rules.schema))
    with pytest.raises(Exception, match="unterminated"):
        mw.RuleTable.of(spark, bad)
    assert len(mw.RuleTable.of(spark, bad, on_error="drop_all")) == 0
    assert mw.sanitize_text(spark, "aaa", [mw.RuleTable.of(spark, bad, on_error="drop_all")])[0] == "aaa"
    with pytest.raises(ValueError, match="rule_ord"):
        mw.RuleTable.of(spark, rules.union(rules))
    with pytest.raises(ValueError, match="on_error"):
        mw.RuleTable.of(spark, rules, on_error="ignore")
    with pytest.raises(Exception, match="characters"):
        mw.RuleTable.of(spark, rules.withColumn("pattern", F.lit("a" * 10_001)).limit(1))
    assert len(mw.RuleTable.of(spark, rules.limit(0))) == 0


def test_addresses_of_any_length(spark):
    """Equal to Python's matcher whatever the local part's length, and what stands around it."""
    rule = next(r for r in default_rules() if r.label == "email_address")
    lengths = [*range(1, 12), *range(245, 275), *range(300, 2001, 170)]
    texts = [f"{p}{'a' * n}@host.com{s}" for n in lengths for p in ("", ".", "%", "+", "-", "_", "é", "x@y.org%", "a.") for s in ("", ".", "-", "_", "1", " ")]
    texts += [f"{'a.' * n}@{d}" for n in (100, 200) for d in ("x", "x.", "host.c", "a.b-.com.", "host.com1", "host.com_x", ".com", "host..com")]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING").repartition(4)
    got = {r.id: [(s.start, s.end) for s in r.spans] for r in mw.with_spans(df, "text", [rule]).collect()}
    wrong = [(texts[i][:20], len(texts[i]), got[i]) for i in got if got[i] != [m.span() for m in re.finditer(rule.pattern, texts[i])]]
    assert not wrong


@pytest.mark.parametrize("slice_rules", [50_000, 1])
def test_one_match_where_its_text_occurs_often(spark, slice_rules):
    """A rule's only match is not where its text first stands, or overlaps it; equal texts and texts that repeat a literal count once."""
    rules = [Rule("custom", "end", r"abc\b", "[E]", 1.0, 10), Rule("custom", "before", r"(?<=xx)ref7", "[B]", 1.0, 10), Rule("custom", "aa", r"aaaa(?!a)", "[A]", 0.9, 10),
             Rule("custom", "look", r"(?=look)", "[L]", 0.8, 10), Rule("custom", "once", r"ticket \d+", "[T]", 1.0, 10)]
    texts = ["abcd abcde abc", "ref7 é xxref7", "aaaaaa b", "a look", "é ticket 12 and", "ticket 1 ticket 1", "abc abc", "none"] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING").repartition(3)
    got = {r.id: [(s.start, s.end, s.label) for s in r.spans] for r in mw.with_spans(df, "text", [mw.RuleTable.of(spark, rules, slice_rules=slice_rules)]).collect()}
    for i, text in enumerate(texts):
        found = [(m.start(), m.end(), m.group(), r.replacement, r.category, r.label, r.confidence) for r in rules for m in re.finditer(r.pattern, text)]
        assert got[i] == [(s[0], s[1], s[5]) for s in model.resolve(found)], text
