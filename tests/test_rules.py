import json
import re

import pytest

from maskwright import RuleSet, default_rules, profile_names, rules_for_profile, sanitize, sanitize_text
from maskwright.functions.dialect import Unsupported, java_pattern, literal_prefix, runs_on_jvm
from maskwright.rules import Rule, profiles_dataframe, rules_dataframe
from maskwright.sources.patterns import read_patterns


def categories(rules):
    return {r.category for r in rules}


def test_profiles():
    assert profile_names() == ["aws", "k8s", "network", "secrets"]
    assert categories(rules_for_profile("aws")) == {"secrets", "cloud", "pii"}
    assert categories(rules_for_profile("k8s")) == {"secrets", "network", "pii"}
    assert categories(rules_for_profile("SECRETS", [Rule("custom", "c", "x", "y")])) == {"secrets", "custom", "pii"}
    assert categories(rules_for_profile("network")) == {"network", "pii"}
    with pytest.raises(ValueError, match=r"Unknown profile: 'bogus' \(known: aws, k8s, network, secrets\)"):
        rules_for_profile("bogus")


def test_priority_order_and_defaults(spark):
    custom = [Rule("custom", "c", "x", "y", priority=10)]
    order = list(dict.fromkeys(r.category for r in RuleSet.of(default_rules(custom)).ordered()))
    assert order == ["secrets", "cloud", "pii", "network", "custom"]
    assert RuleSet.of([]) == RuleSet.of(None) == RuleSet(tuple(default_rules()))
    rows = rules_dataframe(spark).collect()
    assert [r.rule_ord for r in rows] == list(range(29)) and {r.engine for r in rows} == {"jvm"}
    assert profiles_dataframe(spark).where("profile = 'aws'").count() == 4


def test_reference_cases(spark):
    cases = [
        ("password=SuperSecret123\n", None, 0.0, "[REDACTED]\n"),
        ("token=0123456789abcdef0123456789abcdef\n", None, 0.0, "token=[TOKEN]\n"),
        ("0123456789abcdef0123456789abcdef\n", None, 0.80, "0123456789abcdef0123456789abcdef\n"),
        ("host=10.0.0.1\n", rules_for_profile("aws"), 0.0, "host=10.0.0.1\n"),
        ("sa=myapp@myproject.iam.gserviceaccount.com\n", rules_for_profile("k8s", pii=False), 0.0,
         "sa=myapp@myproject.iam.gserviceaccount.com\n"),
        ("aws_account_id: 123456789012", None, 0.0, "aws_[AWS_ACCOUNT_ID]"),
        ("Public: 8.8.8.8, IPv6: 2001:db8::1", None, 0.0, "Public: [IP_ADDRESS], IPv6: [IP_ADDRESS]1"),
    ]
    for text, rules, floor, clean in cases:
        assert sanitize_text(spark, text, rules, floor)[0] == clean
    clean, report = sanitize_text(spark, "password=SuperSecret123 host=db01.prod.internal ip=10.0.1.45")
    assert clean == "[REDACTED] host=[INTERNAL_HOSTNAME] ip=[IP_ADDRESS]"
    assert report == {"total_matches": 3, "by_category": {"secrets": 1, "network": 2}, "is_clean": False,
                      "by_label": {"password": 1, "internal_hostname": 1, "ipv4_address": 1}}


def test_declarative_detector(spark):
    rules = [Rule("dummy", "secret_word", "secret", "[SECRET]"), Rule("dummy", "number", r"\d+", "[NUMBER]")]
    df = spark.createDataFrame([("my secret is safe",), ("secret 123 and 456",)], "text STRING")
    one, two = sanitize(df, "text", rules).collect()
    assert [tuple(s) for s in one.spans] == [(3, 9, "secret", "[SECRET]", "dummy", "secret_word", 1.0)]
    assert [s.label for s in two.spans] == ["secret_word", "number", "number"]


def write(path, content):
    path.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")
    return str(path)


def test_pattern_file(spark, tmp_path):
    path = write(tmp_path / "p.json", [
        {"pattern": r"ticket-\d{6}", "replacement": "[TICKET]", "label": "internal_ticket"},
        {"pattern": r"CORP-\d+", "confidence": 0.75}])
    full, short = read_patterns(spark, path)
    assert (full.category, full.label, full.replacement, full.confidence) == ("custom", "internal_ticket", "[TICKET]", 1.0)
    assert (short.label, short.replacement, short.confidence) == ("custom", "[CUSTOM]", 0.75)
    out = sanitize_text(spark, "ticket-123456 CORP-42", [full, short])
    assert out[0] == "[TICKET] [CUSTOM]"
    assert read_patterns(spark, write(tmp_path / "e.json", [])) == []


@pytest.mark.parametrize("content,error", [
    ("not valid json", json.JSONDecodeError), ([{"pattern": "ok"}, {"pattern": "[invalid("}], re.error), ([{"label": "x"}], KeyError)])
def test_bad_pattern_file_drops_all_or_raises(spark, tmp_path, content, error):
    path = write(tmp_path / "bad.json", content)
    assert read_patterns(spark, path, on_error="drop_all") == []
    with pytest.raises(error):
        read_patterns(spark, path)


def test_missing_pattern_file_and_bad_types(spark, tmp_path):
    assert read_patterns(spark, str(tmp_path / "none.json"), on_error="drop_all") == []
    with pytest.raises(FileNotFoundError):
        read_patterns(spark, str(tmp_path / "none.json"))
    path = write(tmp_path / "t.json", [{"pattern": "a", "confidence": "high"}])
    with pytest.raises(ValueError):
        read_patterns(spark, path, on_error="drop_all")


def test_dialect():
    assert runs_on_jvm(r"ticket-\d+") and runs_on_jvm(r"(?i)a{2,3}\b[\w.-]+")
    assert [literal_prefix(p) for p in (r"ticket-\d+", "abcd?e", "abcde", "abc|d", "(?i)abc", "ab", "a.b", r"abc\d|x", "abc{2}")] == [
        "ticket-", "abc", "abcde", None, None, None, None, None, None]
    for pattern in (r"(?P<n>x)", r"(ab)+", r"(a|b)*c", r"(.)\1", r"q*", r"(?x) a", r"a|", r"(?=x)", "(?i)é"):
        assert not runs_on_jvm(pattern), pattern
    with pytest.raises(Unsupported):
        java_pattern(r"(ab)+")


def test_dialect_meaning(spark):
    patterns = [r"\w+\s*\d", r"[^\w]x", r"a{,2}b", r"[[&&~]", r"x{y}", r"^a.b$", r"(?s)a.b", r"(?m)^b$", r"\Aa|b\Z", r"[\S]1", r"\x41|é"]
    texts = ["ab²1 x", "a\x85b", "a\rb", "a\nb\n", "aab b x{y}", "[&~", "A é", "ſ1 １", "a b", " x_x-x"]
    for p in patterns:
        assert runs_on_jvm(p), p
        df = spark.createDataFrame([(t,) for t in texts], "text STRING")
        got = {r.text: [(s.start, s.end) for s in r.spans] for r in sanitize(df, "text", [Rule("custom", "c", p, "")]).collect()}
        assert got == {t: [m.span() for m in re.finditer(p, t)] for t in texts}, p
