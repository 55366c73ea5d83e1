"""Files in ranges against the same files as one text."""

import random
import re

import pytest
from pyspark.sql import functions as F

import maskwright as mw
import model
from maskwright.functions.lines import Bracket, Unbounded, before_line_ends, bracket, joins
from maskwright.operators.large_text import _pieces, _scan, mask_large_files, read_chunks
from maskwright.rules import Rule, default_rules


@pytest.mark.parametrize("pattern, want", [
    (r"a\s*=\s*b", 2), (r"[^\s'\"]+", 0), (r"a[ \t]+b", 0), (r"a.b", 0), (r"(?:a\n){3}", 3), (r"(?m)^a$", 0), (r"a(?:\s+|b)c", 1), (r"\S+\s\w+", 1),
])
def test_joins(pattern, want):
    assert joins(pattern) == want


@pytest.mark.parametrize("pattern", [r"[\s\S]+", r"(?s)a.b", r"[^a]", r"\W", r"^a", r"a\Z", r"(a)\1", r"(?:\s*a)+", r"\D+"])
def test_unbounded(pattern):
    with pytest.raises(Unbounded):
        joins(pattern)


def test_all_default_rules_can_be_followed():
    open_rules = []
    for r in default_rules():
        try:
            assert joins(r.pattern) <= 3
        except Unbounded:
            open_rules.append(r.label)
            bracket(r.pattern)
    assert open_rules == ["private_key", "azure_storage_connection_string"]
    assert bracket(r"<a>[^;]+;b") == Bracket("<a>", 1, ";", ";b")
    with pytest.raises(Unbounded):
        bracket(r"a[^;]+b")


@pytest.mark.parametrize("seed", range(200))
def test_scan_is_the_matcher(seed):
    rng = random.Random(seed)
    for pattern in (r"-BEGIN[A-Z]*-[\s\S]*?-END-", r"p;a=[^;]+;k=\d;"):
        b = bracket(pattern)
        text = "".join(rng.choices(["-BEGINX-", "-END-", "-BEGIN", "x\n", "p;a=", ";k=1;", ";", "p", "\n"], k=30))
        found, left = _scan(text, 0, b.least, *map(re.compile, (b.head, b.stop, b.tail)))
        assert found == [m.span() for m in re.finditer(pattern, text)]
        if left is not None:  # what may still come decides
            assert re.compile(pattern).match(text + "\n" + b.tail.replace(r"\d", "1"), left)


PIECES = ["password", " = ", "=", "\n", "\n", "\n\n \t\n", "hunter22", "bearer", "abcdefgh12345", "10.0.0.1", "passport", "no", "A12345678", "x@y.org", "plain words here",
          "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "DefaultEndpointsProtocol=https;AccountName=", "acc", f";AccountKey={'k' * 88};", ";",
          "api_key:", "é😀", " ", "pwd: \"a b\"", "\r\n", "https://db.corp/x"]


def whole(text):
    return model.sanitize(text, default_rules())


@pytest.mark.parametrize("size, ranges", [(40, 400), (300, 1 << 27)])
def test_files_in_ranges_equal_files_in_one(spark, tmp_path, size, ranges):
    rng = random.Random(size)
    texts = {}
    for i in range(14):
        texts[f"f{i}"] = "".join(rng.choices(PIECES, k=rng.choice([0, 1, 5, 60, 200]))) + rng.choice(["", "\n", "end"])
    texts["key"] = "a\n-----BEGIN RSA PRIVATE KEY-----\n" + "MIIkeymaterial\n" * 60 + "-----END RSA PRIVATE KEY-----\nafter 10.0.0.1\n" + "-----BEGIN X PRIVATE KEY-----\nnever closed\n" * 9
    texts["blank"] = "password" + "\n" * 300 + "= hunter2222\nrest"
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", ranges)
        rows = mask_large_files(spark, str(tmp_path), chunk=size).collect()
        got = {n: ["", 0] for n, t in texts.items() if not t}
        for r in sorted(rows, key=lambda r: (r.path, r.seq)):
            own = got.setdefault(r.path.rpartition("/")[2], ["", 0])
            own[0] += r.clean_text
            own[1] += r.n_spans
        for name, text in texts.items():
            clean, spans = whole(text)
            assert got[name] == [clean, len(spans)], name
        assert size > 40 or len(rows) > 30
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_chunks_are_the_file(spark, tmp_path):
    text = "".join(f"line {i} of the file, password{' ' * (i % 3)}\n" for i in range(20_000))
    (tmp_path / "a.txt").write_text(text)
    chunks = read_chunks(spark, str(tmp_path / "a.txt"), default_rules(), 10_000).orderBy("block", "n").collect()
    assert "".join(c.text for c in chunks) == text and len(chunks) > 20


def test_what_cannot_be_followed_is_refused(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a\n")
    for pattern in (r"(?s)a.b", r"q*", r"\Aa"):
        with pytest.raises(Unbounded):
            mask_large_files(spark, str(tmp_path), [Rule("custom", "c", pattern, "x")])
    table = mw.RuleTable.of(spark, [Rule("custom", "c", "abc", "x")])
    with pytest.raises(Unbounded):
        mask_large_files(spark, str(tmp_path), [table])
    assert [r.clean_text for r in mask_large_files(spark, str(tmp_path), [Rule("custom", "c", "a", "x")]).collect()] == ["x\n"]


def test_invalid_bytes_in_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"\xe2 password=hunter2secret\nx \xff 10.0.0.1")
    rows = mask_large_files(spark, str(tmp_path)).orderBy("seq").collect()
    assert "".join(r.clean_text for r in rows) == "� [REDACTED]\nx � [IP_ADDRESS]"


@pytest.mark.parametrize("pattern, want", [
    (r"ab\s*=\s*c", "b="), (r"a[ \t]+b", ""), (r"(?i)x(?:yz?)?\s+w", "XYZxyz"), (r"(?:a\n){3}", "a"), (r"[^\s,]\s?;", "".join(chr(c) for c in range(33, 127) if c != 44)),
    (r"p(?=q\s)", "q"), (r"a(?:\s*b)?\s*c", "ab"), (r"(?m)^a$", ""),
])
def test_before_line_ends(pattern, want):
    assert {chr(c) for c in before_line_ends(pattern) if 32 < c < 127} == set(want)


def test_any_character_may_stand_before():
    for pattern in (r"\s+a", r"\n?a", r"(?<=\n)a", r"a.\s"):
        assert before_line_ends(pattern) >= set(range(33, 127))


@pytest.mark.parametrize("seed", range(20))
def test_pieces_hold_what_the_chunk_holds(seed):
    """Every rule finds in the pieces what it finds in the whole, at the same places; lines are cut apart where they can be."""
    import pyarrow as pa

    rng = random.Random(seed)
    rules = [r for r in default_rules() if r.label not in ("private_key", "azure_storage_connection_string")]
    text = "".join(rng.choices([*PIECES, "passport", "number", "\u00a0\n", "bearer", "\x1c\n", "account_id"], k=400))
    batch = pa.RecordBatch.from_pydict({"path": ["p"], "block": [0], "n": pa.array([0], pa.int32()), "text": [text]})
    (out,) = _pieces(rules)([batch])
    pieces = out.to_pylist()
    assert "".join(p["text"] for p in pieces) == text and len(pieces) > 20
    assert all(text[p["at"]:p["at"] + len(p["text"])] == p["text"] for p in pieces)
    for r in rules:
        assert [m.span() for m in re.finditer(r.pattern, text)] == [
            (p["at"] + m.start(), p["at"] + m.end()) for p in pieces for m in re.finditer(r.pattern, p["text"])], r.label
