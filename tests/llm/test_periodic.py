"""Periodic runs against a search over all stretches."""

import random
import time

import duckdb
import pytest
from hypothesis import given, settings, strategies as st

from maskwright.llm import periodic
from maskwright.llm.queries import ORACLES, QUERIES


def brute(words, least):
    out = []
    n = len(words)
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            stretch = words[i - q:j]
            if len(stretch) >= max(least, 3 * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                out.append((i - q, len(stretch), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(3, 24))
def test_small_alphabets(words, least):
    assert periodic.runs(words, least) == brute(words, least)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.integers(1, 6)), max_size=8))
def test_tiled_pieces(parts):
    words = [w for block, times in parts for w in block * times]
    assert periodic.runs(words) == brute(words, 24)
    nested = words + words + words[: len(words) // 2] + words
    assert periodic.runs(nested) == brute(nested, 24)


def test_collapsed():
    words = [b"x", *[b"a", b"b"] * 13, b"y"]
    found = periodic.runs(words)
    assert found == [(1, 26, 2)]
    assert periodic.collapsed(words, found) == b"x a b y"


def test_long_texts_are_near_linear():
    rng = random.Random(1)
    block = [rng.randrange(50) for _ in range(1000)]
    start = time.time()
    assert periodic.runs(["a"] * 300_000) == [(0, 300_000, 1)]
    assert (0, 300_000, 1000) in periodic.runs(block * 300)
    assert time.time() - start < 60


EDGES = [
    (1, None), (2, ""), (3, " \t\n"), (4, "a " * 23), (5, "a " * 24), (6, "A a " * 12), (7, " x " * 30), (7, " x " * 30), (None, "b " * 40),
    (8, "one two three four five six seven eight nine " * 3), (9, "z " * 5000 + "q " * 5000), (10, "solo"),
]


def test_edge_rows_and_clashing_names(spark):
    rows = [(i, t, 1, 2) for i, t in EDGES]
    out = periodic.periodic_runs(spark.createDataFrame(rows, "doc_id LONG, text STRING, runs INT, n_words INT"))
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()), key=repr)
    want = []
    for i, t in EDGES:
        words = [w.decode() for w in (t or "").encode().split()]
        found = brute(words, 24) if len(words) < 100 else periodic.runs(words)
        gone = {k for s, m, q in found for k in range(s + q, s + m)}
        want.append((i, len(words), found, " ".join(w for k, w in enumerate(words) if k not in gone)))
    assert got == sorted(want, key=repr)
    assert periodic.periodic_runs(out.limit(0).select("doc_id", out.collapsed.alias("text"))).count() == 0


def test_query_and_its_sql_on_edges(spark, tmp_path):
    rows = [(i, t) for i, t in EDGES if i is not None and i != 7] + [
        (100 + k, " ".join(random.Random(k).choices("abc", k=k * 7))) for k in range(60)]
    spark.createDataFrame(rows, "doc_id LONG, text STRING").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    columns = sorted(got.columns)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(ORACLES["op12_periodic_runs"])
    assert sorted(want.columns) == columns
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(con.sql(f"SELECT {', '.join(columns)} FROM want").fetchall(), key=repr)
    assert got.where("n_runs > 0").count() >= 10 and dict(got.dtypes)["start"] == "bigint"


def test_table_without_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id LONG, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op12_periodic_runs"](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_nested_periods(seed):
    rng = random.Random(seed)
    inner = [rng.choice("ab") for _ in range(3)] * 9
    words = (inner + [rng.choice("cd")]) * 5 + inner * 2
    assert periodic.runs(words) == brute(words, 24)
