"""Exact duplicates, the Jaccard join, components and near-duplicate vectors against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from maskwright.llm import bloom, exact_dedup, ngram_join, shingles, vector_dedup
from maskwright.llm.components import components

DOCS = "doc_id long, text string"


def least_reachable(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# ------------------------------------------------------------------ exact duplicates
ODD = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (None, "b"), (6, "A"), (7, "x" * 100_000), (8, "x" * 100_000), (9, "é\u0000 "), (10, "é\u0000")]


@pytest.mark.parametrize("log2_bits", [24, 27])
def test_exact_report(spark, log2_bits):
    rows = ODD + [(100 + k, f"t{k % 7}") for k in range(60)]
    got = exact_dedup.duplicate_report(spark.createDataFrame(rows, DOCS).repartition(3), log2_bits=log2_bits).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    want = {(i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}
    assert {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got} == want
    assert len(got) == len(rows) and all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_exact_drop_keeps_columns_and_one_of_repeated_rows(spark):
    rows = [(1, "a", 1, "p"), (2, "a", 2, "q"), (2, "a", 2, "q"), (3, "b", 3, None), (None, None, 4, "r"), (None, "n", 5, "s"), (5, "", 5, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id int, _digest string")
    got = exact_dedup.drop_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([rows[2], rows[3], rows[5], rows[6]], key=repr)


def test_exact_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert exact_dedup.duplicate_report(docs).count() == exact_dedup.drop_duplicates(docs).count() == 0


def test_bloom_never_misses(spark):
    values = list(range(0, 3000, 3)) + [5, 5, 7, 7, 7]
    hashes = spark.createDataFrame([(v * 2654435761 % 2**62,) for v in values], "h long").repartition(5)
    every, again = bloom.table_of(hashes), bloom.table_of(hashes, True)
    h = np.array([v * 2654435761 % 2**62 for v in values])
    assert bloom.found(every, h).all()
    assert bloom.found(again, h[-5:]).all() and bloom.found(again, h[:-5]).mean() < 0.01


# ------------------------------------------------------------------ shingles
def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def shingle_strings(text):
    w = words(text)
    return {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} - {""}


@pytest.mark.parametrize("piece", [1 << 20, 7, 64])
def test_shingle_hashes(monkeypatch, piece):
    monkeypatch.setattr(shingles, "PIECE", piece)
    rng, seen = random.Random(3), {}
    for _ in range(60):
        texts = ["".join(rng.choices("aB cé\n\tx ", k=rng.choice([0, 1, 5, 40, 200]))) for _ in range(rng.randint(1, 8))]
        raw = [t.encode() for t in texts]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        for text, tokens in zip(texts, shingles.shingle_sets(data, offsets)):
            strings = shingle_strings(text)
            assert len(tokens) == len(strings)
            assert seen.setdefault(frozenset(strings), tokens.tobytes()) == tokens.tobytes()
    assert len(set(seen.values())) == len(seen)


# ------------------------------------------------------------------ Jaccard join
def near_copies(seed):
    rng = random.Random(seed)
    vocabulary, rows = [f"w{k}" for k in range(400)], []
    passage = rng.choices(vocabulary, k=60)
    for _ in range(10):
        base = rng.choices(vocabulary, k=rng.choice([3, 5, 6, 8, 12, 30, 80, 200]))
        for _ in range(rng.choice([1, 2, 8, 30])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 18))):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 1)] = rng.choices(vocabulary, k=rng.randint(0, 1)) or w[k : k + 1]
            rows.append(" ".join(w + passage * (rng.random() < 0.3)))
    rows += [" ".join(rng.choices(vocabulary, k=rng.randint(1, 12)) + passage) for _ in range(30)]
    rows += [None, "", " \n", "a b", "A  b", rows[0], rows[0].upper()]
    rng.shuffle(rows)
    return [(3 * k + 1, t) for k, t in enumerate(rows)]


def brute_components(rows, limit=80):
    sets = {i: shingle_strings(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= limit * len(sets[a] | sets[b])]
    least = least_reachable(sets, links)
    return {i: (len(s), least[i]) for i, s in sets.items()}


def test_jaccard_join_is_exact(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FLUSH", 700)
    monkeypatch.setattr(ngram_join, "PART", 5)
    rows = near_copies(7)
    got = ngram_join.join_report(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_jaccard_edges(spark):
    long = " ".join(f"word{k}" for k in range(30_000))
    rows = [(1, long), (2, long + " more"), (None, "one two three four five six"), (4, "one two three four five six"), (4, "one two three four five six"),
            (5, None), (None, ""), (6, "x" * 3_000_000), (7, "y")]
    docs = spark.createDataFrame([(i, t, "g") for i, t in rows], DOCS + ", component_id string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join_report(docs).collect()), key=repr)
    assert got == sorted([(1, 29_996, 1), (2, 29_997, 1), (None, 2, 4), (4, 2, 4), (4, 2, 4), (5, 0, 5), (None, 0, None), (6, 1, 6), (7, 1, 7)], key=repr)
    left = ngram_join.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted([1, None, 4, 4, 5, None, 6, 7], key=repr)
    assert ngram_join.join_report(docs.limit(0)).count() == 0


def test_near_duplicates_under_a_shared_id(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(1, base), (9, base + " end"), (9, "another text of its own under the default id"), (9, ""), (9, None), (-1, " ".join(f"v{k}" for k in range(60))),
            (-1, " ".join(f"v{k}" for k in range(61))), (-1, "unique words of one more row here"), (None, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = list(map(tuple, ngram_join.drop_near_duplicates(docs).collect()))
    assert len(left) == 7 and len(set(left) & set(rows[5:7])) == 1
    assert set(left) - set(rows[5:7]) == {rows[0], rows[2], rows[3], rows[4], rows[7], rows[8]}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + k, 401 + k) for k in range(50)] + [(600, 600 + k) for k in range(40)] + [(9, 9), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    nodes = {x for pair in real for x in pair}
    assert got == least_reachable(nodes, real)


# ------------------------------------------------------------------ vectors
def test_vectors_recall_and_precision(spark):
    rng = np.random.default_rng(0)
    rows, x = [], rng.normal(size=(300, 32))
    for k, base in enumerate(x):
        for c in range(rng.integers(1, 4)):
            noise = rng.normal(size=32)
            noise -= (noise @ base) / (base @ base) * base
            cos = rng.uniform(0.9, 0.999)
            v = base / np.linalg.norm(base) + noise / np.linalg.norm(noise) * np.sqrt(1 / cos**2 - 1) if c else base
            rows.append((len(rows), v.astype(np.float32).tolist(), int(k % 3) if k % 10 else None))
    rows += [(len(rows) + k, rows[0][1], rows[1][2]) for k in range(3)] + [(len(rows) + 3 + k, rows[5][1], 1) for k in range(40)]
    got = {r.vec_id: r for r in vector_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3), block=16).collect()}
    m = np.array([r[1] for r in rows], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    same = np.array([[a[2] == b[2] and a[2] is not None for b in rows] for a in rows])
    linked = (m @ m.T >= 0.93) & same
    np.fill_diagonal(linked, False)
    found = np.array([got[k].n_links for k in range(len(rows))])
    assert (found <= linked.sum(axis=1)).all()
    assert found.sum() >= 0.99 * linked.sum() and linked.sum() > 1500
    if found.sum() == linked.sum():
        least = least_reachable(range(len(rows)), zip(*np.nonzero(np.triu(linked))))
        assert {k: got[k].component_id for k in got} == least
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_vectors_that_cannot_link(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 0), (6, [0.0, 0.0], 0), (7, [nan, 1.0], 0), (8, [inf, 1.0], 0),
            (9, [None, 1.0], 0), (10, [], 0), (11, [1.0], 0), (None, [3.0, 0.001], 0), (1, [1.0, 0.0], 0), (12, [1e30, 1.0], 0), (13, [1e-38, 0.0], 0)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in vector_dedup.link_vectors(docs).collect()), key=repr)
    together = [(1, 5, 1), (1, 5, 1), (2, 5, 1), (None, 5, 1), (12, 5, 1), (13, 5, 1)]
    assert got == sorted(together + [(k, 0, k) for k in (3, 4, 5, 6, 7, 8, 9, 10, 11)], key=repr)
    assert vector_dedup.link_vectors(docs.limit(0)).count() == 0
