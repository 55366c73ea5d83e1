"""Counting quotient filters against counters, collocations against a count of all phrases."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from maskwright.llm import collocations
from maskwright.llm.queries import ORACLES, QUERIES
from maskwright.llm.quotient_filter import Layout


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_filters_are_lossless_counters(data):
    k, bits, quotient = data.draw(st.integers(2, 5)), data.draw(st.integers(1, 32)), data.draw(st.integers(1, 12))
    gram = st.tuples(*[st.integers(0, 2**bits - 1)] * k)
    shards = data.draw(st.lists(st.lists(gram, min_size=1, max_size=30), min_size=1, max_size=4))
    if data.draw(st.booleans()):
        shards.append([shards[0][0]] * 300)
    layout, buckets = Layout(k, bits, quotient), {}
    for shard in shards:
        packed = layout.pack([np.array([g[j] for g in shard], np.uint32) for j in range(k)])
        for q, blob in layout.buckets(*layout.counted(layout.permute(packed))):
            assert 0 <= q < 2**quotient
            buckets.setdefault(q, []).append(blob)
    got = Counter()
    for q, blobs in buckets.items():
        limbs, n = layout.merged(q, blobs)
        for *g, c in zip(*layout.unpack(layout.restore(limbs)), n.tolist()):
            assert tuple(g) not in got
            got[tuple(map(int, g))] = c
    assert got == Counter(g for shard in shards for g in shard)


def test_quotients_are_even():
    layout = Layout(2, 17, 6)
    grams = [np.repeat(np.arange(1, 201), 200), np.tile(np.arange(1, 201), 200)]
    sizes = [len(layout.decode(q, b)[1]) for q, b in layout.buckets(*layout.counted(layout.permute(layout.pack(grams))))]
    assert len(sizes) == 64 and max(sizes) < 2 * 40_000 / 64


def brute(rows, least, longest, top):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {w: c for w, c in f.items() if len(w) > 1 and c >= least}
        gone = {w[i:j] for w, c in candidates.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1)
                if j - i < len(w) and w[i:j] in candidates and 100 * c >= 100 * candidates[w[i:j]]}
        mine = []
        for w in candidates.keys() - gone:
            a = candidates[w]
            score, _, l, r = min((1000 * a * n[lang] // (f[w[:k]] * f[w[k:]]), k, f[w[:k]], f[w[k:]]) for k in range(1, len(w)))
            mine.append((-score, -a, " ".join(w).encode(), l, r))
        out += [(lang, rank, p.decode(), -a, l, r, n[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(mine)[:top], 1)]
    return sorted(out)


def corpus():
    rng = random.Random(3)
    common = ["the", "The", "of", "ä", "x-y", "né é", "co", "0", "zz"]
    rows = [(None, None), ("en", None), ("en", ""), ("fr", " \t\n"), ("en", "..,,;;"), ("de", "a" * 5000), ("und", "the of the of the of, the of")]
    for i in range(120):
        words = rng.choices(common, [9, 2, 7, 3, 2, 1, 1, 1, 1], k=rng.randrange(60))
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\n", "!?"]) for w in words) + f" only{i}"
        rows.append((rng.choice(["en", "fr", None, "", "und"]), text + rng.choice(["", " one Two three four five six "] )))
    return rows + [rows[-1]] * 3


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("least, longest, top, dictionary", [(3, 5, 2000, 1 << 19), (3, 5, 7, 0), (8, 4, 50, 1 << 19), (2, 2, 50, 0)])
def test_against_brute_force(spark, least, longest, top, dictionary):
    rows = [(lang, text, 1, 2, 3) for lang, text in corpus()]
    docs = spark.createDataFrame(rows, "lang STRING, text STRING, w INT, n INT, word INT").repartition(5)
    got = collocations.collocations(docs, least=least, longest=longest, top=top, dictionary=dictionary)
    assert got.columns == COLUMNS
    want = brute(corpus(), least, longest, top)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10


def test_small_buffers_change_nothing(spark, monkeypatch):
    rows, want = corpus(), brute(corpus(), 3, 5, 2000)
    held = collocations._count_words.__globals__
    for name in ("HELD_WORDS", "FLUSH", "ROW"):
        monkeypatch.setitem(held, name, 16)
    got = collocations.collocations(spark.createDataFrame(rows, "lang STRING, text STRING"), least=3)
    assert sorted(map(tuple, got.collect())) == want


def test_invalid_bytes_and_large_products(spark):
    docs = spark.range(4).selectExpr("'en' AS lang", "concat(repeat('p q ', 60000), CAST(unhex('E2') AS STRING), ' ', id) AS text")
    top = collocations.collocations(docs, least=100).where("phrase = 'p q p q p'").first()
    assert (top.a, top.l, top.r, top.n) == (4 * 59_998, 4 * 60_000, 4 * 59_999, 4 * 120_002)
    assert top.score == 1000 * top.a * top.n // (top.l * top.r)
    assert spark.sql("SELECT (CAST(9000000000000000000 AS DECIMAL(19, 0)) * CAST(9000000000000000000 AS DECIMAL(19, 0)))"
                     " div (CAST(9000000000000000000 AS DECIMAL(19, 0)) * CAST(3 AS DECIMAL(19, 0))) AS x").first().x == 3 * 10**18


def test_query_and_its_sql(spark, tmp_path):
    rows = [(i, t, lang) for i, (lang, t) in enumerate(corpus() * 12)]
    spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_collocations"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(ORACLES["op11_collocations"])
    assert sorted(want.columns) == sorted(COLUMNS) == sorted(got.columns)
    assert [t for c, t in got.dtypes if c not in ("lang", "phrase")] == ["bigint"] * 6
    assert sorted(map(tuple, got.select(COLUMNS).collect())) == sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM want").fetchall())


def test_table_without_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id LONG, text STRING, lang STRING").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op11_collocations"](spark, str(tmp_path)).collect() == []
