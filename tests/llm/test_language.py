"""Language identification and language-model scores against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import language_id, mixing_lm
from maskwright.llm.common import text_buffer

import pyarrow as pa

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ context trees
def ppm_bits(train, text, order):
    """Code length by the definition, with dictionaries."""
    counts = defaultdict(Counter)
    fold = lambda t: bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode())
    for t in train:
        b = bytes(order) + fold(t)
        for i in range(order, len(b)):
            for k in range(order + 1):
                counts[b[i - k : i]][b[i]] += 1
    b, bits = bytes(order) + fold(text), 0.0
    for i in range(order, len(b)):
        for k in range(order, -1, -1):
            seen = counts.get(b[i - k : i])
            if not seen:
                continue
            n, kinds = sum(seen.values()), len(seen)
            if seen[b[i]]:
                bits -= math.log2(seen[b[i]] / (n + kinds))
                break
            bits -= math.log2(kinds / (n + kinds))
        else:
            bits += 8
    return bits


@pytest.mark.parametrize("chunk", [1 << 19, 11])
def test_trees_equal_brute_force(monkeypatch, chunk):
    monkeypatch.setattr(language_id, "CHUNK", chunk)
    rng = random.Random(5)
    train = {"x": ["abra cadabra", "Abracadabra!", "bar é"], "y": ["zebra zoo", "ozone", ""], "z": ["éèé"]}
    order, grams = 3, {}
    for lang, texts in train.items():
        data, offsets = text_buffer(pa.array(texts))
        buffer, starts = language_id.padded(data, offsets, order)
        own = np.ones(len(buffer), bool)
        for k in range(order):
            own[starts[:-1] + k] = False
        grams[lang] = np.unique(language_id._grams(buffer, order + 1)[own], return_counts=True)
    trees = language_id.Trees(grams, order)
    texts = ["abra", "", "ZOO", "qqq", "é", "中", "a" * 50] + ["".join(rng.choices("abrzoe é!", k=rng.randint(0, 30))) for _ in range(40)]
    got = trees.bits(*text_buffer(pa.array(texts)))
    want = [[ppm_bits(train[lang], t, order) for lang in trees.langs] for t in texts]
    assert np.allclose(got, want, rtol=1e-4, atol=1e-3)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trees = language_id.train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    got = language_id.predict(docs, trees, extra={"lang": F.col("lang")}).collect()
    assert len(got) == docs.count()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    rows = [(1, "the house", "en", 1), (2, "das haus", "de", 1), (3, None, "en", 1), (4, "123 !", None, 2), (5, "", "de", 3), (None, "the", None, 4), (6, "haus " * 200_000, None, 5),
            (6, "haus " * 200_000, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, letter int")
    trees = language_id.train(docs)
    got = {(r.doc_id, r.lang_pred) for r in language_id.predict(docs, trees).collect()}
    assert got == {(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (None, "en"), (6, "de")}
    kept = language_id.keep_identified(docs, trees)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[0], rows[1], rows[5], rows[6], rows[7]], key=repr)
    nothing = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), trees).count() == 0


def test_languages_of_long_texts_only(spark, monkeypatch):
    monkeypatch.setattr(language_id, "CHUNK", 1000)
    rows = [(1, "the house and the garden " * 2000, "en"), (2, "das haus und der garten " * 2000, "de"), (3, "la maison et le jardin", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = language_id.train(docs)
    assert trees.langs == ["de", "en", "fr"]
    assert {(r.doc_id, r.lang_pred) for r in language_id.predict(docs, trees).collect()} == {(1, "en"), (2, "de"), (3, "fr")}
    assert language_id.keep_identified(docs, language_id.train(docs.where("doc_id < 3"))).count() == 3
    # counts don't depend on the pieces that a long text is counted in
    monkeypatch.setattr(language_id, "CHUNK", 1 << 18)
    data = text_buffer(pa.array([t for _, t, _ in rows]))
    assert (trees.bits(*data) == language_id.train(docs).bits(*data)).all()


# ------------------------------------------------------------------ logistic mixing
def base_scores(rows, is_train):
    tokens = [(t or "").encode().lower().split() for _, t in rows]
    train = [w for (i, _), w in zip(rows, tokens) if is_train(i)]
    counts = Counter(x for w in train for x in w)
    n, v, ends = sum(counts.values()) + len(train), len(counts) + bool(train), len(train)
    return n, [(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1)), sum(counts[x] > 0 for x in w) + bool(ends), len(w) + 1) for w in tokens]


@pytest.mark.parametrize("top", [1 << 20, 50])
def test_base_score(spark, monkeypatch, top):
    monkeypatch.setattr(mixing_lm, "TOP", top)
    monkeypatch.setattr(mixing_lm, "HELD", 3000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(-1, None), (-2, ""), (-3, "A a\tÉ é"), (-4, rows_text := "new words " * 3), (-5, rows_text)]
    docs = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, score double").repartition(3)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = {r.doc_id: r for r in mixing_lm.score(docs, ~held_out, held_out).collect()}
    n, want = base_scores(rows, lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    for (i, _), (base, known, tokens) in zip(rows, want):
        r = got[i]
        assert abs(r.base_score - base) < 1e-6 and (r.n_known, r.n_tokens, r.train_tokens) == (known, tokens, n)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2) and r.score < 0
    assert got[-1].score == got[-2].score and got[-4].score == got[-5].score


def small_model():
    rng = random.Random(2)
    key = mixing_lm.windows(*_stream(["".join(rng.choices(["the ", "cat ", "sat ", "é"], k=400))]))
    low, table = np.zeros((256 + (1 << 16), 2)), np.zeros((mixing_lm.BUCKETS << mixing_lm.SLOT_BITS, 2))
    mixing_lm._add_windows(table, low, key, np.ones(len(key)))
    model = mixing_lm.Mixer(mixing_lm._signals(low), mixing_lm._signals(table))
    model.learn(key)
    return model


def _stream(texts):
    buffer, _ = mixing_lm.stream(*text_buffer(pa.array(texts)))
    return buffer, mixing_lm.ORDER, len(buffer)


def test_model_is_a_distribution_and_learns(monkeypatch):
    model = small_model()
    context = int.from_bytes(b"the c"[::-1], "little")
    context = sum(b << (8 * (k + 1)) for k, b in enumerate(b"the c"[::-1]))
    p = 10 ** model.cost(np.array([context | b for b in range(256)], np.uint64))
    assert abs(p.sum() - 1) < 1e-6
    assert p[ord("a")] > 0.5
    # pieces, order of texts and what is held do not change scores
    texts = ["the cat sat", "", "éé the", "unknown words 12", "the cat " * 50]
    whole = model.score(*text_buffer(pa.array(texts)), {})
    monkeypatch.setattr(mixing_lm, "PIECE", 13)
    monkeypatch.setattr(mixing_lm, "HELD", 40)
    assert np.allclose(whole, model.score(*text_buffer(pa.array(texts)), {}))
    assert np.allclose(whole[::-1], model.score(*text_buffer(pa.array(texts[::-1])), {}))
    assert whole[0] / 12 > whole[3] / 17


def test_lm_edges(spark):
    rows = [(1, None), (None, "a b"), (2, "x " * 300_000), (2, "x " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = mixing_lm.score(docs, F.lit(False), F.lit(True)).collect()
    assert len(got) == 4 and all(r.train_tokens == 0 and r.n_known == 0 for r in got)
    assert all(r.base_score == 0 for r in got)  # log10(1 / 1) for every token
    assert mixing_lm.score(docs.limit(0), F.lit(True), F.lit(False)).count() == 0


def test_weights_come_from_all_training_texts(spark, monkeypatch):
    """The learned weights see each occurrence of each byte and end of every training text, however many and long they are."""
    seen = []
    average = mixing_lm.Mixer.average
    monkeypatch.setattr(mixing_lm.Mixer, "average", lambda self, learned: (seen.extend(learned), average(self, learned))[1])
    rows = [(k, f"word{k % 50} and some more text {k}") for k in range(400)] + [(1000, "long " * 5000), (1001, None), (1002, "held out")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held_out = F.col("doc_id") == 1002
    mixing_lm.score(docs, ~held_out, held_out)
    coded = sum(len((t or "").encode()) + 1 for _, t in rows[:-1])
    assert sum(used.sum() for _, used, _, _ in seen) == 8 * coded
