"""Source mixing, chat formatting, packing and the pipeline: constraints, round trips and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from maskwright.llm import chat, mixing, packing

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string"


# ------------------------------------------------------------------ mixing
def water_filled(sizes, weights=(3, 1, 2), total=1.5, most=2):
    """Targets by sharing again and again what the limits free."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, open_ = {}, total * sum(sizes.values()), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > most * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def count_words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_sizes(spark, seed):
    rng = random.Random(seed)
    rows = [(k, " ".join("w" * rng.randint(0, 60)), rng.choice(["b", "a", "é", "z", "Z", None, "", "b", "b", "b"])) for k in range(3000)]
    rows += [(9000 + k, None, "nulls") for k in range(3)] + [(9100, "x", "one")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = mixing.mix_report(docs).collect()
    sizes = Counter({s: 0 for _, _, s in rows})
    for _, t, s in rows:
        sizes[s] += count_words(t)
    want, source = water_filled(sizes), {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.size == count_words(rows[r.doc_id][1] if r.doc_id < 3000 else {9100: "x"}.get(r.doc_id))
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 2
        taken[s] += r.taken
    assert len(got) == len(rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(2, 0.01 * want[s]), s
    again = mixing.mix_report(docs.repartition(7)).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}


def test_sample_is_the_lowest_ranks(spark):
    """Below the certain copies, those with the lowest hashes are taken until the words are reached, but for what fills the gap."""
    rows = [(k, "a b c", f"s{k % 2}") for k in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in mixing.mix_report(docs).collect()}
    rank = {r.doc_id: r.k for r in mixing._rows(docs, "doc_id", "text", "source", 0).collect()}
    for s in (0, 1):
        ids = sorted((i for i in got if i % 2 == s), key=rank.get)
        copies = [got[i].copies for i in ids]
        assert copies == sorted(copies, reverse=True)


@pytest.mark.parametrize("seed", [0, 1, 2, 3])
def test_targets_hold_with_very_long_documents(spark, seed):
    rng = random.Random(0)
    rows = [(k, "w " * (1 + int(rng.lognormvariate(5, 1))), "ab"[k % 2]) for k in range(600)] + [(1000, "w " * 40_000, "a"), (1001, "w " * 90_000, "b"), (1002, "w " * 30_000, "b")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got, source = mixing.mix_report(docs, seed=seed).collect(), {i: s for i, _, s in rows}
    for s in "ab":
        target = next(r.target for r in got if source[r.doc_id] == s)
        assert abs(sum(r.taken for r in got if source[r.doc_id] == s) - target) <= 0.001 * target, s
    mixed = Counter(r.doc_id for r in mixing.mix(docs, seed=seed).collect())
    assert mixed == +Counter({r.doc_id: r.copies for r in got})


def test_mix_emits_copies_with_all_columns(spark):
    rows = [(k, "w " * (k % 9), f"s{k % 4}", k) for k in range(200)] + [(None, None, None, 1), (5, "w " * 5, "s1", 5)]
    docs = spark.createDataFrame(rows, DOCS + ", copies int").withColumnRenamed("copies", "p")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got, want = Counter(map(tuple, mixed.collect())), Counter()
    by_id = {}
    for r in mixing.mix_report(docs).collect():
        by_id.setdefault(r.doc_id, r.copies)
    for row in rows:
        want[row] += by_id[row[0]]
    assert got == +want
    empty = docs.limit(0)
    assert mixing.mix(empty).count() == mixing.mix_report(empty).count() == 0
    none = spark.createDataFrame([(1, None, "a"), (2, "", None)], DOCS)
    assert [r.taken for r in mixing.mix_report(none).collect()] == [0, 0]


# ------------------------------------------------------------------ chat
def test_assembly_round_trip():
    rng = random.Random(4)
    alphabet = ["<", ">", "\\", "|", "b", "l", "g", "\n", "é", "😀", "<|end|>\n", "|>\n", "a"]
    texts = [None, ""] + ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(500)]
    roles = [rng.choice([None, "", "user", "assistant", "a|>\nb", "\\l"]) for _ in texts]
    formatted, start, end = (x.to_pylist() for x in chat.assemble(pa.array(roles, pa.string()), pa.array(texts, pa.string())))
    for f, a, b, role, text in zip(formatted, start, end, roles, texts):
        assert chat.read_turn(f) == (role or "", text or "")
        assert chat.unescape(f[a:b]) == (text or "")
        assert f.count("<") == 2 and f.endswith("<|end|>\n")
    empty = chat.assemble(pa.array([], pa.string()), pa.array([], pa.string()))
    assert [len(x) for x in empty] == [0, 0, 0]


def test_conversations(spark):
    rows = [(1, 1, "assistant", "yes <b>"), (1, 0, "user", "no?"), (1, None, "system", None), (2, 0, None, ""), (None, 3, "assistant", "x"), (None, 3, "assistant", "x"), (3, 0, "user", "z" * 300_000),
            (1, 2, "assistant", "é\\")]
    talks = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    turns = chat.format_turns(talks)
    got = {r.conv_id: r for r in chat.digest(turns).collect()}
    whole = {r.conv_id: r for r in chat.format_conversations(turns).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append(((t is not None, t or 0), role or "", text or ""))
    assert got.keys() == whole.keys() == by.keys()
    for c, parts in by.items():
        parts.sort()
        learnt = "".join(t for _, r, t in parts if r == "assistant")
        r = got[c]
        assert r.n_turns == len(parts)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in parts).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert r.formatted_chars == len(whole[c].formatted)
        assert "".join(chat.unescape(whole[c].formatted[s.loss_start : s.loss_end]) for s in whole[c].loss) == learnt
    assert chat.digest(chat.format_turns(talks.limit(0))).count() == 0


# ------------------------------------------------------------------ packing
def check_packing(rows, pieces, size=2048):
    """Every id in one piece, sequences gapless; returns tokens by (sequence, source)."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for _, t, *_ in rows]
    want = Counter((r[0], len(i)) for r, i in zip(rows, ids))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id, p.doc_tokens].append(p)
        by_sequence[p.sequence_id].append(p)
    assert sum(p.length for p in pieces) == sum(map(len, ids))
    assert {k for k in by_doc} == set(want)
    for r, i in zip(rows, ids):
        if want[r[0], len(i)] == 1:
            at = 0
            for p in sorted(by_doc[r[0], len(i)], key=lambda p: p.start):
                assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(i[at : at + p.length], "<u4").tobytes())
                at += p.length
            assert at == len(i)
    padding = 0
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == [0, *np.cumsum([p.length for p in parts])[:-1]]
        n = sum(p.length for p in parts)
        assert n <= size
        padding += 0 if n & (n - 1) == 0 else size - n
    assert padding == 0
    return by_sequence


@pytest.mark.parametrize("windows", [512, 3])
def test_packing(spark, windows):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(-1, None, "src1"), (-2, "", None), (-3, "<|endoftext|> 日本 ’", "src2"), (-4, "a" * 50_000, None), (-5, "x", "src1")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], DOCS + ", length int").repartition(5)
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), windows=windows).collect()
    for p in pieces:
        assert len(p.ids) == p.length
    by_sequence = check_packing(rows, pieces)
    # deficits are carried: after any number of full windows every source is near its share
    total, source = Counter(), {i: s for i, _, s in rows}
    for p in pieces:
        total[source[p.doc_id]] += p.length
    share = {s: n / sum(total.values()) for s, n in total.items()}
    got, placed = Counter(), 0
    for k in sorted(by_sequence):
        n = sum(p.length for p in by_sequence[k])
        placed += n
        for p in by_sequence[k]:
            got[source[p.doc_id]] += p.length
        assert all(abs(got[s] - share[s] * placed) <= 2 * packing.LEAST + 2 for s in share)


def test_packing_edges(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(7, "same words", "a"), (7, "same words", "a"), (None, "null id", None)]
    check_packing(rows, packing.pack(spark.createDataFrame(rows, DOCS), path).collect())
    assert packing.pack(spark.createDataFrame([], DOCS), path).count() == 0


def test_tokenizers_agree():
    rng = random.Random(2)
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, reference = packing.encoder(path), Tokenizer.from_file(path)
    latin = [chr(c) for c in range(256)] + list("   abcdefg'stlmrevd\n\t 123 ") * 8
    for k in range(4000):
        text = "".join(rng.choices(latin + (["中", "’", "ß"] if k % 4 == 0 else []), k=rng.randint(1, 40)))
        assert encode(text).tolist() == reference.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("blank", [" ", "\n", "\x85"])
def test_long_blank_runs(blank):
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "a b" + blank * 1_000_100 + "c d"
    assert packing.encoder(path)(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


# ------------------------------------------------------------------ pipeline
def test_pipeline(spark):
    from test_dedup import brute_components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "src1", 0), (10**6 + 1, "123", "en", "src1", 3), (10**6 + 2, docs.first().text, "en", "src1", 1)], docs.schema)
    docs = docs.unionByName(extra)
    rows, kept = {r.doc_id: r.text for r in docs.collect()}, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.staged(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == before.columns
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        if name == "language":
            assert set(rows) - set(ids) == {10**6, 10**6 + 1}
        if name == "exact":
            last = {}
            for i in kept:
                last[rows[i]] = max(i, last.get(rows[i], i))
            assert sorted(ids) == sorted(last.values())
        if name == "near":
            component = brute_components([(i, rows[i]) for i in kept])
            assert sorted(ids) == sorted(i for i in kept if component[i][1] == i)
        if name == "mix":
            assert set(ids) <= set(kept) and max(Counter(ids).values()) <= 2
        kept = ids
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(p.length for p in pieces if p.start + p.length == p.doc_tokens and p.doc_id is not None) > 0
    ends = Counter(p.doc_id for p in pieces if p.start + p.length == p.doc_tokens)
    assert ends == Counter(kept)
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mix", "pack"]


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
