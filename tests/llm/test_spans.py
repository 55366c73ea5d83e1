"""Personal data and secrets: base spans against the plain patterns, and what the methods add."""

import hashlib
import random
import re

import pytest

from maskwright.llm import pii, secrets
from maskwright.llm.queries import QUERIES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def checksum(digits):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def pii_base(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 14 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and checksum(d)]
    return out + [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def secret_base(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    return out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]


def test_pii_base_is_the_patterns():
    rng = random.Random(1)
    for _ in range(40_000):
        t = "".join(rng.choices("a@.1+ -()2b9é", k=rng.randint(0, 40)))
        assert sorted(pii.base_spans(t)) == sorted(pii_base(t)), t


def test_secret_base_is_the_patterns():
    rng = random.Random(2)
    parts = ["password", "PassWd", "secret", "toKen", "apikey", "API_KEY", "'", '"', " ", ":", "=", "abc", "x9/+", "AKIA", "ABCDEFGH12345678", "0123456789ab", "deadbeef", "é", "\n", "ſecret", "toKen"]
    for _ in range(40_000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert sorted(secrets.base_spans(t, t.lower())) == sorted(secret_base(t)), t


@pytest.mark.parametrize("text", ["a." * 400_000 + "@x", "1" * 700_000, "1 " * 30_000, "+1" * 300_000, "a@" * 200_000, "password" + " " * 500_000, "token" * 100_000, "0123456789abcdef01234" + "g0" * 200_000])
def test_long_texts_take_linear_time(text):
    pii.base_spans(text)
    secrets.finder(b"")(text)


EXAMPLES = ["call +1 (487) 555-7209 now", "ip 110.20.30.41 here", "card 4111111111111111 ok", "mail a.b@mail1.example.com x", "n 12345678 y", "v 300.100.2.3 z", "card 4111111111111112 ok",
            "on 2024-01-02 10:11", "id 4111 1111 1111 1112"] * 20


def field():
    gold = {t: {(a, k, b) for a, k, b in pii.base_spans(t)} for t in EXAMPLES}
    return pii.Field().fit([(run, gold[t]) for t in EXAMPLES for run in pii.runs(t) if run.segments])


def test_field_sums_all_segmentations():
    """Certainties against listing every segmentation of a short run."""
    f = field()
    run = next(iter(pii.runs("+1 (487) 555-7209")))
    segments, n = f.scores(run), len(run.bounds) - 1

    def ways(at, last):
        if at == n:
            yield 0.0, ()
        for i, j, y, s, _ in segments:
            if i == at:
                for score, rest in ways(j, y):
                    yield f.next[last, y] + s + score, ((i, j, y), *rest)

    import numpy as np
    listed = list(ways(0, pii.NOTHING))
    weight = np.exp([s for s, _ in listed])
    for i, j, y, _, p in f.certainties(run):
        want = sum(w for w, (_, path) in zip(weight, listed) if (i, j, y) in path) / weight.sum()
        assert abs(p.sum() - want) < 1e-9
    best = max(listed)[1]
    assert f.best(run) == [s for s in best if s[2] != pii.NOTHING]


def test_field_adds_what_resembles_base_spans_only():
    find = pii.finder(field())
    assert find("write joe [at] mail.example.com")[1] == [(6, 0, 31)]
    for clean in ["on 2024-01-02 10:11", "n 12345678 y", "a@b", "x [at] y", "pi is 3.14159265358979", "card 4111111111111112 ok"]:
        assert find(clean) == ([], [])


def test_pii_rows(spark):
    rows = [(1, EXAMPLES[0]), (2, None), (3, ""), (None, "é a.b@c.de"), (1, EXAMPLES[0]), (4, "clean"), (5, "10.0.0.1 10.0.0.2")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, spans int")
    for model in (pii.train(docs), pii.Field()):
        got = sorted(map(tuple, pii.find_pii(docs, model).collect()), key=repr)
        want = []
        for i, t in rows:
            base = sorted(pii_base(t or ""))
            text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
            want.append((i, *[sum(s[1] == k for s in base) for k in range(4)], hashlib.sha256(text.encode()).hexdigest(), text))
        assert got == sorted(want, key=repr)
    assert pii.find_pii(docs.limit(0), pii.train(docs.limit(0))).count() == 0


def test_secret_novelty(spark):
    words = b"configure server client value password token deploy"
    find = secrets.finder(words)
    assert find("bearer: eyJhbGciOi7x9QzKpL2mN8vR4tY6wB1cD3fG5")[1] == [(8, 3, 45)]
    for clean in ["key = configure_server_client_value", "private key path /home/user/configure/server2/client", "key aaaaaaaaaaaaaaaaaaaaaaa1", "no words here 8fK2"]:
        assert find(clean)[1] == [], clean
    # a string already in the text around costs little
    name = "x7Qp9Zr2Lm5Vt8Kw3"
    assert find(f"use {name} and {name}; key = {name}")[1] == []
    rows = [(1, "pwd: Xk29fLq8ZmP3vNt7"), (2, None), (3, ""), (None, "token = abcdefgh"), (1, "pwd: Xk29fLq8ZmP3vNt7"), (4, "é secret=hunter22 0123456789abcdef01234567")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_hex int")
    got = sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.spans) for r in secrets.find_secrets(docs, secrets.identifiers(docs)).collect()), key=repr)
    assert got == sorted([(1, 0, 0, 0, "novel:5:21")] * 2 + [(2, 0, 0, 0, ""), (3, 0, 0, 0, ""), (None, 1, 0, 0, "assign:0:16"), (4, 1, 0, 1, "assign:2:17,hex:18:42")], key=repr)
    assert secrets.find_secrets(docs.limit(0), secrets.identifiers(docs.limit(0))).count() == 0


SECRET_WORDS = b"configure server client value password token deploy " * 60


@pytest.mark.parametrize("size", [633, 1067, 200_000])
def test_long_secrets_are_reported_whole(size):
    rng = random.Random(size)
    run = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", k=size))
    find = secrets.finder(SECRET_WORDS)
    assert find(f"Authorization: Bearer {run} end")[1] == [(22, 3, 22 + size)]
    # a base span inside does not hide the rest
    inside = f"{run}token=abcdef"
    assert (22, 3, 22 + len(inside)) in find(f"Authorization: Bearer {inside} end")[1]


@pytest.mark.parametrize("size", [64, 80, 96, 128, 512, 2000])
def test_upper_case_hexadecimal_keys(size):
    find = secrets.finder(SECRET_WORDS)
    for seed in range(20):
        key = "".join(random.Random(seed).choices("0123456789ABCDEF", k=size))
        assert find(f"signing key: {key}")[1] == [(13, 3, 13 + size)], (size, seed)
    for clean in ["configure_server2_" * 20, "A1" * 300, "x" * 200 + "1"]:
        assert find(f"signing key: {clean}")[1] == [], clean


def test_op6_reads_whole_texts(spark, tmp_path):
    """The query itself runs, over null, empty and repeated rows."""
    rows = [(1, "password: hunter22"), (2, None), (3, ""), (1, "password: hunter22"), (None, "AKIA" + "A" * 16)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES["op6_zstd_secrets"](spark, str(tmp_path)).select("doc_id", "n_assign", "n_access", "n_hex").collect()), key=repr)
    assert got == sorted([(1, 1, 0, 0)] * 2 + [(2, 0, 0, 0), (3, 0, 0, 0), (None, 0, 1, 0)], key=repr)


def test_op9_reads_whole_texts(spark, tmp_path):
    """The query itself runs, over null, empty and repeated rows."""
    rows = [(1, "mail a.b@c.de"), (2, None), (3, ""), (1, "mail a.b@c.de"), (None, "10.0.0.1 10.0.0.2")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES["op9_semicrf_pii"](spark, str(tmp_path)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone").collect()), key=repr)
    assert got == sorted([(1, 1, 0, 0, 0)] * 2 + [(2, 0, 0, 0, 0), (3, 0, 0, 0, 0), (None, 0, 2, 0, 0)], key=repr)
