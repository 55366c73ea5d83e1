"""Periodic runs in word sequences, by an online sparse diagonal dynamic program.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are equal) and at least
``max(least, 3 * q)`` words, which no neighbouring word extends. On the diagonal of lag ``q`` it is an unbroken row of matches.

Words are taken in order. Each one's earlier occurrences increment the match lengths of their lags; a lag whose diagonal is not
continued by the next word has ended, and emits its run at once if that is long enough. What keeps this sparse is which earlier
occurrences can matter: for lags in ``(k / 2, k]``, with ``k`` a power of two, a word counts as occurring earlier only with the
``k - 1`` words after it, and only its nearest such occurrence counts. Nothing is lost by that:

- where ``k`` words match at a lag ``d <= k``, the words from there have the smallest period ``d`` or the nearest occurrence would be
  nearer (two periods of a stretch as long as their sum have their greatest common divisor as a period), so multiples of a period never
  become active;
- inside a run of period ``q`` with ``k / 2 < q <= k``, the nearest occurrence is always ``q`` back, from its ``q``-th word until ``k``
  words before its end, so its diagonal is active without a gap, and only there.

Occurrences of ``k`` words are named exactly, by pairs of names of ``k / 2`` words, and only where both halves occur elsewhere too; no
hashes are involved. A word has a logarithmic number of active lags, so cost is near linear also in texts of one repeated word.

Defined results: a null or empty text, or one of blanks, has no words and no runs. Words are compared exactly, case included. Every
row is a document of its own, also where ids repeat or are null. Other columns may have any names. A text is held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from maskwright.llm.common import pieces, release_memory

LEAST = 24
REPEATS = 3
RUN_TYPE = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _earlier(names: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words and the lags of their earlier occurrences, for lags up to 1, 2, 4, ..."""
    n, k = len(names), 1
    at = np.arange(n)
    while len(at) and k // 2 < n // REPEATS:
        order = np.argsort(names, kind="stable")
        ranked, place = names[order], at[order]
        same = ranked[1:] == ranked[:-1]
        here, lag = place[1:][same], (place[1:] - place[:-1])[same]
        near = (lag > k // 2) & (lag <= k)
        yield here[near], lag[near]
        # names of twice the length, where both halves occur more than once
        more = np.append(same, False) | np.append(False, same)
        if not more.any():
            return
        short = np.full(n, -1, np.int64)
        short[place[more]] = np.cumsum(np.append(True, ~same))[more]
        at = np.flatnonzero(short[: max(0, n - k)] >= 0)
        second = short[at + k]
        at, second = at[second >= 0], second[second >= 0]
        names, k = short[at] * (n + 1) + second, 2 * k


def runs(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run, by start, then period."""
    if len(words) < least:
        return []
    number: dict = {}
    found = list(_earlier(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))))
    at, lag = (np.concatenate([f[j] for f in found]) for j in (0, 1))
    order = np.argsort(at, kind="stable")
    out: list[tuple[int, int, int]] = []
    active: dict[int, tuple[int, int]] = {}  # lag: first word of its diagonal, next word that continues it

    def end(q: int) -> None:
        first, due = active.pop(q)
        length = due - first + (1 << (q - 1).bit_length()) - 1 + q
        if length >= max(least, REPEATS * q):
            out.append((first - q, length, q))

    now = -1
    for i, q in zip(at[order].tolist(), lag[order].tolist()):
        if i != now:
            for old in [q for q, (_, due) in active.items() if due < i]:
                end(old)
            now = i
        active[q] = (active[q][0] if q in active else i, i + 1)
    for old in list(active):
        end(old)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without those that any run contains after its first period, joined by one space."""
    if not found:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per document: id, n_words, runs (start, length, period; by start, then period), and its collapsed text."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in pieces(frames, "text"):
                n, found, texts = [], [], []
                for value in b.column(1).cast(pa.binary()):
                    words = (value.as_py() or b"").split()  # on exactly space and bytes 9 to 13
                    own = runs(words, least)
                    n.append(len(words))
                    found.append([{"start": s, "length": m, "period": q} for s, m, q in own])
                    texts.append(collapsed(words, own))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(found, kind), pa.array(texts, pa.binary()).cast(pa.string())],
                                                 names=["doc_id", "n_words", "runs", "collapsed"])
        finally:
            release_memory()

    key = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {key}, n_words bigint, runs {RUN_TYPE}, collapsed string").withColumnRenamed("doc_id", id_col)
