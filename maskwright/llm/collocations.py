"""Collocations: phrases whose words occur together more often than their parts would by chance, counted in quotient filters.

Texts, with A-Z as a-z, are cut at ``.,;:!?`` and bytes 10 to 13 into pieces, and those at space and tab into words. Per language, a
phrase of 2 to ``longest`` words with ``least`` occurrences or more is a candidate. Cutting it in two, with ``l`` and ``r`` occurrences
of the parts, scores ``floor(1000 * a * n / (l * r))``; the lowest cut counts, the first of equal ones. Phrases that a longer candidate
contains whenever they occur are left out.

Passes over the text, each a map over rows and one shuffle:

1. Words are counted exactly; those that occur ``least`` times or more, as every word of a candidate does, get numbers.
2. Texts are written as numbers, other words and ends of pieces as 0.
3. Pairs, then threes, then fours and fives are packed, permuted and counted in sorted quotient filters (``quotient_filter``) by every
   task; the filters travel by quotient and are merged. An n-gram is counted only where the (n - 1)-grams in it are frequent, which a
   Bloom filter of fixed size tells: where it errs, more is counted, the result is the same.

Numbers are looked up in a dictionary that is sent to the tasks where it has at most ``dictionary`` words; a larger one is joined to the
words of the texts. Buckets grow in number with the text, so a task's memory does not. Scores are exact: products are decimals.

Defined results: a null language is ``und``, as is the language of that name; a null text is empty. Bytes that are no UTF-8 count as
U+FFFD. Each row counts, also where ids or texts repeat. Without candidates there are no rows. Other columns may have any names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from maskwright.functions.expr import valid_utf8
from maskwright.llm import bloom
from maskwright.llm.common import pieces, release_memory, staged
from maskwright.llm.quotient_filter import Layout
from maskwright.llm.shingles import mix

LEAST = 100
LONGEST = 5
TOP = 2000
DICTIONARY = 1 << 19  # words that are sent to every task
HELD_WORDS = 1 << 18  # distinct words that a counting task holds
FLUSH = 1 << 21  # n-grams that a counting task holds
ROW = 1 << 18  # numbers in a row of the written texts
BUCKET = 1 << 20  # words of text per bucket

_U = np.uint64
#: Every end of a piece becomes a full stop, every blank a space.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz ..........")


def _tokens(text: bytes) -> list[bytes]:
    """Words, and a full stop where a piece ends."""
    return text.translate(_FOLD).replace(b".", b" . ").split()


# ------------------------------------------------------------------ words
def _count_words(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, word, c), and for each language one without a word for all of them."""
    held: dict[str, Counter] = {}

    def flush():
        rows = [(lang, w, c) for lang, words in held.items() for w, c in [(None, sum(words.values())), *words.items()]]
        held.clear()
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary()).cast(pa.string()),
                                           pa.array(columns[2], pa.int64())], names=["lang", "word", "c"])
    try:
        for b in pieces(frames, "text"):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                held.setdefault(lang, Counter()).update(text.as_py().translate(_FOLD).replace(b".", b" ").split())
            if sum(map(len, held.values())) >= HELD_WORDS:
                yield flush()
        if held:
            yield flush()
    finally:
        held.clear()
        release_memory()


def _numbered(words: DataFrame) -> DataFrame:
    """Frequent words with dense numbers from 1: by partition, then place, from the sizes of the partitions."""
    words = staged(words.withColumn("at", F.monotonically_increasing_id()), "collocations-words")
    part = F.shiftright("at", 33)
    sizes = sorted(tuple(r) for r in words.groupBy(part.alias("p")).count().collect())
    starts = np.concatenate([[1], np.cumsum([c for _, c in sizes], dtype=np.int64)]).tolist()
    offsets = words.sparkSession.createDataFrame([(int(p), s) for (p, _), s in zip(sizes, starts)], "p long, start long")
    return words.withColumn("p", part.cast("long")).join(F.broadcast(offsets), "p").select(
        "lang", "word", F.col("c").alias("f"), (F.col("start") + F.expr("at & 8589934591")).alias("id"))


# ------------------------------------------------------------------ texts as numbers
def _encode(shared):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, size = shared.value, [], 0

        def flush():
            ids = np.concatenate(held)
            ids = ids[(ids > 0) | (np.append(0, ids[:-1]) > 0)]  # one 0 stands for many
            return pa.RecordBatch.from_arrays([pa.array([ids.astype("<u4").tobytes()], pa.binary())], names=["ids"])
        try:
            for b in pieces(frames, "text"):
                for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                    known = numbers.get(lang)
                    if known:
                        tokens = _tokens(text.as_py())
                        tokens.append(b".")
                        held.append(np.fromiter((known.get(w, 0) for w in tokens), np.uint32, len(tokens)))
                        size += len(tokens)
                        if size >= ROW:
                            yield flush()
                            held, size = [], 0
            if size:
                yield flush()
        finally:
            release_memory()
    return run


def _encode_by_join(rows: DataFrame, words: DataFrame) -> DataFrame:
    """The same with a join: for dictionaries that are too large to be sent."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.regexp_replace(F.translate("text", upper, upper.lower()), r"[.,;:!?\x0A-\x0D]", " . ")
    tokens = F.filter(F.split(plain, r"[\x20\x09]+"), lambda w: w != "")
    each = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "lang", F.posexplode(tokens).alias("at", "word"))
    met = each.join(words.select("lang", "word", "id"), ["lang", "word"], "left").select("row", "at", F.coalesce("id", F.lit(0)).alias("id"))
    texts = met.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("t")).select(F.expr("transform(t, x -> x.id)").alias("ids"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            yield pa.RecordBatch.from_arrays([pa.array([np.array([*x, 0], "<u4").tobytes() for x in b.column(0).to_pylist()], pa.binary())], names=["ids"])
    return texts.mapInArrow(run, "ids binary")


# ------------------------------------------------------------------ n-grams
def _hash(words: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(words[0]), _U)
    for w in words:
        h = mix(h * _U(0x9E3779B97F4A7C15) + w.astype(_U) + _U(1))
    return h.view(np.int64)


def _count_grams(sizes: list[int], bits: int, quotient: int, known: int, shared):
    """Filters of the n-grams of each size, by bucket. ``shared``: Bloom filter of the frequent ones of ``known`` words."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layouts = {k: Layout(k, bits, quotient) for k in sizes}
        held: dict[int, list] = {k: [] for k in sizes}
        size = dict.fromkeys(sizes, 0)

        def flush(k):
            layout = layouts[k]
            packed = [np.concatenate([h[j] for h in held[k]]) for j in range(len(layout.width))]
            rows = layout.buckets(*layout.counted(layout.permute(packed)))
            held[k].clear()
            size[k] = 0
            return pa.RecordBatch.from_arrays([pa.array([k] * len(rows), pa.int32()), pa.array([q for q, _ in rows], pa.int64()),
                                               pa.array([b for _, b in rows], pa.binary())], names=["k", "bucket", "filter"])
        try:
            for b in frames:
                for blob in b.column(0):
                    ids = np.frombuffer(blob.as_py(), "<u4")
                    if len(ids) < known:
                        continue
                    places = np.lib.stride_tricks.sliding_window_view(ids, known)
                    at = np.flatnonzero((places > 0).all(axis=1))
                    if shared is not None:
                        at = at[bloom.found(shared.value, _hash([ids[at + j] for j in range(known)]))]
                    often = np.zeros(len(ids) + max(sizes), bool)
                    often[at] = True
                    for k in sizes:
                        first = at[np.all([often[at + j] for j in range(k - known + 1)], axis=0)]
                        if len(first):
                            held[k].append(layouts[k].pack([ids[first + j] for j in range(k)]))
                            size[k] += len(first)
                            if size[k] >= FLUSH:
                                yield flush(k)
            for k in sizes:
                if size[k]:
                    yield flush(k)
        finally:
            release_memory()
    return run


def _merge(bits: int, quotient: int, least: int):
    def whole(frames):
        now, held = None, []
        for b in frames:
            for k, bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if (k, bucket) != now:
                    if held:
                        yield *now, held
                    now, held = (k, bucket), []
                held.append(blob.as_py())
        if held:
            yield *now, held

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets come whole: the n-grams that occur often enough."""
        try:
            for k, bucket, blobs in whole(frames):
                layout = Layout(k, bits, quotient)
                limbs, n = layout.merged(bucket, blobs)
                often = n >= least
                if often.any():
                    words = layout.unpack(layout.restore([x[often] for x in limbs]))
                    flat = pa.array(np.stack(words, axis=1).reshape(-1).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(len(words[0]) + 1, dtype=np.int32) * k, flat),
                                                      pa.array(n[often]), pa.array(_hash(words))], names=["w", "f", "h"])
        finally:
            release_memory()
    return run


def _frequent(texts: DataFrame, sizes: list[int], bits: int, quotient: int, least: int, known: int, before: DataFrame | None) -> DataFrame:
    """(w, f, h): the n-grams of these sizes that occur ``least`` times or more."""
    shared = None if before is None else texts.sparkSession.sparkContext.broadcast(bloom.table_of(before.select("h")))
    filters = texts.mapInArrow(_count_grams(sizes, bits, quotient, known, shared), "k int, bucket long, filter binary")
    merged = (filters.repartition(1 << quotient, "k", "bucket").sortWithinPartitions("k", "bucket")
              .mapInArrow(_merge(bits, quotient, least), "w array<long>, f long, h long"))
    out = staged(merged, "collocations-grams")
    if shared is not None:
        shared.unpersist()
    return out


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST,
                  dictionary: int = DICTIONARY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (lang, word, f, id) and phrases (w: ids, f) that occur ``least`` times or more, and (lang, n) of all words."""
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("raw")).select("lang", F.expr(valid_utf8("raw")).alias("text"))
    counts = rows.mapInArrow(_count_words, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c"))
    counts = staged(counts.where(F.col("word").isNull() | (F.col("c") >= least)), "collocations-counts")
    total = counts.where("word IS NULL").select("lang", F.col("c").alias("n"))
    words = staged(_numbered(counts.where("word IS NOT NULL")), "collocations-numbers")

    n_words, known = total.agg(F.sum("n")).first()[0] or 0, words.count()
    if known <= dictionary:
        numbers: dict[str, dict[bytes, int]] = {}
        for lang, word, _, number in words.toLocalIterator():
            numbers.setdefault(lang, {})[word.encode()] = number
        shared = docs.sparkSession.sparkContext.broadcast(numbers)
        texts = staged(rows.mapInArrow(_encode(shared), "ids binary"), "collocations-texts")
        shared.unpersist()
    else:
        texts = staged(_encode_by_join(rows, words), "collocations-texts")

    bits, quotient = max(1, known.bit_length()), max(3, (n_words // BUCKET).bit_length())
    count = lambda sizes, known, before: _frequent(texts, sizes, bits, quotient, least, known, before)
    grams = [count([2], 2, None)]
    if longest >= 3:
        grams.append(count([3], 2, grams[0]))
    if longest >= 4:
        grams.append(count(list(range(4, longest + 1)), 3, grams[1]))
    phrases = grams[0]
    for g in grams[1:]:
        phrases = phrases.unionByName(g)
    return words, phrases.select("w", "f"), total


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP,
                 dictionary: int = DICTIONARY) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    words, phrases, total = phrase_counts(docs, text_col, lang_col, least, longest, dictionary)

    # a phrase that some longer one always surrounds: then one that is longer by a word does
    inner = phrases.where("size(w) > 2")
    inner = inner.select(F.expr("slice(w, 1, size(w) - 1)").alias("w"), "f").unionByName(inner.select(F.expr("slice(w, 2, size(w) - 1)").alias("w"), "f"))
    kept = staged(phrases.join(inner.distinct(), ["w", "f"], "left_anti"), "collocations-kept")

    spelled = (kept.select("w", F.posexplode("w").alias("at", "id")).join(words.select("id", "word", "lang"), "id").groupBy("w")
               .agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("t"), F.first("lang").alias("lang"))
               .select("w", "lang", F.expr("array_join(transform(t, x -> x.word), ' ')").alias("phrase")))

    parts = words.select(F.array("id").alias("w"), "f").unionByName(phrases)
    cuts = kept.select("w", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k")).select(
        "w", "a", "k", F.expr("slice(w, 1, k)").alias("first"), F.expr("slice(w, k + 1, size(w) - k)").alias("rest"))
    halves = (cuts.join(parts.select(F.col("w").alias("first"), F.col("f").alias("l")), "first")
              .join(parts.select(F.col("w").alias("rest"), F.col("f").alias("r")), "rest"))
    scored = (halves.join(spelled, "w").join(total, "lang")
              .withColumn("score", F.expr("(CAST(1000 * a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"))
              .groupBy("lang", "w", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
              .select("lang", "phrase", "a", "n", "cut.l", "cut.r", "cut.score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")))
