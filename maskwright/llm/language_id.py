"""Language identification by prediction by partial matching (PPM).

Each language has a context tree of byte counts up to ``ORDER`` preceding bytes. A byte costs ``-log2(c / (n + d))`` in the
longest context that has seen it (``c`` times, of ``n`` bytes with ``d`` different ones), plus ``-log2(d / (n + d))`` for each
longer context that had to be escaped from; a byte new to a language costs 8 bits after the last escape. Counts are frozen
after training. A text belongs to the language that codes it shortest, and the score is that language's share of
``2 ** -bits`` over all languages.

Trees are fitted on a sample of whole texts: per language the training texts of at most ``SAMPLE_BYTES`` bytes by the hash of the
id, then the longer ones, up to ``SAMPLE_DOCS`` texts and until they hold ``SAMPLE_DOCS * SAMPLE_BYTES`` bytes. The first text always
counts, so that every language with a text is learned. Every text is scored whole. The trees of all languages share one table of n-grams, so
that the cost of a byte in all languages is the sum of two table rows: the escapes of the longest known context, and
the cost of the longest known n-gram less the escapes below it.

Defined results: a null text, or one without letters, is ``und`` with score 0; so is every text if there is nothing to learn
from. Equal code lengths go to the first language by code point. Rows are independent: repeated rows get equal results.
Letters A-Z count as a-z. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from maskwright.llm.common import handed_back, pieces, send, staged, text_buffer

ORDER = 3
SAMPLE_DOCS = 256
SAMPLE_BYTES = 16_384
CHUNK = 1 << 18
UNDETERMINED = "und"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def padded(data: np.ndarray, offsets: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with ``pad`` zero bytes before each text, and where each text's pad begins (one more entry)."""
    starts = offsets + pad * np.arange(len(offsets))
    out = np.zeros(starts[-1], np.uint8)
    shift = np.repeat(pad * np.arange(1, len(offsets)), np.diff(offsets))
    out[np.arange(len(data)) + shift] = _FOLD[data]
    return out, starts


def _grams(buffer: np.ndarray, width: int) -> np.ndarray:
    """At each place the last ``width`` bytes as one number; the first places lack some."""
    g = np.zeros(len(buffer), np.uint64)
    for back in range(width):
        g[back:] |= buffer[: len(buffer) - back].astype(np.uint64) << np.uint64(8 * back)
    return g


def _counter(order: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            langs = np.array(b.column(0).to_pylist(), dtype=object)
            for lang in dict.fromkeys(langs):
                data, offsets = text_buffer(b.column(1).filter(pa.array(langs == lang)))
                buffer, starts = padded(data, offsets, order)
                own = np.ones(len(buffer), bool)
                for k in range(order):
                    own[starts[:-1] + k] = False
                for a in range(0, len(buffer), CHUNK):
                    lead = min(a, order)
                    grams = _grams(buffer[a - lead : a + CHUNK], order + 1)[lead:]
                    gram, n = np.unique(grams[own[a : a + CHUNK]], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))],
                        names=["lang", "gram", "n"])
    return run


class Trees:
    """Context trees of all languages. ``grams``: lang -> (n-grams of order + 1 bytes, counts)."""

    def __init__(self, grams: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        self.order, self.langs = order, sorted(grams)
        n_langs = len(self.langs)
        every = np.unique(np.concatenate([g for g, _ in grams.values()] + [np.zeros(1, np.uint64)]).astype(np.uint64))
        counts = np.zeros((len(every), n_langs))
        for k, lang in enumerate(self.langs):
            g, n = grams[lang]
            counts[np.searchsorted(every, g.astype(np.uint64)), k] += n
        # n-grams of each length with their counts; the context of every n-gram is there too
        keys, tables = [None] * (order + 2), [None] * (order + 2)
        keys[order + 1], tables[order + 1] = every, counts
        for d in range(order, 0, -1):
            mask = np.uint64((1 << (8 * d)) - 1)
            own, at = np.unique(keys[d + 1] & mask, return_inverse=True)
            sums = np.zeros((len(own), n_langs))
            np.add.at(sums, at, tables[d + 1])
            contexts = np.unique(keys[d + 1] >> np.uint64(8))
            keys[d] = np.union1d(own, contexts)
            tables[d] = np.zeros((len(keys[d]), n_langs))
            tables[d][np.searchsorted(keys[d], own)] = sums
        symbols = keys[1].astype(np.int64)
        self.symbol = np.zeros(256, np.int32)  # 0: a byte that no language has
        self.symbol[symbols] = np.arange(1, len(symbols) + 1)
        width = len(symbols) + 1
        # rows of the tables below: 0 stands for no n-gram at all, then all n-grams by length
        first = np.cumsum([1] + [len(k) for k in keys[1:]])
        escape = np.zeros((first[-1], n_langs))  # escapes from an n-gram as context, and from all its shorter ones
        cost = np.zeros((first[-1], n_langs))
        cost[0] = 8.0
        self.child = [None]
        for d in range(1, order + 2):
            parent = np.zeros(len(keys[d]), np.int64) if d == 1 else first[d - 2] + np.searchsorted(keys[d - 1], keys[d] >> np.uint64(8))
            suffix = np.zeros(len(keys[d]), np.int64) if d == 1 else (
                first[d - 2] + np.searchsorted(keys[d - 1], keys[d] & np.uint64((1 << (8 * (d - 1))) - 1)))
            n, kinds = np.zeros((first[-1], n_langs)), np.zeros((first[-1], n_langs))
            np.add.at(n, parent, tables[d])
            np.add.at(kinds, parent, tables[d] > 0)
            leave = np.where(n > 0, -np.log2(np.maximum(kinds, 1e-300) / np.maximum(n + kinds, 1e-300)), 0.0)
            # escapes of the contexts of this length: those of the next shorter context are known
            if d == 1:
                escape[0] = leave[0]
            else:
                rows = np.arange(first[d - 2], first[d - 1])
                shorter = np.zeros(len(rows), np.int64) if d == 2 else (
                    first[d - 3] + np.searchsorted(keys[d - 2], keys[d - 1] & np.uint64((1 << (8 * (d - 2))) - 1)))
                escape[rows] = leave[rows] + escape[shorter]
            with np.errstate(divide="ignore"):
                seen = -np.log2(tables[d] / np.maximum((n + kinds)[parent], 1e-300))
            below = np.full((len(keys[d]), n_langs), 8.0) if d == 1 else cost[suffix]
            cost[first[d - 1] : first[d]] = np.where(tables[d] > 0, seen, leave[parent] + below)
            if d > 1:
                table = np.zeros((first[d - 1], width), np.int32)
                table[parent, self.symbol[(keys[d] & np.uint64(255)).astype(np.int64)]] = np.arange(first[d - 1], first[d])
                self.child.append(table.ravel())
        adjusted = cost.copy()
        for d in range(1, order + 2):
            rows = np.arange(first[d - 1], first[d])
            parent = np.zeros(len(rows), np.int64) if d == 1 else first[d - 2] + np.searchsorted(keys[d - 1], keys[d] >> np.uint64(8))
            adjusted[rows] -= escape[parent]
        self.width, self.escape, self.cost = width, escape.astype(np.float32), adjusted.astype(np.float32)

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of every text in every language."""
        total = np.zeros((len(offsets) - 1, len(self.langs)))
        buffer, starts = padded(data, offsets, self.order)
        for a in range(0, len(buffer), CHUNK):
            lead = min(a, self.order + 1)
            part = buffer[a - lead : a + CHUNK]
            s = self.symbol[part]
            node = s.astype(np.int32)  # n-gram ending here, of growing length; 0 if unknown
            longest = context = node
            for d in range(2, self.order + 2):
                before = np.concatenate([np.zeros(1, np.int32), node[:-1]])
                node = self.child[d - 1].take(before.astype(np.int64) * self.width + s)
                node[before == 0] = 0
                if d == self.order + 1:
                    context = longest
                longest = np.where(node > 0, node, longest)
            context = np.concatenate([np.zeros(1, np.int32), context[:-1]])
            bits = self.escape.take(context, axis=0) + self.cost.take(longest, axis=0)
            # texts that have bytes in this part, their pads left out
            lo = np.clip(starts[:-1] + self.order - (a - lead), lead, len(part))
            hi = np.clip(starts[1:] - (a - lead), lead, len(part))
            own = np.flatnonzero(hi > lo)
            if len(own):
                edges = np.stack([lo[own], hi[own]], axis=1).ravel()
                padded_bits = np.concatenate([bits, np.zeros((1, bits.shape[1]), np.float32)])
                total[own] += np.add.reduceat(padded_bits, edges, axis=0, dtype=np.float64)[::2]
        return total

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language (its number) and score of every text."""
        bits = self.bits(data, offsets)
        best = bits.argmin(axis=1)
        share = np.exp2(bits.min(axis=1, keepdims=True) - bits)
        return best, 1.0 / share.sum(axis=1)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER,
          sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Trees:
    """Fit the trees on the sample; rows without text or language are left out. The driver gets its n-gram counts."""
    rows = labelled.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"),
                           F.xxhash64(F.col(f"`{id_col}`").cast("string")).alias("h"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("size", F.octet_length("text").cast("long"))
    rows = rows.withColumn("place", F.struct((F.col("size") > sample_bytes).alias("over"), "h"))
    in_order = Window.partitionBy("lang").orderBy("place")
    ranked = rows.select("lang", "place", "size").withColumn("r", F.row_number().over(in_order)).where(F.col("r") <= sample_docs)
    before = F.coalesce(F.sum("size").over(Window.partitionBy("lang").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    enough = ranked.withColumn("before", before).where((F.col("r") == 1) | (F.col("before") < sample_docs * sample_bytes))
    chosen = staged(enough.groupBy("lang").agg(F.max("place").alias("top")), "language-sample")
    sample = rows.join(F.broadcast(chosen), "lang").where("place <= top").select("lang", "text")
    counts = sample.mapInArrow(handed_back(_counter(order)), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return Trees({lang: (g["gram"].to_numpy(np.int64), g["n"].to_numpy()) for lang, g in counts.groupby("lang")}, order)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _predictor(shared, text_at: int, letter_at: int):
    """Batches to (batch, languages, scores)."""
    def run(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        trees = shared.value
        letters = b.column(letter_at).to_numpy(zero_copy_only=False).astype(bool)
        if not trees.langs:
            return np.full(b.num_rows, UNDETERMINED, object), np.zeros(b.num_rows)
        best, score = trees.predict(*text_buffer(b.column(text_at)))
        langs = np.array(trees.langs, dtype=object)[best]
        langs[~letters] = UNDETERMINED
        return langs, np.where(letters, score, 0.0)
    return run


def predict(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, the columns of ``extra``, lang_pred, score."""
    extra = extra or {}
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), *[c.alias(k) for k, c in extra.items()], has_letter(text).alias("__letter"), text.alias("__text"))
    n = len(rows.columns)
    call = _predictor(send(docs.sparkSession, trees), n - 1, n - 2)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2]) + ", lang_pred string, score double"

    def run(frames):
        for b in pieces(frames, "__text"):
            langs, score = call(b)
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(langs, pa.string()), pa.array(score)],
                                             names=[*b.schema.names[:-2], "lang_pred", "score"])
    return rows.mapInArrow(handed_back(run), schema)


def keep_identified(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """The documents in a language, with all their columns; those that are ``und`` go."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # by place: names may be odd
    rows = docs.toDF(*names)
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    rows = rows.select(*names, has_letter(F.col(names[at])).alias("letter"))
    call = _predictor(send(docs.sparkSession, trees), at, len(names))

    def run(frames):
        for b in pieces(frames, names[at]):
            langs, _ = call(b)
            kept = pa.RecordBatch.from_arrays(b.columns[:-1], names=b.schema.names[:-1])
            yield kept.filter(pc.not_equal(pa.array(langs, pa.string()), UNDETERMINED))
    return rows.mapInArrow(handed_back(run), docs.toDF(*names).schema).toDF(*docs.columns)
