"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is its bytes and an end mark; every byte is coded as eight bits, from the high one. For each order from 0 to ``ORDER`` a
predictor looks up how often the bit was 0 and 1 after the same preceding bytes and the same bits of this byte: contexts are
hashed into a table of fixed size. The stretched probabilities are combined by weights; which set of weights is used is gated
by the longest context that has been seen and how often. The mixed probability is refined by an adaptive map from it, under the
bits of the byte so far, to what was observed. Score: log10 of the probability of the whole text.

Counts come from all training texts: tasks count distinct byte windows, and one task per bucket of contexts adds them up. Weights
and map are learned online from all training texts too, in one stream per bucket: every distinct window is predicted from the counts
without one occurrence of it, and counts as often as it occurs. The streams' weights and maps are then averaged, each set of weights and
each cell by how often it was used. All texts are scored under frozen statistics, so results do not depend on how rows are spread. A
window's cost is computed once per task while it is held.

The base score is that of single words: log10((c + 1) / (N + V + 1)) summed over the words and one end. Words are counted as
64-bit hashes. The most frequent ones, ``TOP`` at most, are broadcast; the others of each text are sent to their counts, and only
sums come back.

Defined results: a null text counts as empty, and has one token, the end. A row without an id is not learned from and not held out.
Repeated rows get equal results, and count as often as they occur in training. Without training texts all counts are 0 and the
model gives every bit one half. Other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from maskwright.llm.common import done_with, handed_back, pieces, release_memory, send, staged, text_buffer, text_or_empty
from maskwright.llm.shingles import mix, word_hashes

ORDER = 5
MARK = 255  # pads the beginning and ends a text; no byte of UTF-8
BUCKETS = 64  # of contexts, by their last two bytes
SLOT_BITS = 18  # slots of a bucket: 2**24 slots in all, of two bytes when broadcast
PARTS = 16  # of a bucket's windows, learned from one after the other
TOP = 1 << 20
PIECE = 1 << 20  # bytes scored or counted at once
HELD = 2_000_000  # windows, or words, held by a task
WORD_BUCKET_BYTES = 1 << 25  # bytes of text per bucket of words

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15


# ------------------------------------------------------------------ windows and contexts
def stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with marks: ORDER before and one after each. Also where each text's part begins (one more entry)."""
    n = len(offsets) - 1
    starts = offsets + (ORDER + 1) * np.arange(n + 1)
    out = np.full(starts[-1], MARK, np.uint8)
    out[np.arange(len(data)) + np.repeat(starts[:-1] + ORDER - offsets[:-1], np.diff(offsets))] = data
    return out, starts


def windows(buffer: np.ndarray, a: int, b: int) -> np.ndarray:
    """For places a to b the byte there (lowest) and the ORDER bytes before; ``a`` is ORDER at least."""
    part = buffer[a - ORDER : b].astype(np.uint64)
    key = np.zeros(b - a, np.uint64)
    for back in range(ORDER, -1, -1):
        key = (key << _U(8)) | part[ORDER - back : ORDER - back + (b - a)]
    return key


def _own(starts: np.ndarray, a: int, b: int) -> np.ndarray:
    """Whether places a to b are coded: not those that only pad."""
    own = np.ones(b - a, bool)
    for k in range(ORDER):
        at = starts[:-1] + k
        own[at[(at >= a) & (at < b)] - a] = False
    return own


def bucket_of(key: np.ndarray) -> np.ndarray:
    return (mix((key >> _U(8)) & _U(0xFFFF)) & _U(BUCKETS - 1)).astype(np.int64)


def places(key: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """For each bit of the last byte: its number, the bits, the node (bits so far), and the slots of orders 0 to ORDER.

    Orders 0 and 1 have tables of their own; the others share the slots of their bucket.
    """
    byte = (key & _U(255)).astype(np.int64)
    last = ((key >> _U(8)) & _U(255)).astype(np.int64)
    base = bucket_of(key) << SLOT_BITS
    hashes = [mix((key >> _U(8)) & _U((1 << (8 * k)) - 1) ^ _U(k << 56)) for k in range(2, ORDER + 1)]
    for j in range(8):
        node = (1 << j) | (byte >> (8 - j))
        tag = node.astype(np.uint64) * _U(_ODD)
        slots = [base | (((h ^ tag) * _U(0xD6E8FEB86659FD93)) >> _U(64 - SLOT_BITS)).astype(np.int64) for h in hashes]
        yield j, (byte >> (7 - j)) & 1, node, [node, (last << 8) | node, *slots]


# ------------------------------------------------------------------ counting
def _count(buckets: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct words (kind 0) and windows (kind 1) of training texts with their counts, by bucket."""
        def flush(kind, parts):
            key, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            codes, key = pd.factorize(key)
            n = np.bincount(codes, weights=n).astype("<u4")
            bucket = (key & _U(buckets - 1)).astype(np.int64) if kind == 0 else bucket_of(key)
            order = np.lexsort((key, bucket))
            bucket, key, n = bucket[order], key[order], n[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = [*cuts[1:], len(bucket)]
            return pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(cuts), pa.int32()), pa.array(bucket[cuts].astype(np.int32)),
                 pa.array([key[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()), pa.array([n[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary())],
                names=["kind", "bucket", "keys", "counts"])

        held: dict[int, list] = {0: [], 1: []}
        size = {0: 0, 1: 0}

        def add(kind, values):
            codes, key = pd.factorize(values)
            held[kind].append((key, np.bincount(codes)))
            size[kind] += len(key)
            if size[kind] > HELD:
                yield flush(kind, held[kind])
                held[kind], size[kind] = [], 0

        for b in pieces(frames, "text", 4 << 20):
            data, offsets = text_buffer(b.column(0))
            yield from add(0, word_hashes(data, offsets)[0])
            buffer, starts = stream(data, offsets)
            for a in range(0, len(buffer), PIECE):
                end = min(len(buffer), a + PIECE)
                begin = max(a, ORDER)
                if end > begin:
                    yield from add(1, windows(buffer, begin, end)[_own(starts, begin, end)])
        for kind in (0, 1):
            if held[kind]:
                yield flush(kind, held[kind])
    return run


def _add_windows(table: np.ndarray, low: np.ndarray, key: np.ndarray, n: np.ndarray, base: int = 0) -> None:
    """Add windows to counts: ``table`` (slots less ``base``) and ``low`` (orders 0 and 1: node, then last byte and node)."""
    for _, bit, node, slots in places(key):
        low[: 256] += np.bincount(node * 2 + bit, weights=n, minlength=512).reshape(256, 2)
        low[256:] += np.bincount(slots[1] * 2 + bit, weights=n, minlength=1 << 17).reshape(-1, 2)
        for s in slots[2:]:
            table += np.bincount((s - base) * 2 + bit, weights=n, minlength=table.size).reshape(-1, 2)


def _sum_up(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets come whole. Words: sorted with their counts. Windows: the bucket's slots and its part of the low orders, and (kind 2) the distinct ones by part."""
    names = ["kind", "bucket", "part", "keys", "counts"]

    def rows(kind, bucket, parts, keys, counts):
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(parts), pa.int32()), pa.array([bucket] * len(parts), pa.int32()), pa.array(parts, pa.int32()),
                                           pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=names)

    def done(kind, bucket, held, table, low):
        if kind == 0:
            key = np.concatenate([np.frombuffer(k, "<u8") for k, _ in held])
            codes, key = pd.factorize(key)
            n = np.bincount(codes, weights=np.concatenate([np.frombuffer(c, "<u4") for _, c in held])).astype("<i8")
            order = np.argsort(key)
            keys, counts = key[order].astype("<u8").tobytes(), n[order].tobytes()
        else:
            keys, counts = _shrink(table).tobytes(), low.astype("<f8").tobytes()
        return rows(kind, bucket, [0], [keys], [counts])

    def add(bucket, held, table, low):
        codes, key = pd.factorize(np.concatenate([np.frombuffer(k, "<u8") for k, _ in held]))
        n = np.bincount(codes, weights=np.concatenate([np.frombuffer(c, "<u4") for _, c in held]))
        _add_windows(table, low, key, n, bucket << SLOT_BITS)
        held.clear()
        part = _part(key)
        order = np.lexsort((key, part))
        part, key, n = part[order], key[order], n[order]
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        ends = [*cuts[1:], len(part)]
        return rows(2, bucket, part[cuts], [key[a:b].astype("<u8").tobytes() for a, b in zip(cuts, ends)], [n[a:b].astype("<f8").tobytes() for a, b in zip(cuts, ends)])

    now, held, size, table, low = None, [], 0, None, None
    for b in frames:
        for kind, bucket, keys, counts in zip(*(c.to_pylist() for c in b.columns)):
            if (kind, bucket) != now:
                if now is not None:
                    if now[0] == 1:
                        yield add(now[1], held, table, low)
                    yield done(*now, held, table, low)
                now, held, size = (kind, bucket), [], 0
                if kind == 1:
                    table, low = np.zeros((1 << SLOT_BITS, 2)), np.zeros((256 + (1 << 16), 2))
            held.append((keys, counts))
            size += len(keys) // 8
            if kind == 1 and size > HELD:  # sums of windows need not wait for the others
                yield add(bucket, held, table, low)
                held, size = [(b"", b"")], 0
    if now is not None:
        if now[0] == 1:
            yield add(now[1], held, table, low)
        yield done(*now, held, table, low)


def _part(key: np.ndarray) -> np.ndarray:
    return (mix(key ^ _U(_ODD)) & _U(PARTS - 1)).astype(np.int64)


def _shrink(counts: np.ndarray) -> np.ndarray:
    """Counts in 16 bits; where they are too large, in proportion."""
    top = counts.max(axis=1, keepdims=True)
    return np.round(counts * np.minimum(1.0, 65535 / np.maximum(top, 1))).astype("<u2")


# ------------------------------------------------------------------ the model
def _signals(counts: np.ndarray) -> np.ndarray:
    """Per slot, in one 16-bit number: the stretched probability in sixteenths (high byte), and how often it was seen, in steps."""
    n = counts.sum(axis=1)
    stretched = np.clip(np.round(np.log((counts[:, 1] + 0.4) / (counts[:, 0] + 0.4)) * 16), -127, 127)
    seen = np.searchsorted([1, 2, 4, 16], n, side="right")
    return (stretched.astype(np.int16) << 8) | seen.astype(np.int16)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Mixer:
    """Gated weights and the refining map, with the tables they read."""

    GATES = (ORDER + 1) * 4
    STEPS = 33

    def __init__(self, low: np.ndarray, table: np.ndarray):
        self.low, self.table = low, table  # signals of orders 0 and 1, and of the slots
        self.weights = np.full((self.GATES, ORDER + 2), 0.3)
        self.weights[:, -1] = 0.0
        self.energy = np.full_like(self.weights, 1e-2)
        self.map = np.tile(_squash(np.linspace(-8, 8, self.STEPS)), (256, 1))
        self.used, self.used_cells = np.zeros(self.GATES), np.zeros(self.map.size)  # how often, in learning

    def inputs(self, slots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Stretched probabilities of all orders and a bias; and the gate."""
        return self._features([self.low.take(slots[0]), self.low.take(slots[1] + 256), *[self.table.take(s) for s in slots[2:]]])

    @staticmethod
    def _features(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        x = np.empty((len(found[0]), ORDER + 2), np.float32)
        gate = np.zeros(len(found[0]), np.int64)
        for k, f in enumerate(found):
            x[:, k] = f >> 8
            seen = (f & 255).astype(np.int64)
            gate = np.where(seen > 0, 4 * k + np.minimum(seen, 4) - 1, gate)
        x[:, :-1] *= 1 / 16
        x[:, -1] = 0.25
        return x, gate

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", x, self.weights.astype(np.float32)[gate]).clip(-8, 8)

    def _refined(self, stretched: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (stretched + 8) * ((self.STEPS - 1) / 16)
        cell = np.minimum(at.astype(np.int64), self.STEPS - 2)
        part = at - cell
        flat = node * self.STEPS + cell
        return self.map.take(flat) * (1 - part) + self.map.take(flat + 1) * part, flat, part

    def probability(self, stretched: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Of a one."""
        return np.clip((_squash(stretched) + self._refined(stretched, node)[0]) / 2, 1 / 65536, 1 - 1 / 65536)

    def learn(self, key: np.ndarray, n: np.ndarray | None = None, inputs=None, step: int = 512, rate: float = 0.05, map_rate: float = 0.02) -> None:
        """One pass over windows in their order, in small steps: predict, then adapt. ``n`` is how often each window counts.

        ``inputs`` gives stretched probabilities and gates from (bits, slots), in place of the model's tables.
        """
        n = np.ones(len(key)) if n is None else n
        for a in range(0, len(key), step):
            times = n[a : a + step]
            for _, bit, node, slots in places(key[a : a + step]):
                x, gate = inputs(bit, slots) if inputs else self.inputs(slots)
                s = self.mixed(x, gate)
                error = (bit - _squash(s)) * times
                slope = np.stack([np.bincount(gate, weights=error * x[:, k], minlength=self.GATES) for k in range(ORDER + 2)], axis=1)
                mass = np.bincount(gate, weights=times, minlength=self.GATES)
                slope /= np.maximum(mass, 1)[:, None]
                self.used += mass
                self.energy += slope * slope
                self.weights += rate * slope / np.sqrt(self.energy)
                _, flat, part = self._refined(s, node)
                cells, at = np.unique(np.concatenate([flat, flat + 1]), return_inverse=True)
                share = np.concatenate([(1 - part) * times, part * times])
                mass = np.bincount(at, weights=share)
                hits = np.bincount(at, weights=share * np.concatenate([bit, bit]))
                values = self.map.reshape(-1)
                values[cells] += (1 - (1 - map_rate) ** mass) * (hits / np.maximum(mass, 1e-12) - values[cells])
                self.used_cells[cells] += mass
                np.clip(values, 1e-5, 1 - 1e-5, out=values)

    def average(self, learned: list[tuple[np.ndarray, ...]]) -> None:
        """Take the mean of models (weights, how often used, map, how often its cells), each part by its use; what none used stays."""
        for name, k in (("weights", 0), ("map", 2)):
            own = getattr(self, name)
            total, use = np.zeros(own.size), np.zeros(own.size)
            for parts in learned:
                weight = np.repeat(parts[k + 1], own.size // parts[k + 1].size)
                total += parts[k] * weight
                use += weight
            setattr(self, name, np.where(use > 0, total / np.maximum(use, 1e-300), own.reshape(-1)).reshape(own.shape))

    def cost(self, key: np.ndarray) -> np.ndarray:
        """log10 of the probability of each window's last byte after the others."""
        out = np.empty(len(key))
        for a in range(0, len(key), 1 << 16):
            product = np.ones(len(key[a : a + (1 << 16)]))  # of eight probabilities, each 2**-16 at least
            for _, bit, node, slots in places(key[a : a + (1 << 16)]):
                x, gate = self.inputs(slots)
                p = self.probability(self.mixed(x, gate), node)
                product *= np.where(bit == 1, p, 1 - p)
            out[a : a + (1 << 16)] = np.log10(product)
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray, held: dict) -> np.ndarray:
        """log10 of the probability of each text. ``held`` keeps costs of windows between calls."""
        buffer, starts = stream(data, offsets)
        total = np.zeros(len(offsets) - 1)
        for a in range(ORDER, len(buffer), PIECE):
            b = min(len(buffer), a + PIECE)
            codes, key = pd.factorize(windows(buffer, a, b))
            costs = self._costs(key, held)[codes]
            costs[~_own(starts, a, b)] = 0.0
            lo, hi = np.searchsorted(starts, [a, b - 1], side="right") - 1
            edges = np.maximum(starts[lo : hi + 1] - a, 0)
            total[lo : hi + 1] += np.add.reduceat(costs, edges)
        return total

    def _costs(self, key: np.ndarray, held: dict) -> np.ndarray:
        known, costs = held.get("key", np.zeros(0, np.uint64)), held.get("cost", np.zeros(0))
        at = _find(known, key)
        new = known[at] != key if len(known) else np.ones(len(key), bool)
        out = np.empty(len(key))
        out[~new] = costs[at[~new]]
        out[new] = self.cost(key[new])
        if len(known) + new.sum() > HELD:
            known, costs = known[:0], costs[:0]
        known, costs = np.concatenate([known, key[new]]), np.concatenate([costs, out[new]])
        order = np.argsort(known, kind="stable")  # two sorted runs, nearly
        held["key"], held["cost"] = known[order], costs[order]
        return out


def _sum_low(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in frames:
        for counts in b.column(0):
            part = np.frombuffer(counts.as_buffer(), "<f8")
            total = part.copy() if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])


def _left_out(low: np.ndarray, table: np.ndarray, base: int):
    """Inputs of windows from the counts without one occurrence of each."""
    def inputs(bit: np.ndarray, slots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        found, rows = [], np.arange(len(bit))
        for k, s in enumerate(slots):
            counts = (low[s + 256 * k] if k < 2 else table[s - base]).astype(np.float64)
            counts[rows, bit] = np.maximum(counts[rows, bit] - 1, 0)
            found.append(_signals(counts))
        return Mixer._features(found)
    return inputs


_LEARNED = ("signals", "weights", "used", "map", "used_cells")


def _learn(shared):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets come whole: the counts of their slots, then their windows by part. A model learned from those, and the slots' signals."""
        def learn(bucket, model, table, held):
            codes, key = pd.factorize(np.concatenate([np.frombuffer(k, "<u8") for k, _ in held]))
            n = np.bincount(codes, weights=np.concatenate([np.frombuffer(c, "<f8") for _, c in held]))
            order = np.argsort(mix(key))
            model.learn(key[order], n[order], _left_out(shared.value, table, bucket << SLOT_BITS))

        def done(bucket, model, table):
            values = (_signals(table), *(getattr(model, name).astype("<f8") for name in _LEARNED[1:]))
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in values]], names=["bucket", *_LEARNED])

        now, model, table, held = None, None, None, []
        for b in frames:
            for kind, bucket, part, keys, counts in zip(*(c.to_pylist() for c in b.columns)):
                if (bucket, kind, part) != now:
                    if held:
                        learn(now[0], model, table, held)
                        held = []
                    if kind == 1:
                        if now is not None:
                            yield done(now[0], model, table)
                        model, table = Mixer(None, None), np.frombuffer(keys, "<u2").reshape(-1, 2)
                    now = (bucket, kind, part)
                if kind == 2:
                    held.append((keys, counts))
        if held:
            learn(now[0], model, table, held)
        if now is not None:
            yield done(now[0], model, table)
    return run


# ------------------------------------------------------------------ words
def _find(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted value is, or would be, in sorted values; wanted in order, as that is several times faster."""
    order = np.argsort(wanted)
    at = np.empty(len(wanted), np.int64)
    at[order] = np.searchsorted(values, wanted[order])
    return np.minimum(at, max(0, len(values) - 1))


def _histogram(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in frames:
        for counts in b.column(0).to_pylist():
            c, n = np.unique(np.frombuffer(counts, "<i8"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(n)], names=["c", "words"])


def _most_frequent(least: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            for keys, counts in zip(*(c.to_pylist() for c in b.columns)):
                n = np.frombuffer(counts, "<i8")
                often = n >= least
                if often.any():
                    yield pa.RecordBatch.from_arrays([pa.array([np.frombuffer(keys, "<u8")[often].tobytes()], pa.binary()), pa.array([n[often].tobytes()], pa.binary())],
                                                     names=["keys", "counts"])
    return run


def _score(shared, buckets: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per text, with the sum over its frequent words, and rows of its other words by bucket."""
        model, words, counts = shared.value
        logs = np.log10(counts + 1.0)
        held, parts, size = {}, [], 0

        def flush():
            word, key, n = (np.concatenate([p[k] for p in parts]) for k in range(3))
            bucket = (word & _U(buckets - 1)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, columns = bucket[order], [word[order].astype("<u8"), key[order].astype("<i8"), n[order].astype("<u4")]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = [*cuts[1:], len(bucket)]
            m = len(cuts)
            return pa.RecordBatch.from_arrays(
                [pa.nulls(m, id_type), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()),
                 pa.nulls(m, pa.float64()), pa.array(bucket[cuts].astype(np.int32)), *[pa.array([c[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()) for c in columns]],
                names=names)
        names = ["doc_id", "held_out", "key", "n_tokens", "known", "sum", "score", "bucket", "words", "texts", "counts"]
        for b in pieces(frames, "text", 4 << 20):
            id_type = b.schema.field(0).type
            keys = b.column(2).to_numpy()
            data, offsets = text_buffer(b.column(3))
            score = model.score(data, offsets, held)
            hashes, n = word_hashes(data, offsets)
            text = np.repeat(np.arange(b.num_rows), n)
            codes, distinct = pd.factorize(hashes)
            at = _find(words, distinct)[codes]
            top = words[at] == hashes if len(words) else np.zeros(len(hashes), bool)
            total = np.bincount(text[top], weights=logs[at[top]], minlength=b.num_rows).astype(float)
            known = np.bincount(text[top], minlength=b.num_rows)
            rare = np.flatnonzero(~top)
            if len(rare):
                order = rare[np.lexsort((hashes[rare], text[rare]))]
                t, h = text[order], hashes[order]
                first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (h[1:] != h[:-1])]))
                parts.append((h[first], keys[t[first]], np.diff(np.append(first, len(order)))))
                size += len(first)
            m = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n + 1), pa.array(known.astype(np.int64)), pa.array(total), pa.array(score),
                                              pa.nulls(m, pa.int32()), *[pa.nulls(m, pa.binary())] * 3], names=names)
            if size > HELD:
                yield flush()
                parts, size = [], 0
        if parts:
            yield flush()
    return run


def _rare(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets come whole: the counts of their words first, then words of texts. Sums by text; copies of a text count once."""
    def done(words, counts, held):
        word, text, n = (np.concatenate([np.frombuffer(h[k], t) for h in held]) for k, t in enumerate(("<u8", "<i8", "<u4")))
        order = np.lexsort((word, text))
        word, text, n = word[order], text[order], n[order]
        own = np.ones(len(word), bool)
        own[1:] = (word[1:] != word[:-1]) | (text[1:] != text[:-1])
        word, text, n = word[own], text[own], n[own].astype(np.int64)
        at = np.minimum(np.searchsorted(words, word), max(0, len(words) - 1))
        c = np.where(words[at] == word, counts[at], 0) if len(words) else np.zeros(len(word), np.int64)
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        return pa.RecordBatch.from_arrays([pa.array(text[first]), pa.array(np.add.reduceat(n * np.log10(c + 1.0), first)), pa.array(np.add.reduceat(n * (c > 0), first))],
                                          names=["key", "sum", "known"])
    now, words, counts, held = None, np.zeros(0, np.uint64), np.zeros(0, np.int64), []
    for b in frames:
        for bucket, w, t, c in zip(*(x.to_pylist() for x in b.columns)):
            if bucket != now:
                if held:
                    yield done(words, counts, held)
                now, words, counts, held = bucket, np.zeros(0, np.uint64), np.zeros(0, np.int64), []
            if t is None:
                words, counts = np.frombuffer(w, "<u8"), np.frombuffer(c, "<i8")
            else:
                held.append((w, t, c))
    if held:
        yield done(words, counts, held)


# ------------------------------------------------------------------ the operator
def score(docs: DataFrame, learn: Column, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: id, held_out, n_tokens, n_known, train_tokens, base_score, score. ``learn`` marks the training rows."""
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text.alias("text"))
    train = rows.where("learn").select("text")
    size = train.agg(F.count("*").alias("docs"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()
    buckets = 1 << max(3, math.ceil(math.log2(max(1, (size.bytes or 0) / WORD_BUCKET_BYTES))))

    counted = train.mapInArrow(handed_back(_count(buckets)), "kind int, bucket int, keys binary, counts binary")
    counted = counted.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket")
    stats = staged(counted.mapInArrow(handed_back(_sum_up), "kind int, bucket int, part int, keys binary, counts binary"), "lm-counts")
    low = np.zeros((256 + (1 << 16), 2))
    for r in stats.where("kind = 1").select("counts").coalesce(4).mapInArrow(handed_back(_sum_low), "counts binary").collect():
        low += np.frombuffer(r["counts"], "<f8").reshape(-1, 2)

    windows_of = stats.where("kind > 0").select("kind", "bucket", "part", "keys", F.when(F.col("kind") == 2, F.col("counts")).alias("counts"))
    sent = send(spark, low)
    learned = staged(windows_of.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "kind", "part").mapInArrow(
        handed_back(_learn(sent)), "bucket int, " + ", ".join(f"{name} binary" for name in _LEARNED)), "lm-learned")
    model = Mixer(_signals(low), np.zeros(BUCKETS << SLOT_BITS, np.int16))
    done_with(sent)
    taught = []
    for bucket in range(0, BUCKETS, 4):  # the driver holds a few buckets' rows at a time
        for r in learned.where(F.col("bucket").between(bucket, bucket + 3)).orderBy("bucket").collect():
            model.table[r.bucket << SLOT_BITS : (r.bucket + 1) << SLOT_BITS] = np.frombuffer(r.signals, np.int16)
            taught.append(tuple(np.frombuffer(r[name], "<f8") for name in _LEARNED[1:]))
    model.average(taught)
    del taught
    release_memory()

    words = stats.where("kind = 0")
    histogram = words.select("counts").mapInArrow(handed_back(_histogram), "c long, words long").groupBy("c").agg(F.sum("words").alias("words")).orderBy(F.desc("c")).collect()
    n_tokens = sum(r.c * r["words"] for r in histogram) + size.docs
    n_words = sum(r["words"] for r in histogram) + (size.docs > 0)
    least, kept = (histogram[0].c if histogram else 0) + 1, 0
    for r in histogram:
        kept += r["words"]
        if kept > TOP:
            break
        least = r.c
    top = words.select("keys", "counts").mapInArrow(handed_back(_most_frequent(least)), "keys binary, counts binary").collect()
    top_words = np.concatenate([np.zeros(0, "<u8"), *[np.frombuffer(r["keys"], "<u8") for r in top]])
    top_counts = np.concatenate([np.zeros(0, "<i8"), *[np.frombuffer(r["counts"], "<i8") for r in top]])
    order = np.argsort(top_words)
    shared = send(spark, (model, top_words[order], top_counts[order]))
    del model, top, top_words, top_counts, order
    release_memory()

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = staged(rows.select("doc_id", "held_out", F.xxhash64("text").alias("key"), "text").mapInArrow(
        handed_back(_score(shared, buckets)), f"doc_id {kind}, held_out boolean, key long, n_tokens long, known long, sum double, score double, bucket int, "
        "words binary, texts binary, counts binary"), "lm-scores")
    done_with(shared)
    sent = scored.where("bucket is not null").select("bucket", "words", "texts", "counts")
    counts = words.select("bucket", F.col("keys").alias("words"), F.lit(None).cast("binary").alias("texts"), "counts")
    met = counts.unionByName(sent).repartition("bucket").sortWithinPartitions("bucket", F.col("texts").isNotNull())
    rare = met.mapInArrow(handed_back(_rare), "key long, sum double, known long").groupBy("key").agg(F.sum("sum").alias("rare_sum"), F.sum("known").alias("rare_known"))
    rare = staged(rare.withColumnRenamed("key", "rare_key"), "lm-rare")
    texts = scored.where("bucket is null").select("doc_id", "held_out", "key", "n_tokens", "known", "sum", "score")
    out = texts.join(rare, F.col("key") == F.col("rare_key"), "left")
    end = math.log10(size.docs + 1)
    total = F.col("sum") + F.coalesce("rare_sum", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(math.log10(n_tokens + n_words + 1))
    return out.select(F.col("doc_id").alias(id_col), "held_out", "n_tokens",
                      (F.col("known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(size.docs > 0))).cast("long").alias("n_known"),
                      F.lit(n_tokens).cast("long").alias("train_tokens"), total.alias("base_score"), "score")
