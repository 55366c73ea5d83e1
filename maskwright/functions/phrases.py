"""Listed phrases in texts of whole Arrow batches: words by their bytes, phrases by a hash of theirs, hits compared byte by byte."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18  # bytes hashed at a time, about; a longer text is taken whole

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_WORD = np.zeros(256, bool)
_WORD[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Hasher:
    """Hashes of any stretches of ``data``, from running sums of bytes times powers; equal bytes have equal hashes."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.up):
            self.up, self.down = (_powers(b, 2 * len(data) + 2) for b in (_BASE, _INVERSE))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:len(data)], out=sums[1:])
            h = (sums[ends] - sums[starts]) * self.down[starts]
            h = (h ^ (h >> np.uint64(33)) ^ (ends - starts).astype(np.uint64)) * _MIX
            return h ^ (h >> np.uint64(29))


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts, one after the other, and where each begins (one more entry at the end)."""
    held = texts.cast(pa.large_binary())
    offsets = np.frombuffer(held.buffers()[1], np.int64)[held.offset:held.offset + len(held) + 1] if len(held) else np.zeros(1, np.int64)
    data = np.frombuffer(held.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def _gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    before = np.cumsum(lengths) - lengths
    return data[np.repeat(starts - before, lengths) + np.arange(lengths.sum())]


@dataclass(frozen=True)
class Phrases:
    """Distinct phrases in lower case, in the order of their hashes."""

    hashes: np.ndarray
    seen: np.ndarray  # bits by the first places of the hashes: most other phrases stop there
    data: np.ndarray
    offsets: np.ndarray
    sizes: list[int]  # in words

    @classmethod
    def of(cls, phrases: pa.Array, sizes: list[int]) -> Phrases | None:
        """None if two phrases have one hash."""
        data, offsets = _buffers(phrases)
        h = Hasher().of(data, offsets[:-1], offsets[1:])
        order = np.argsort(h, kind="stable")
        h = h[order]
        if (h[1:] == h[:-1]).any():
            return None
        lengths = np.diff(offsets)[order]
        seen = np.zeros(1 << max(10, len(h).bit_length() + 4), bool)
        seen[h >> np.uint64(64 - (len(seen).bit_length() - 1))] = True
        return cls(h, np.packbits(seen), _gather(data, offsets[:-1][order], lengths), np.concatenate([[0], np.cumsum(lengths)]), sizes)

    def _listed(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hasher: Hasher) -> np.ndarray:
        """The numbers of the stretches that are listed phrases."""
        h = hasher.of(data, starts, ends)
        bit = (h >> np.uint64(64 - ((len(self.seen) * 8).bit_length() - 1))).astype(np.int64)
        hits = np.flatnonzero((self.seen[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1)
        at = np.minimum(np.searchsorted(self.hashes, h[hits]), len(self.hashes) - 1)
        lengths = ends[hits] - starts[hits]
        same = (self.hashes[at] == h[hits]) & (self.offsets[at + 1] - self.offsets[at] == lengths)
        hits, at, lengths = hits[same], at[same], lengths[same]
        differ = _gather(data, starts[hits], lengths) != _gather(self.data, self.offsets[at], lengths)
        wrong = np.repeat(np.arange(len(hits)), lengths)[differ]
        return np.delete(hits, np.unique(wrong))

    def among(self, phrases: pa.Array, hasher: Hasher) -> np.ndarray:
        """Whether each of some phrases, in lower case, is listed."""
        data, offsets = _buffers(phrases)
        out = np.zeros(len(phrases), bool)
        out[self._listed(data, offsets[:-1], offsets[1:], hasher)] = True
        return out

    def occurrences(self, texts: pa.Array, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the text, start and length of the phrases in ASCII texts, by text and start."""
        data, offsets = _buffers(texts)
        out, first = [np.zeros((3, 0), np.int64)], 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1)
            low, bounds = int(offsets[first]), offsets[first:last + 1] - offsets[first]
            part = data[low:int(offsets[last])]
            word = _WORD[part]
            edge = np.zeros(len(part) + 1, bool)  # where a text begins
            edge[bounds] = True
            starts = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]])))
            ends = np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]]))) + 1
            own = np.searchsorted(bounds, starts, side="right") - 1
            lower = np.where((part >= 65) & (part <= 90), part | np.uint8(32), part)
            found = [np.zeros((3, 0), np.int64)]
            for n in self.sizes:
                k = max(0, len(starts) - n + 1)
                some = np.flatnonzero(own[:k] == own[n - 1:n - 1 + k])
                s, e = starts[some], ends[some + n - 1]
                hit = self._listed(lower, s, e, hasher)
                found.append(np.stack([own[some[hit]] + first, s[hit] - bounds[own[some[hit]]], e[hit] - s[hit]]))
            found = np.concatenate(found, axis=1)
            out.append(found[:, np.lexsort(found[::-1])])
            first = last
        return tuple(np.concatenate(out, axis=1))


def found_lists(shared, texts: pa.Array, others: pa.Array, hasher: Hasher) -> pa.Array:
    """Per row the (start, len) of the listed phrases: of ASCII ``texts``, and where that is null, of the phrases in ``others``, which are empty elsewhere."""
    held = shared.value
    row, start, length = held.occurrences(texts.fill_null(""), hasher)
    flat = others.flatten()
    if len(flat):
        of_row = np.repeat(np.arange(len(others)), others.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        keep = held.among(flat.field("phrase"), hasher)
        row = np.concatenate([row, of_row[keep]])
        start, length = (np.concatenate([a, flat.field(n).to_numpy(zero_copy_only=False)[keep]]) for a, n in ((start, "start"), (length, "len")))
        order = np.argsort(row, kind="stable")
        row, start, length = row[order], start[order], length[order]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))]).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(length, pa.int32())], ["start", "len"])
    return pa.ListArray.from_arrays(pa.array(offsets), items)
