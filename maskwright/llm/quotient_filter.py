"""Counting quotient filters over packed word-id n-grams: exact counters, kept sorted, that merge without the n-grams.

An n-gram's word ids are packed into one number, which an invertible permutation spreads evenly. Its upper bits, the quotient, name
the bucket; the remainder is stored in full, in the order of its value, so a filter loses nothing: quotient and remainder give the
permuted number, and its inverse the word ids. As all filters of one layout sort alike, two buckets of the same quotient merge like
sorted lists, adding the counts of equal remainders. Bytes of a remainder are stored plane by plane, so that sorted ones compress well.

Numbers of more than 64 bits are split into limbs of whole words; the first limb takes up the others in the permutation, so that the
quotient, from the first limb, depends on every word.
"""

from __future__ import annotations

import numpy as np

from maskwright.llm.shingles import mix

_U = np.uint64
_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class Layout:
    """How n-grams of ``k`` words, with ids of ``bits`` bits (32 at most), are packed and permuted."""

    def __init__(self, k: int, bits: int, quotient: int):
        if not 1 <= bits <= 32:
            raise ValueError(f"word ids have 1 to 32 bits, not {bits}")
        per = 64 // bits
        self.k, self.bits = k, bits
        self.words = [min(per, k - i) for i in range(0, k, per)]
        self.width = [w * bits for w in self.words]
        self.quotient = min(quotient, self.width[0])

    def _mask(self, j: int) -> np.uint64:
        return _U((1 << self.width[j]) - 1)

    def pack(self, words: list[np.ndarray]) -> list[np.ndarray]:
        """Limbs of n-grams given as one array of ids per place."""
        limbs, place = [], 0
        for count in self.words:
            limb = words[place].astype(_U)
            for w in words[place + 1 : place + count]:
                limb = (limb << _U(self.bits)) | w.astype(_U)
            limbs.append(limb)
            place += count
        return limbs

    def unpack(self, limbs: list[np.ndarray]) -> list[np.ndarray]:
        out, low = [], _U((1 << self.bits) - 1)
        for limb, count in zip(limbs, self.words):
            out += [(limb >> _U(self.bits * (count - 1 - i))) & low for i in range(count)]
        return out

    def permute(self, limbs: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for j, x in enumerate(limbs):
            for odd in _ODD:
                x = (x * _U(odd)) & self._mask(j)
                x = x ^ (x >> _U((self.width[j] + 1) // 2))
            out.append(x)
        for x in out[1:]:
            out[0] = (out[0] + mix(x)) & self._mask(0)
        return out

    def restore(self, limbs: list[np.ndarray]) -> list[np.ndarray]:
        first = limbs[0]
        for x in limbs[1:]:
            first = (first - mix(x)) & self._mask(0)
        out = []
        for j, x in enumerate([first, *limbs[1:]]):
            for odd in reversed(_ODD):
                x = x ^ (x >> _U((self.width[j] + 1) // 2))
                x = (x * _U(pow(odd, -1, 1 << 64))) & self._mask(j)
            out.append(x)
        return out

    # ------------------------------------------------------------------ filters
    def counted(self, limbs: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
        """Permuted numbers in order, each once, with the sums of their counts (without counts: of ones)."""
        order = np.argsort(limbs[0], kind="stable") if len(limbs) == 1 else np.lexsort(limbs[::-1])
        limbs = [x[order] for x in limbs]
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = np.any([x[1:] != x[:-1] for x in limbs], axis=0)
        cuts = np.flatnonzero(new)
        sums = np.diff(np.append(cuts, len(order))) if counts is None else np.add.reduceat(counts[order], cuts) if len(cuts) else counts[:0]
        return [x[cuts] for x in limbs], sums.astype(np.int64)

    def buckets(self, limbs: list[np.ndarray], counts: np.ndarray) -> list[tuple[int, bytes]]:
        """(quotient, filter) of counted numbers."""
        rest = self.width[0] - self.quotient
        quotient = (limbs[0] >> _U(rest)).astype(np.int64) if rest < 64 else np.zeros(len(counts), np.int64)
        first = limbs[0] & _U((1 << rest) - 1)
        cuts = np.flatnonzero(np.diff(quotient, prepend=-1))
        ends = np.append(cuts[1:], len(quotient))
        return [(int(quotient[a]), self._encode([first[a:b], *[x[a:b] for x in limbs[1:]]], counts[a:b])) for a, b in zip(cuts, ends)]

    def _sizes(self) -> list[int]:
        return [(w + 7) // 8 for w in (self.width[0] - self.quotient, *self.width[1:])]

    def _encode(self, remainders: list[np.ndarray], counts: np.ndarray) -> bytes:
        wide = (int(counts.max()).bit_length() + 7) // 8
        planes = [x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes() for x, size in zip([*remainders, counts], [*self._sizes(), wide])]
        return b"".join([bytes([wide]), *planes])

    def decode(self, quotient: int, blob: bytes) -> tuple[list[np.ndarray], np.ndarray]:
        """Permuted numbers and counts of a filter."""
        sizes = [*self._sizes(), blob[0]]
        n, at, out = (len(blob) - 1) // sum(sizes), 1, []
        for size in sizes:
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :size] = np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n).T
            out.append(wide.view("<u8").reshape(-1).astype(_U))
            at += n * size
        rest = self.width[0] - self.quotient
        out[0] = out[0] | (_U(quotient << rest) if rest < 64 else _U(0))
        return out[:-1], out[-1].astype(np.int64)

    def merged(self, quotient: int, blobs: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        parts = [self.decode(quotient, b) for b in blobs]
        return self.counted([np.concatenate([p[0][j] for p in parts]) for j in range(len(self.width))], np.concatenate([p[1] for p in parts]))
