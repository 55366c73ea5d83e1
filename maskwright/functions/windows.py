"""Hashes of byte windows: which literals of a large list a text may hold, told by all its windows of their lengths at once.

Two texts that share a window share its hash. Hashes of different windows may be equal too, so a hit says "maybe".
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from maskwright.functions import bloom
from maskwright.functions.literals import LEAST, folded

SIZES = (*range(LEAST, 17), 20, 24, 32, 48, 64)  # a longer literal is known by its last bytes
CHUNK = 1 << 18  # bytes hashed at a time

_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def window_size(literal: str) -> int:
    return max(s for s in SIZES if s <= len(literal))


def hashes(data: np.ndarray, sizes: list[int]) -> Iterator[np.ndarray]:
    """For each size the hash of every window of ``data`` (bytes), by its start. A window is put together from windows of powers of two."""
    levels, power = [data.astype(np.uint64) + np.uint64(1)], [_BASE]
    with np.errstate(over="ignore"):
        for size in sizes:
            out, long = None, 0
            for k in range(size.bit_length()):
                if k == len(levels):
                    half, step = levels[-1], 1 << (k - 1)
                    levels.append(half[:-step] * power[-1] + half[step:] if len(half) > step else half[:0])
                    power.append(power[-1] * power[-1])
                if size >> k & 1:
                    level = levels[k]
                    n = max(0, len(level) - long)
                    out = level[:n] if out is None else out[:n] * power[k] + level[long:long + n]
                    long += 1 << k
            out = (out ^ (out >> np.uint64(33)) ^ np.uint64(size)) * _MIX
            yield (out ^ (out >> np.uint64(29))).view(np.int64)


def literal_hash(literal: str) -> int:
    size = window_size(literal)
    return int(next(hashes(np.frombuffer(literal[-size:].encode("ascii"), np.uint8), [size]))[0])


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The folded texts as bytes, one after the other, and where each begins (one more entry at the end)."""
    plain = bool(pc.all(pc.string_is_ascii(texts)).as_py())
    if not plain:
        texts = pa.array([folded(t) for t in texts.to_pylist()], pa.string())
    held = texts.cast(pa.large_binary())
    offsets = np.frombuffer(held.buffers()[1], np.int64)[held.offset:held.offset + len(held) + 1]
    data = np.frombuffer(held.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return (np.where((data >= 65) & (data <= 90), data | np.uint8(32), data) if plain else data), offsets - offsets[0]


def maybe_held(texts: pa.Array, table: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (number of a text, hash of a window) that the Bloom filter ``table`` lets through. No text is null.

    A window that reaches into the next text may be among them, which is one more "maybe".
    """
    data, offsets = _bytes(texts)
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start in range(0, len(data), CHUNK):
        for h in hashes(data[start:start + CHUNK + SIZES[-1] - 1], sizes):
            h = h[:CHUNK]
            at = np.flatnonzero(bloom.found(table, h))
            rows.append(np.searchsorted(offsets, at + start, side="right") - 1)
            found.append(h[at])
    return np.concatenate(rows), np.concatenate(found)
