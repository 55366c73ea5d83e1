"""Word shingles of texts as 64-bit hashes, with numpy.

Words are runs of anything but space and bytes 9 to 13, with A-Z as a-z. A text's set holds the hashes of its distinct runs of
``width`` words; a shorter text is one shingle of all its words; a text without words has an empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
PIECE = 1 << 18  # bytes hashed at once

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; one to one."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_STEP))[_FOLD]
_powers = {_STEP: np.ones(1, np.uint64), _BACK: np.ones(1, np.uint64)}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    if len(_powers[base]) < n:
        p = np.full(n, base, np.uint64)
        p[0] = 1
        _powers[base] = np.cumprod(p)
    return _powers[base][:n]


def _hash_piece(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of some bytes; words end at ``edges`` too."""
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[edges] = True
    first = ~space & (edge[:-1] | np.concatenate([[True], space[:-1]]))
    last = ~space & (edge[1:] | np.concatenate([space[1:], [True]]))
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * _power(_STEP, len(data)))])
    value = (running[end] - running[start]) * _power(_BACK, len(data) + 1)[start]
    return mix(value + mix((end - start).astype(np.uint64))), start


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts laid end to end, and how many words each text has."""
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + PIECE)
        if end < n:  # cut between texts or at white space
            k = np.searchsorted(offsets, end, side="right") - 1
            if offsets[k] > at:
                end = int(offsets[k])
            else:
                step = PIECE
                while end < n and not _SPACE[data[end]] and end < offsets[k + 1]:
                    gap = np.flatnonzero(_SPACE[data[end : end + step]])
                    end = min(int(end + (gap[0] if len(gap) else step)), int(offsets[k + 1]))
        inside = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end, side="right")] - at
        h, start = _hash_piece(data[at:end], inside)
        hashes.append(h)
        counts += np.bincount(np.searchsorted(offsets, start + at, side="right") - 1, minlength=len(counts))
        at = end
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles."""
    words, counts = word_hashes(data, offsets)
    ends = np.cumsum(counts)
    joined = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        joined += words[k : k + len(joined)] * _U(pow(_STEP, k + 1, 1 << 64))
    joined = mix(joined)
    for end, n in zip(ends, counts):
        if n >= width:
            yield np.unique(joined[end - n : end - width + 1])
        elif n:
            own = words[end - n : end]
            whole = (own * _power(_STEP, n + 1)[1:]).sum(dtype=np.uint64) + _U(int(n))
            yield mix(mix(np.array([whole], np.uint64)) + _U(int(n)))
        else:
            yield np.zeros(0, np.uint64)
