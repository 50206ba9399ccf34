"""Hashes of words and of word windows, straight from UTF-8 bytes.

A block of texts is one byte array.  A word's hash is a polynomial in its bytes
modulo 2**64, got from one running sum over the block: the sum up to the word's
end less that up to its start, times the inverse power at its start.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: The characters that part words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 to n, and their inverses."""
    if len(_POWERS[0]) <= n:
        size = 1 << int(n).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _POWERS[k] = np.multiply.accumulate(step)
    return _POWERS[0], _POWERS[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and where each text's words begin (and at last, end)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = ~SPACE[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(before & ~inside)
    up, down = powers(len(data))
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=running[1:])
    hashes = mixed((running[ends] - running[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    limits = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return hashes, np.searchsorted(starts, limits)


def window_hashes(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words inside one text, and the text of each.

    A text of fewer words, but one at least, has one window: all of it.
    """
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(words)) - np.repeat(bounds[:-1], n)
    full = np.flatnonzero(place + size <= n[owner])
    out = np.zeros(len(full), np.uint64)
    for k in range(size):
        out = out * np.uint64(_BASE) + words[full + k]
    owners = owner[full]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = n[short] > k
            extra[has] = extra[has] * np.uint64(_BASE) + words[bounds[short][has] + k]
        out, owners = np.concatenate((out, extra + np.uint64(1))), np.concatenate((owners, short))
    return mixed(out), owners
