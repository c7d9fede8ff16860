"""Sets of word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

#: Words of a shingle.
WIDTH = 5
_random = np.random.default_rng(20240229)
_draw = lambda n: _random.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: A random value for each byte, A-Z as a-z.
_BYTES = _draw(256)
_BYTES[65:91] = _BYTES[97:123]
_BASE = int(_draw(1)[0]) & ~2 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _draw(WIDTH)
_LENGTH = _draw(WIDTH + 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, 1 << 16), base, np.uint64)
        x[0] = 1
        have = np.cumprod(x)
        if n <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text raw[off[i]:off[i + 1]] (UTF-8).

    Words are runs of anything but ASCII white space, with A-Z lower-cased. A word's hash is a polynomial
    of its bytes modulo 2 ** 64, read off running sums; a shingle's mixes those of its words by place. A
    text of fewer than WIDTH words has one shingle, of its words and their number; one without words none.
    """
    rows, size = len(off) - 1, len(raw)
    if not size:
        return [np.zeros(0, np.uint64)] * rows
    word = ~_SPACE[raw]
    edge = np.zeros(size + 1, bool)
    edge[off] = True
    starts = np.flatnonzero(word & (edge[:-1] | ~np.append(False, word[:-1])))
    ends = np.flatnonzero(word & (edge[1:] | ~np.append(word[1:], False))) + 1
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(_BYTES[raw] * powers(_BASE, size), out=total[1:])
    hashes = mix((total[ends] - total[starts]) * powers(_INVERSE, size)[starts] + (ends - starts).astype(np.uint64))
    n = len(hashes)
    five = np.zeros(max(n - WIDTH + 1, 0), np.uint64)
    for i in range(WIDTH):
        five += hashes[i : n - WIDTH + 1 + i] * _PLACE[i] if len(five) else five
    five = mix(five + _LENGTH[WIDTH])
    at = np.searchsorted(starts, off)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            s = np.sort(five[a : b - WIDTH + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            k = b - a
            out.append(mix((hashes[a:b] * _PLACE[:k]).sum(keepdims=True, dtype=np.uint64) + _LENGTH[k]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
