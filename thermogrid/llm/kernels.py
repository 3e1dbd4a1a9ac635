"""NumPy kernels over the bytes of a batch of texts. Nothing here holds more than a block of temporaries."""

from __future__ import annotations

import sys

import numpy as np

from .support import ship

U = np.uint64
BLOCK = 1 << 19
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTERS = np.zeros(256, bool)
_LETTERS[48:58] = _LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that any of their bits may serve as a key."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        for base in (BASE, INVERSE):
            steps = np.full(2 * BLOCK, U(base))
            steps[0] = U(1)
            with np.errstate(over="ignore"):
                _POWERS.append(np.cumprod(steps, dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


def word_bounds(data: np.ndarray, bounds: np.ndarray, letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; white space parts them, or with ``letters`` any ASCII byte but letters and digits."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = _LETTERS[data] if letters else ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = bounds[(bounds > 0) & (bounds < len(data))]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, A-Z as a-z: prefix sums of a polynomial, block by block; a longer word is hashed alone."""
    out = np.empty(len(starts), np.uint64)
    power, inverse = _powers()
    i = 0
    while i < len(starts):
        origin = int(starts[i])
        j = int(np.searchsorted(ends, origin + BLOCK, "right"))
        if j <= i:
            value, scale = 0, 1
            for at in range(origin, int(ends[i]), BLOCK):
                part = _LOWER[data[at:min(at + BLOCK, int(ends[i]))]].astype(np.uint64) + U(1)
                value = (value + scale * int((part * power[:len(part)]).sum(dtype=np.uint64))) & (1 << 64) - 1
                scale = scale * int(power[len(part) - 1]) * BASE & (1 << 64) - 1
            out[i] = U(value)
            i += 1
            continue
        part = _LOWER[data[origin:int(ends[j - 1])]].astype(np.uint64)
        part += U(1)
        part *= power[:len(part)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=sums[1:])
        s, e = starts[i:j] - origin, ends[i:j] - origin
        out[i:j] = (sums[e] - sums[s]) * inverse[s]
        i = j
    return mix(out)


def row_counts(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bounds of each row's words among all words."""
    return np.searchsorted(starts, bounds)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each run of ``n`` words of one text, in order; fewer words give one hash of them all."""
    if len(words) <= n:
        return run_hashes(words, max(len(words), 1)) if len(words) else words
    return run_hashes(words, n)


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[:len(words) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * U(BASE) + words[k:len(words) - n + 1 + k])
    return out


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the stretches between bounds; an empty one gives 0."""
    out = np.zeros(len(bounds) - 1, values.dtype if values.dtype.kind != "b" else np.int64)
    full = bounds[1:] > bounds[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, bounds[:-1][full], dtype=out.dtype)
    return out


class Table:
    """Open addressing over 64-bit keys; ``find`` gives each key's place or -1."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 2.5))))
        size = 1 << self.bits
        self.keys, self.place = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        left, step = np.arange(len(keys), dtype=np.int32), 0
        while len(left):
            at = self._slot(keys[left], step)
            free = self.place[at] < 0
            self.place[at[free]] = left[free]
            self.keys[at[free]] = keys[left[free]]
            left, step = left[self.place[at] != left], step + 1

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        at = (keys * U(0xD6E8FEB86659FD93)) >> U(64 - self.bits)
        if step:
            at = (at + U(step)) & U((1 << self.bits) - 1)
        return at.astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys, 0)
        place = self.place[at]
        wrong = np.flatnonzero((place >= 0) & (self.keys[at] != keys))
        step = 1
        while len(wrong):
            at = self._slot(keys[wrong], step)
            got = self.place[at]
            place[wrong] = got
            wrong = wrong[(got >= 0) & (self.keys[at] != keys[wrong])]
            step += 1
        return place


ship(sys.modules[__name__])
