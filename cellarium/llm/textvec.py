"""Words and shingles of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}

BLANK = np.zeros(256, bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words made of digits, small letters and all characters beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        if n > 1 << 24:  # not kept for one giant text
            return _grow(base, n)
        got = _powers[base] = _grow(base, max(n, 1 << 20))
    return got[:n]


def _grow(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHash:
    """64-bit hashes of any spans of buf, each in constant time."""

    def __init__(self, buf: np.ndarray, salt: int = 0):
        n = len(buf)
        table = _BYTE if not salt else mix(_BYTE + np.uint64(salt))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[buf] * _power(_BASE, n), out=self.sums[1:])
        self.inverse = _power(_INVERSE, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def hash_runs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, part: int = 1 << 20) -> np.ndarray:
    """SpanHash of ascending spans that don't overlap, of about `part` bytes of buf at a time; a longer span is summed in parts."""
    if len(buf) <= part:
        return SpanHash(buf)(starts, ends)
    out, at = [], 0
    while at < len(starts):
        low = int(starts[at])
        to = int(np.searchsorted(ends, low + part, "right"))
        if to > at:
            out.append(SpanHash(buf[low : ends[to - 1]])(starts[at:to] - low, ends[at:to] - low))
            at = to
            continue
        high, total = int(ends[at]), 0
        for k in range(low, high, part):
            piece = buf[k : min(k + part, high)]
            total += int((_BYTE[piece] * _power(_BASE, len(piece))).sum(dtype=np.uint64)) * pow(_BASE, k - low, 1 << 64)
        out.append(mix(np.array([(total + high - low) % (1 << 64)], np.uint64)))
        at += 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross an offset: starts, ends, and for each text the index of its first run (n + 1 of them)."""
    n = len(inside)
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
        cut = offsets[:-1]
        before[cut[cut < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = inside[1:]
        cut = offsets[1:] - 1
        after[cut[cut >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words, within one text each; h: hashes of words, first: each text's first word. Returns (hashes, index of first word)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    # coefficients without a pattern: sums of any few of them must differ
    for j, by in enumerate(mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)):
        out += h[j : j + n] * by
    whole = np.ones(n, bool)
    for j in range(1, k):  # a window that starts less than k words before a text's end is none
        cut = first[1:] - j
        whole[cut[(cut >= 0) & (cut < n)]] = False
    at = np.flatnonzero(whole)
    return mix(out[at] + np.uint64(k)), at
