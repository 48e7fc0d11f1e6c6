"""Vectorised words, word hashes and shingles over the bytes of many documents at once."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SHINGLE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_power = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: ASCII white space: space and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power["up"]) < n:
        size = 1 << int(n).bit_length()
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _power[name] = np.cumprod(x)
    return _power["up"], _power["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64 (the finaliser of a public 64-bit hash)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Words:
    """Words of a run of documents: byte spans, the document of each word, and each document's first word."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at
        space = SPACE[data]
        before = np.empty_like(space)
        before[1:] = space[:-1]
        begin = at[:-1][at[:-1] < len(data)]
        before[:1] = True
        before[begin] = True
        self.starts = np.flatnonzero(~space & before)
        after = np.empty_like(space)
        after[:-1] = space[1:]
        after[-1:] = True
        ends = at[1:]
        after[ends[ends > 0] - 1] = True
        self.ends = np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.starts, at)
        self.count = np.diff(self.first)

    def sums(self, lower: bool = True) -> np.ndarray:
        """Running polynomial sums, from which any span's hash follows."""
        up, _ = _powers(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, np.uint64)
        table = _BYTE[LOWER] if lower else _BYTE
        np.cumsum(table[self.data] * up[: len(self.data)], out=out[1:])
        return out

    def hashes(self, lower: bool = True, sums: np.ndarray | None = None, starts=None, ends=None) -> np.ndarray:
        """A 64-bit hash of each word (or of the given spans)."""
        c = self.sums(lower) if sums is None else sums
        starts = self.starts if starts is None else starts
        ends = self.ends if ends is None else ends
        _, down = _powers(len(self.data) + 1)
        return mix((c[ends] - c[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _BASE)


def shingles(words: Words, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word runs in text order, and where each document's begin. A shorter document: one hash of all its words."""
    h = words.hashes(lower)
    n = words.count
    runs = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(runs, out=at[1:])
    out = np.zeros(at[-1], np.uint64)
    full = np.flatnonzero(n >= k)
    if len(h) >= k:
        rolled = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            rolled += h[j : j + len(rolled)] * _SHINGLE[j]
        rolled = mix(rolled)
        if len(full):
            take = np.repeat(words.first[full] - at[full], runs[full])
            place = np.repeat(at[full], runs[full]) + _ranges(runs[full])
            out[place] = rolled[place + take]
    for d in np.flatnonzero((n > 0) & (n < k)):
        own = h[words.first[d] : words.first[d + 1]]
        out[at[d]] = mix(np.array([np.sum(own * _SHINGLE[: len(own)], dtype=np.uint64) ^ np.uint64(len(own) * 0x5851F42D4C957F2D % 2**64)]))[0]
    return out, at


def _ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, one after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths)


def distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct values in ascending order."""
    parts = [np.unique(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    out = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=out[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), out
