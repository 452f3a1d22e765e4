"""Vectorised text kernels: words, word n-gram fingerprints and winnowed anchors over UTF-8 buffers.

All of them work on a byte buffer of many texts and the offsets of these, as
Arrow hands them over, so no Python object is made for a word. Fingerprints are
64-bit: a random byte table, polynomial prefix sums modulo 2**64 with an odd
base (whose powers have inverses), and a final mix.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
#: Folded: A-Z count as a-z.
BYTE_FOLDED = BYTE.copy()
BYTE_FOLDED[65:91] = BYTE[97:123]
#: Word separators: space and 0x09-0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE, _INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; kept for the next call."""
    if len(_powers[0]) < n:
        m = 1 << int(n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(m, _U(base), _U)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=_U)
    return _powers[0][:n], _powers[1][:n]


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of values[starts:ends] (uint64 values, already random-looking)."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[:-1], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(_U) * _U(0xD1B54A32D192ED03))


def run_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of values[i:i + k] for every i; equal to range_hash of the same runs."""
    n = len(values)
    if n < k:
        return np.zeros(0, _U)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum(values * up[:-1], out=total[1:])
    h = (total[k:] - total[:-k]) * down[: n - k + 1]
    return mix(h + _U(k * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))


class Words:
    """Words of a slice of texts: byte starts and ends, fingerprints, and n + 1 offsets of each text's words."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, fold: bool = False):
        n = len(offs) - 1
        space = IS_SPACE[raw]
        first = np.ones(len(raw), bool)
        first[1:] = space[:-1]
        edge = offs[:-1][offs[:-1] < len(raw)]
        first[edge] = True
        first &= ~space
        last = np.ones(len(raw), bool)
        last[:-1] = space[1:]
        edge = offs[1:][offs[1:] > 0] - 1
        last[edge] = True
        last &= ~space
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.hash = range_hash((BYTE_FOLDED if fold else BYTE)[raw], self.starts, self.ends)
        self.offs = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.offs)
        self.n = n

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start word, text, fingerprint) of all runs of k words of one text."""
        left = self.offs[1:][self.doc()] - np.arange(len(self.starts))
        at = np.flatnonzero(left >= k)
        return at, self.doc()[at], range_hash(self.hash, at, at + k)


def shingle_sets(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text, sorted, and n + 1 offsets; a shorter text is one shingle, an empty one none."""
    at, doc, h = w.grams(k)
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        doc = np.concatenate([doc, short])
        h = np.concatenate([h, range_hash(w.hash, w.offs[short], w.offs[short + 1])])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h = doc[keep], h[keep]
    return h, np.searchsorted(doc, np.arange(w.n + 1))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    out, done = x.copy(), 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def winnow(h: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` fingerprints of one group: the index of its smallest (the leftmost of equals).

    Returns (run start indices, chosen index). h must hold consecutive positions
    of each group one after the other. The choice depends on the run's content
    alone, so equal runs choose at equal places.
    """
    n = len(h)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(group[: n - width + 1] == group[width - 1 :])
    # the upper half of the fingerprint, then the position: unique, ordered, and the leftmost of equals comes first
    key = (h & _U(0xFFFFFFFF00000000)) | np.arange(n, dtype=_U)
    chosen = (sliding_min(key, width) & _U(0xFFFFFFFF)).astype(np.int64)
    return start, chosen[start]
