"""Vectorised hashing of byte and integer sequences (numpy only).

``PrefixHash`` gives the 64-bit polynomial hash of any substring in constant
time; ``window_min`` is a sliding-window minimum in three passes whatever the
window.  Equal substrings always get equal hashes, wherever they stand.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Two odd multipliers; the hashes of a string by the two are independent.
BASE_A = 0x9E3779B97F4A7C15
BASE_B = 0xC2B2AE3D27D4EB4F


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so that the low bits of a hash are as good as the high ones."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of a base and of its inverse mod 2**64, grown on demand and shared by all calls."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up, self.down


_POWERS: dict[int, _Powers] = {}


class PrefixHash:
    """Hashes of substrings of ``values`` (any unsigned integers) by one multiplier."""

    def __init__(self, values: np.ndarray, base: int = BASE_A) -> None:
        n = len(values)
        self._powers = _POWERS.setdefault(base, _Powers(base))
        up, _ = self._powers.get(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:n], out=self._sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of each values[start:stop]."""
        return mix((self._sums[stop] - self._sums[start]) * self._powers.down[start])

    def all(self, k: int) -> np.ndarray:
        """Hash of values[i:i+k] for every i that fits."""
        n = max(0, len(self._sums) - k)
        return mix((self._sums[k:] - self._sums[:n]) * self._powers.down[:n])


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for every i that fits."""
    n = len(x)
    if w == 1 or n < w:
        return x[: max(0, n - w + 1)]
    y = np.concatenate([x, np.full(-n % w, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i] + counts[i] - 1 of all i, in a row."""
    total = int(counts.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


class Anchors(NamedTuple):
    rank: np.ndarray  # hash of the k values at the anchor
    full: np.ndarray  # hash of everything that the windows of the anchor cover, and of where they lie around it
    row: np.ndarray  # index of the sequence
    first: np.ndarray  # first window of the anchor, within its sequence
    count: np.ndarray  # number of its windows


def anchors(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int, length: int, whole: bool = True) -> Anchors:
    """Cut the windows of ``length`` values into runs that share an anchor.

    A window's anchor is its leftmost k-gram of least hash, so it depends on the
    window's content alone: equal windows have equal anchors at equal offsets,
    wherever they stand.  Consecutive windows of one anchor make one run.
    Sequences are values[starts[i]:ends[i]]; no window crosses their borders.
    Without ``whole``, ``full`` is left out.
    """
    counts = np.maximum(0, ends - starts - length + 1)
    at = ranges(starts, counts)
    if not len(at):
        z = np.zeros(0, np.int64)
        return Anchors(z.astype(np.uint64), z.astype(np.uint64), z, z, z)
    grams = PrefixHash(values).all(k)
    # the high half orders k-grams, the low half is the place: the minimum is the leftmost one, and says where it is
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    low = window_min(keys, length - k + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1)
    new = np.flatnonzero(new)
    count = np.diff(np.append(new, len(at)))
    first = at[new]
    place = (low[new] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(starts)), counts)[new]
    if not whole:
        return Anchors(grams[place], np.zeros(0, np.uint64), row, first - starts[row], count)
    covered = PrefixHash(values, BASE_B).of(first, first + count - 1 + length)
    shape = mix(((place - first).astype(np.uint64) << np.uint64(32)) | count.astype(np.uint64))
    return Anchors(grams[place], mix(covered ^ shape), row, first - starts[row], count)
