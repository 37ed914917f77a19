"""Vectorised hashes over UTF-8 buffers: words, grams, windows and their anchors.

Every hash is polynomial: prefix sums of value x B^i modulo 2^64, times the inverse power, so that a
range has one value wherever it stands. A finaliser mixes the bits afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20_240_601).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POSITION_BITS = 24
#: Units hashed at once: fits the caches, and positions fit `_POSITION_BITS`.
CHUNK = 1 << 18
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^0..B^(n-1), and their inverses."""
    if len(_powers[0]) < n:
        m = 1 << max(n, CHUNK).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(m, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.cumprod(factors, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The mixed hash of each range [start, end) of what `prefix` summed up."""
    return mixed((sums[end] - sums[start]) * powers(len(sums))[1][start])


def byte_values(buffer: np.ndarray) -> np.ndarray:
    return _BYTE[buffer]


def word_spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a buffer."""
    edge = np.diff(np.concatenate(([True], _SPACE[buffer], [True])).view(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(buffer: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words in a buffer, A-Z lowered first if asked for."""
    starts, ends = word_spans(buffer)
    if lower:
        buffer = _LOWER[buffer]
    return ranges(prefix(_BYTE[buffer]), starts, ends), starts, ends


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive values; none if there are fewer."""
    n = max(0, len(values) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k if n else 0):
        h *= np.uint64(_BASE)
        h += values[j : j + n]
    return mixed(h)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: -(width - have)], x[width - have :]) if width > have else x


@dataclass
class Runs:
    """Maximal runs of windows with one anchor: their first window, count and hashes.

    A window's anchor is its leftmost gram of least hash, so equal windows have equal anchors at
    equal places. The run's segment, the text that its windows cover, has the hash `segment`. `hot`
    is 1 for runs that were cut into single windows.
    """

    start: np.ndarray
    count: np.ndarray
    offset: np.ndarray
    anchor: np.ndarray
    segment: np.ndarray
    hot: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def take(self, which: np.ndarray) -> Runs:
        return Runs(*(x[which] for x in (self.start, self.count, self.offset, self.anchor, self.segment, self.hot)))


def runs(values: np.ndarray, first: np.ndarray, last: np.ndarray, window: int, gram: int) -> Runs:
    """The runs of the texts [first, last) within `values`; windows never cross texts."""
    n = len(values)
    none = np.zeros(0, np.int64)
    if n < window:
        return Runs(none, none, none, none.astype(np.uint64), none.astype(np.uint64), none)
    sums = prefix(values)
    at = np.arange(n - gram + 1)
    g = ranges(sums, at, at + gram)
    low = np.uint64((1 << _POSITION_BITS) - 1)
    least = _sliding_min((g & ~low) | at.astype(np.uint64), window - gram + 1)
    inside = np.zeros(n + 2, np.int32)
    long = last - first >= window
    np.add.at(inside, first[long], 1)
    np.add.at(inside, last[long] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[: len(least)]))
    if not len(starts):
        return Runs(none, none, none, none.astype(np.uint64), none.astype(np.uint64), none)
    where = (least[starts] & low).astype(np.int64)
    begins = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1]) | (starts[1:] != starts[:-1] + 1))))
    count = np.diff(np.append(begins, len(starts)))
    start, anchor_at = starts[begins], where[begins]
    offset = anchor_at - start
    return Runs(start, count, offset, g[anchor_at], segment_hash(sums, start, count, offset, window), np.zeros(len(start), np.int64))


def segment_hash(sums: np.ndarray, start: np.ndarray, count: np.ndarray, offset: np.ndarray, window: int) -> np.ndarray:
    shape = mixed((count.astype(np.uint64) << np.uint64(32)) + offset.astype(np.uint64) + np.uint64(1))
    return ranges(sums, start, start + count - 1 + window) ^ shape


def pieces(lengths: np.ndarray, window: int, chunk: int = CHUNK):
    """Lists of (text, from, to) of about `chunk` units; long texts come in overlapping parts.

    Each window of a text lies in just one part.
    """
    part: list[tuple[int, int, int]] = []
    held = 0
    for k, n in enumerate(lengths.tolist()):
        for a in range(0, max(n - window + 1, 0), 4 * chunk):
            b = min(a + 4 * chunk + window - 1, n)
            if held and held + b - a > chunk:
                yield part
                part, held = [], 0
            part.append((k, a, b))
            held += b - a
    if part:
        yield part


def groups(lengths: list[int], most: int = 2 * CHUNK):
    """Lists of consecutive numbers whose lengths sum up to about `most`."""
    part: list[int] = []
    held = 0
    for k, n in enumerate(lengths):
        if part and held + n > most:
            yield part
            part, held = [], 0
        part.append(k)
        held += n
    if part:
        yield part
