"""Words and word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)


@lru_cache(maxsize=1)
def _grown(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    tables = []
    for base in (_BASE, _INVERSE):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        tables.append(np.multiply.accumulate(steps))
    return tables[0], tables[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << 16
    while size < n:
        size *= 2
    return _grown(size)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def running_sums(values: np.ndarray) -> np.ndarray:
    """Sums of the weighted values before each place, from which the hash of any span follows."""
    up, _ = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values + np.uint64(1)) * up[: len(values)], out=total[1:])
    return total


def hashes_between(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(total))
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of ``values[start:end]`` for each span, whatever its position."""
    return hashes_between(running_sums(values), starts, ends)


def word_spans(
    data: np.ndarray, bounds: np.ndarray, between: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without blanks, and the first word of each text (n + 1 places).

    Blanks are the bytes that ``between`` marks, U+0020 and U+0009 to U+000D if not given; a word
    never crosses a text's end.
    """
    n = len(data)
    blank = np.ones(n + 2, bool)
    blank[1:-1] = between[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    inside = ~blank[1:-1]
    starts = np.flatnonzero(inside & (blank[:n] | edge[:n]))
    ends = np.flatnonzero(inside & (blank[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, bounds: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words with A-Z lower-cased, and the first word of each text."""
    starts, ends, first = word_spans(data, bounds, between)
    return span_hashes(_LOWER[data], starts, ends), first


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles.

    Fewer than k words make one shingle of the whole sequence; no word makes the empty set.
    """
    words, first = word_hashes(data, bounds)
    n = max(0, len(words) - k + 1)
    rolled = np.zeros(n, np.uint64)
    for i in range(k):
        rolled = rolled * np.uint64(_BASE) + words[i : i + n]
    rolled = mix(rolled)
    sets = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if high - low >= k:
            ordered = np.sort(rolled[low : high - k + 1])
            sets.append(ordered[np.r_[True, ordered[1:] != ordered[:-1]]])
        elif high > low:
            whole = high - low  # as many words as this: no full shingle has the same hash input
            for word in words[low:high].tolist():
                whole = (whole * _BASE + word) % (1 << 64)
            sets.append(mix(np.array([whole], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
