"""Words of texts as arrays: places, 64-bit hashes, hashes of runs of words."""

from __future__ import annotations

import numpy as np

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SPACE = np.array([chr(c).isspace() for c in range(0x3001)] + [False])
_POWERS = np.cumprod(np.full(64, _PRIME, dtype=np.uint64))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _turns(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    blank = np.concatenate([[True], _SPACE[np.minimum(points, len(_SPACE) - 1)], [True]])
    turns = np.flatnonzero(blank[1:] != blank[:-1])
    return turns[::2], turns[1::2]


def places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text, in code points."""
    return _turns(_points(text))


def hashes(text: str | None) -> np.ndarray:
    """A hash of each word of the text: a polynomial over its mixed code points."""
    points = _points(text or "")
    starts, ends = _turns(points)
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    lengths = ends - starts
    longest = int(lengths.max())
    powers = _POWERS if longest <= len(_POWERS) else np.cumprod(np.full(longest, _PRIME, dtype=np.uint64))
    first = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    c = points[within + np.repeat(starts, lengths)].astype(np.uint64)
    c += np.uint64(1)
    c *= _MIX
    c ^= c >> np.uint64(29)
    c *= powers[within]
    h = np.add.reduceat(c, first)
    h ^= h >> np.uint64(32)
    h *= _PRIME
    h ^= h >> np.uint64(29)
    return h


def grams(words: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of ``gram`` hashed words."""
    n = len(words) - gram + 1
    h = np.zeros(n, dtype=np.uint64)
    for j in range(gram):
        h *= _PRIME
        h += words[j : j + n]
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h
