"""Vectorised hashing of the words of a text: all words of a text in a few numpy passes, never a Python loop per word."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Besides, ASCII other than letters and digits becomes a space.
ALNUM = LOWER.copy()
ALNUM[[b for b in range(128) if not chr(b).isalnum()]] = 0x20
#: Besides, digits become a space: what is left are letters.
LETTERS = ALNUM.copy()
LETTERS[48:58] = 0x20

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 14)
        _powers = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE)], dtype=np.uint64)
        _inverses = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _INVERSE)], dtype=np.uint64)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: bytes, table: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mapped bytes, and the start and end of each word (maximal run without white space)."""
    buf = table[np.frombuffer(data, np.uint8)]
    word = np.zeros(len(buf) + 2, np.int8)
    word[1:-1] = ~_SPACE[buf]
    edge = np.diff(word)
    return buf, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: bytes, table: np.ndarray = LOWER, stems: tuple[int, ...] = ()) -> np.ndarray:
    """A 64-bit hash of each word, in order; then for each length in ``stems`` one of the beginning of each longer word."""
    buf, starts, ends = spans(data, table)
    if not len(starts):
        return np.empty(0, np.uint64)
    powers, inverses = _tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers[: len(buf)], out=sums[1:])
    out = [mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))]
    for n in stems:
        long = starts[ends - starts > n]
        out.append(mix(((sums[long + n] - sums[long]) * inverses[long]) ^ np.uint64(n * 0x51ED270B76A4F3C1 & (1 << 64) - 1)))
    return np.concatenate(out)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words make one shingle, no words none."""
    if not len(words):
        return np.empty(0, np.uint64)
    n = max(1, len(words) - k + 1)
    width = min(k, len(words))
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n]
    return np.unique(mix(total))
