"""Word shingles as 64-bit hashes."""

from __future__ import annotations

import numpy as np

#: Bytes of a text that are hashed at once; longer texts are cut between words.
TOGETHER = 1 << 19
_FACTOR = 0xD1342543DE82EF95
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int) -> np.ndarray:
    out = np.full(TOGETHER, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_FACTOR), _powers(pow(_FACTOR, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (two rounds of xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash for each run of characters other than U+0020 and U+0009 to U+000D, with A-Z in lower case.

    A word's bytes are the coefficients of a polynomial modulo 2 ** 64; running sums give all words of a text at once.
    """
    raw = (text or "").encode("utf-8", "replace").lower()  # for bytes lower case is ASCII only
    parts = []
    while len(raw) > TOGETHER:
        cut = len(raw[:TOGETHER].rstrip().rsplit(None, 1)[0]) if len(raw[:TOGETHER].split(None, 2)) > 1 else 0
        if not cut:  # one word fills it all
            return np.concatenate([*parts, np.array([_long(w) for w in raw.split()], dtype=np.uint64)])
        parts.append(_hash(raw[:cut]))
        raw = raw[cut:]
    parts.append(_hash(raw))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _hash(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(_SPACE[data], prepend=True, append=True))
    first, end = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data + np.uint64(1)) * _UP[: len(data)], out=sums[1:])
    return mixed((sums[end] - sums[first]) * _DOWN[first] + (end - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _long(word: bytes) -> int:
    """The same hash of one word of any length."""
    value, power = 0, 1
    for b in word:
        value, power = (value + (b + 1) * power) % (1 << 64), power * _FACTOR % (1 << 64)
    return int(mixed(np.array([(value + len(word) * 0x9E3779B97F4A7C15) % (1 << 64)], dtype=np.uint64))[0])


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct shingles of ``width`` words; fewer words are one shingle, none are none."""
    words = word_hashes(text)
    n = min(width, len(words))
    if not n:
        return words
    total = np.full(len(words) - n + 1, np.uint64(n), dtype=np.uint64)
    for k in range(n):
        total = (total ^ words[k : len(words) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return np.unique(mixed(total))
