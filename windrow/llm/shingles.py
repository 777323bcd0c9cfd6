"""Hashed word shingles of many texts at once, in numpy.

A word is a run of bytes other than blanks, with A-Z in lower case; a shingle is ``k`` words in a row, or all words of
a text that has fewer. Shingles are compared by 64-bit hashes.
"""

import numpy as np

U64 = np.uint64
_random = np.random.default_rng(20240229)
#: A random number per byte, after folding A-Z.
_OF_BYTE = _random.integers(0, 1 << 64, 256, U64, endpoint=False)
_OF_BYTE[65:91] = _OF_BYTE[97:123]
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE, _STEP = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
_BASE_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, U64), np.ones(1, U64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers that leaves no pattern."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, ``n`` of them at least."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=U64)
    return _powers


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts in a row, and the number of words of each text."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends_of_text = np.cumsum([len(t) + 1 for t in texts])
    power, inverse = _tables(len(data) + 1)
    blank = _IS_BLANK[data]
    change = np.flatnonzero(np.diff(blank, prepend=True))
    starts, ends = change[::2], change[1::2]
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(_OF_BYTE[data] * power[: len(data)], dtype=U64)])
    hashes = mix64((sums[ends] - sums[starts]) * inverse[starts])
    counts = np.diff(np.searchsorted(starts, ends_of_text), prepend=0)
    return hashes, counts


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    if not texts:
        return []
    words, counts = word_hashes(texts)
    rolled = words.copy()
    for i in range(1, min(k, len(words))):
        rolled[:-i] = rolled[:-i] * _STEP + words[i:]
    rolled = mix64(rolled)
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            own = np.sort(rolled[at : at + n - k + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif n:
            whole = words[at : at + 1]
            for i in range(at + 1, at + n):
                whole = whole * _STEP + words[i : i + 1]
            out.append(mix64(whole ^ U64(n)))
        else:
            out.append(np.zeros(0, U64))
        at += n
    return out


def by_bytes(texts: list[bytes], most: int = 1_000_000):
    """Index ranges of texts of about ``most`` bytes together; a longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())
