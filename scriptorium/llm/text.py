"""Word splitting that the word-shingle operators share."""

from __future__ import annotations

import numpy as np

#: A-Z to a-z; every ASCII byte that is neither a digit nor a letter to a space; bytes of other characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8: maximal runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
KEPT_POWERS = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(29))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse; only the first KEPT_POWERS are kept for further calls."""
    if len(_POWERS[0]) < n:
        made = []
        for base in (_BASE, _BASE_INVERSE):
            p = np.full(n + (n >> 1) if n < KEPT_POWERS else n, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if n >= KEPT_POWERS:
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the texts (words as in words_of), and where each text's words begin, with the end."""
    folded = [(t or "").encode("utf-8", "surrogatepass").translate(FOLD) for t in texts]
    data = np.frombuffer(b" ".join(folded) + b" ", np.uint8)
    inside = data != 32
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    first, last = edges[::2], edges[1::2]
    up, down = _powers(len(data))
    sums = np.cumsum(np.where(inside, _BYTE[data] * up, np.uint64(0)), dtype=np.uint64)
    before = np.where(first > 0, sums[first - 1], np.uint64(0))
    hashes = mix((sums[last - 1] - before) * down[first] + (last - first).astype(np.uint64) * _MIX)
    ends = np.cumsum([len(x) + 1 for x in folded]) if folded else np.zeros(0, np.int64)
    return hashes, np.concatenate([[0], np.searchsorted(first, ends)])
