"""Word hashes and rolling window hashes of whole texts, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hashes a worker remembers; bounds its memory only.
REMEMBERED = 200_000
#: Odd multipliers of the two polynomials.
BASE, OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> bytes:
        value = xxhash.xxh3_64_digest(word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = value
        return value


_HASHES = _Hashes()


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space: bytes.split() cuts at exactly those six characters."""
    return (text or "").encode().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(_HASHES.__getitem__, words)), np.uint64)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of each window of ``width`` words (polynomial in BASE, modulo 2 ** 64), mixed."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, width):
        out *= BASE
        out += hashes[j : n + j]
    return mixed(out)


def window_checks(hashes: np.ndarray, width: int) -> np.ndarray:
    """24 more bits of each window: a polynomial in another base over re-mixed word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    words = mixed(hashes + BASE)
    out = words[:n].copy()
    for j in range(1, width):
        out *= OTHER
        out += words[j : n + j]
    return (mixed(out) >> np.uint64(40)).astype(np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def planes(values: np.ndarray) -> bytes:
    """Values byte plane by byte plane, so that Spark's own compression finds the empty planes."""
    width = values.dtype.itemsize
    return values.view(np.uint8).reshape(len(values), width).T.tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as planes of their differences."""
    return planes(np.diff(values.astype(np.uint64, copy=False), prepend=np.uint64(0)))


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)
